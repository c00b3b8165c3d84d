"""The helpers under SQL names: SQL-bodied functions over native expressions, and the page tree."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rosterline.functions import text, urls
from rosterline.functions.html import _page_dom


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(_sql, values)) + ")"


URL_PARTS = "STRUCT<scheme STRING, netloc STRING, path STRING, params STRING, query STRING, fragment STRING>"


def _url_functions() -> dict[str, tuple[str, str, str]]:
    """URL splitting and joining, step by step as in ``functions.urls``: name to arguments, result and body."""
    cut = lambda pattern, of: f"regexp_extract({of}, {_sql(pattern)}, 1)"
    with_params = f"l.scheme IN {_in(urls.WITH_PARAMS)}"
    split = f"""transform(transform(array(regexp_replace(regexp_replace(u, {_sql(r'^[\x00-\x20]+')}, ''), {_sql(r'[\t\r\n]')}, '')),
        x -> named_struct('url', x, 'scheme', lower({cut(urls.SCHEME, 'x')}), 'path', {cut(urls.WITH_AUTHORITY + r'([^?#]*)', 'x')})),
        l -> named_struct('scheme', l.scheme, 'netloc', {cut(urls.AFTER_SCHEME + r'//([^/?#]*)', 'l.url')},
            'path', CASE WHEN {with_params} THEN {cut(r'(?s)^((?:.*/)?[^/;]*)', 'l.path')} ELSE l.path END,
            'params', CASE WHEN {with_params} THEN {cut(r'(?s)^(?:.*/)?+[^/;]*;(.*)$', 'l.path')} ELSE '' END,
            'query', {cut(r'(?s)^[^?#]*\?([^#]*)', 'l.url')}, 'fragment', {cut(r'(?s)#(.*)$', 'l.url')}))[0]"""
    unsplit = f"""concat(CASE WHEN p.scheme <> '' THEN concat(p.scheme, ':') ELSE '' END,
        CASE WHEN p.netloc <> '' AND p.path <> '' AND NOT startswith(p.path, '/') THEN concat('//', p.netloc, '/', p.path)
            WHEN p.netloc <> '' THEN concat('//', p.netloc, p.path)
            WHEN p.scheme <> '' AND p.scheme IN {_in(urls.HIERARCHICAL)} AND (p.path = '' OR startswith(p.path, '/')) THEN concat('//', p.path)
            ELSE p.path END,
        CASE WHEN p.params <> '' THEN concat(';', p.params) ELSE '' END, CASE WHEN p.query <> '' THEN concat('?', p.query) ELSE '' END,
        CASE WHEN p.fragment <> '' THEN concat('#', p.fragment) ELSE '' END)"""
    # Arguments of lambdas can't be passed to SQL functions: these two are put in as text.
    path = f"""transform(transform(array(split(CASE WHEN startswith(j.r.path, '/') THEN j.r.path
            ELSE regexp_replace(concat(regexp_replace(j.b.path, {_sql('[^/]*$')}, ''), j.r.path), {_sql('(?<=.)/{2,}')}, '/') END, '/')),
        s -> named_struct('last', element_at(s, -1), 'kept', aggregate(s, cast(array() AS ARRAY<STRING>), (kept, x) ->
            CASE WHEN x = '..' THEN slice(kept, 1, greatest(size(kept) - 1, 0)) WHEN x = '.' THEN kept ELSE concat(kept, array(x)) END))),
        w -> coalesce(nullif(array_join(CASE WHEN w.last IN ('.', '..') THEN concat(w.kept, array('')) ELSE w.kept END, '/'), ''), '/'))[0]"""
    part = lambda scheme, netloc, path, params, query: (
        f"transform(array(named_struct('scheme', {scheme}, 'netloc', {netloc}, 'path', {path}, 'params', {params}, 'query', {query}, "
        f"'fragment', j.r.fragment)), p -> {unsplit})[0]")
    scheme = "coalesce(nullif(j.r.scheme, ''), j.b.scheme)"
    plain = r"^https?://[^/?#\s;]+(?:/[^?#\s;]*)?(?:\?[^?#\s]+)?$"
    join = f"""CASE WHEN coalesce(base, '') = '' THEN ref WHEN coalesce(ref, '') = '' THEN base
        WHEN ref RLIKE {_sql(plain)} AND base RLIKE '^https?://' THEN ref
        ELSE transform(array(named_struct('b', url_split(base), 'r', url_split(ref))), j ->
            CASE WHEN {scheme} <> j.b.scheme OR {scheme} NOT IN {_in(urls.HIERARCHICAL)} THEN ref
                WHEN j.r.netloc <> '' THEN {part(scheme, 'j.r.netloc', 'j.r.path', 'j.r.params', 'j.r.query')}
                WHEN j.r.path = '' AND j.r.params = '' THEN
                    {part(scheme, 'j.b.netloc', 'j.b.path', 'j.b.params', "coalesce(nullif(j.r.query, ''), j.b.query)")}
                ELSE {part(scheme, 'j.b.netloc', path, 'j.r.params', 'j.r.query')} END)[0] END"""
    return {
        "url_split": ("u STRING", URL_PARTS, split),
        "url_unsplit": (f"p {URL_PARTS}", "STRING", unsplit),
        "url_join": ("base STRING, ref STRING", "STRING", join),
    }


# The nodes of a page with their texts, read off the parsed row: a lateral join over them moves no page.
NODES = """transform(array(page_dom(html)), d -> transform(d.nodes, n -> named_struct('id', n.id, 'parent', n.parent, 'last', n.last,
    'depth', n.depth, 'tag', n.tag, 'attrs', n.attrs, 'text', substring(d.text, n.t0 + 1, n.t1 - n.t0))))[0]"""
NODE_COLUMNS = "id INT, parent INT, last INT, depth INT, tag STRING, attrs MAP<STRING, STRING>, text STRING"


def register_functions(spark: SparkSession) -> list[str]:
    """Register page_dom, html_nodes, the URL functions and the text helpers for this session.

    All but ``page_dom``, the one parse stage, have SQL bodies that are planned into the query. ``html_nodes(html)`` is a table
    for ``LATERAL``: the page's nodes with their texts.
    """
    spark.udf.register("page_dom", _page_dom)
    one_spaced = f"regexp_replace(coalesce(c, ''), {_sql(text.SPACE + '+')}, ' ')"
    bodies = _url_functions() | {
        "clean_text": ("c STRING", "STRING", f"trim(regexp_replace({one_spaced}, {_sql(r'[^\p{L}\p{N}_ @.,;:!?()\-]')}, ''))"),
        "extract_emails": ("c STRING", "ARRAY<STRING>", f"regexp_extract_all(c, {_sql(text.EMAIL)}, 0)"),
        "extract_phones": ("c STRING", "ARRAY<STRING>", "concat(" + ", ".join(
            f"regexp_extract_all(c, {_sql(p)}, 0)" for p in text.PHONE_PATTERNS) + ")"),
        "email_valid": ("c STRING", "BOOLEAN", f"c rlike {_sql('^' + text.EMAIL_BODY + r'\n?\z')}"),
        "content_hash": ("c STRING", "STRING", "sha2(c, 256)"),
    }
    for name, (arguments, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    fields = ", ".join(f"n.{c.split()[0]}" for c in NODE_COLUMNS.split(", ") if c.split()[0] != "STRING>")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION html_nodes(html STRING) RETURNS TABLE({NODE_COLUMNS}) "
              f"RETURN SELECT {fields} FROM explode({NODES}) x(n)")
    return ["page_dom", "html_nodes", *bodies]

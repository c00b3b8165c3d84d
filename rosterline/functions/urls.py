"""URL scalars, all native expressions: RFC 3986 split, normalization, joining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterline.functions.text import ColumnLike, as_column, let, py_strip

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AFTER_SCHEME = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
WITH_AUTHORITY = AFTER_SCHEME + r"(?://[^/?#]*)?"

# URL path segments that mark a person page.
PERSON_SEGMENTS = [
    "people", "person", "profile", "faculty", "staff",
    "team", "member", "employee", "researcher", "expert",
]

# Schemes whose references resolve against a base, and which carry an authority.
HIERARCHICAL = ["", "http", "https", "ftp", "sftp", "file", "ws", "wss"]
# Schemes where ";" opens parameters in the last path segment.
WITH_PARAMS = ["", "http", "https", "ftp", "sftp", "tel", "sip", "sips", "rtsp", "mms"]

# A short default list; ``operators.domains.with_registered_domain`` takes a full table of rules.
DEFAULT_SUFFIXES = [
    "ac.uk", "ai", "app", "at", "au", "be", "biz", "br", "ca", "ch", "cn", "co", "co.in", "co.jp", "co.kr",
    "co.nz", "co.uk", "com", "com.au", "com.br", "cz", "de", "dev", "dk", "edu", "edu.au", "es", "eu", "fi",
    "fr", "gov", "gov.uk", "ie", "il", "in", "info", "int", "io", "it", "jp", "kr", "me", "mil", "mx", "net",
    "nl", "no", "nz", "org", "org.uk", "pl", "pt", "ru", "se", "tech", "uk", "us",
]


def _tidy(c: Column) -> Column:
    """What URL parsers drop before they look: leading blanks, tabs, line breaks."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def split_url(c: Column) -> Column:
    """struct(scheme, netloc, path, params, query, fragment), '' for absent parts.

    Bound step by step: repeated subexpressions would otherwise outgrow generated code.
    """

    def parts(u: Column) -> Column:
        with_params, path = u["scheme"].isin(WITH_PARAMS), u["path"]
        return F.struct(
            u["scheme"].alias("scheme"),
            F.regexp_extract(u["url"], AFTER_SCHEME + r"//([^/?#]*)", 1).alias("netloc"),
            F.when(with_params, F.regexp_extract(path, r"(?s)^((?:.*/)?[^/;]*)", 1)).otherwise(path).alias("path"),
            F.when(with_params, F.regexp_extract(path, r"(?s)^(?:.*/)?+[^/;]*;(.*)$", 1)).otherwise("").alias("params"),
            F.regexp_extract(u["url"], r"(?s)^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(u["url"], r"(?s)#(.*)$", 1).alias("fragment"),
        )

    def located(url: Column) -> Column:
        return F.struct(
            url.alias("url"), F.lower(F.regexp_extract(url, SCHEME, 1)).alias("scheme"),
            F.regexp_extract(url, WITH_AUTHORITY + r"([^?#]*)", 1).alias("path"),
        )

    return let(let(_tidy(c), located), parts)


def unsplit_url(scheme: Column, netloc: Column, path: Column, params: Column, query: Column,
                fragment: Column) -> Column:
    """Parts back to text; empty parts leave no delimiter behind."""
    authority = (
        F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("//"), netloc, F.lit("/"), path))
        .when(netloc != "", F.concat(F.lit("//"), netloc, path))
        .when((scheme != "") & scheme.isin(HIERARCHICAL) & ((path == "") | path.startswith("/")),
              F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        authority,
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def url_normalize_strict(c: ColumnLike) -> Column:
    """Lower, strip, no fragment, no trailing slash on the path (root becomes '/')."""

    def rebuild(u: Column) -> Column:
        trimmed = F.regexp_replace(u["path"], "/+$", "")
        path = F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
        return unsplit_url(u["scheme"], u["netloc"], path, u["params"], u["query"], F.lit(""))

    return let(split_url(py_strip(F.lower(as_column(c)))), rebuild)


def url_normalize(c: ColumnLike) -> Column:
    """Lower, strip, cut at '#', and drop trailing slashes when the path ends with one."""

    def trim(bare: Column) -> Column:
        path = split_url(bare)["path"]
        return let(path, lambda p: F.when(
            (p != "/") & p.endswith("/"), F.regexp_replace(bare, "/+$", "")).otherwise(bare))

    return let(F.split_part(F.lower(py_strip(as_column(c))), F.lit("#"), F.lit(1)), trim)


def url_is_valid(c: ColumnLike) -> Column:
    """Scheme and authority both there, brackets balanced; null counts as invalid."""
    url = _tidy(as_column(c))
    netloc = F.regexp_extract(url, SCHEME + r"//([^/?#]+)", 2)
    return F.coalesce((netloc != "") & (netloc.contains("[") == netloc.contains("]")), F.lit(False))


def url_netloc(c: ColumnLike) -> Column:
    """Authority with its case, port and user info; null when absent."""
    return F.nullif(F.regexp_extract(_tidy(as_column(c)), AFTER_SCHEME + r"//([^/?#]*)", 1), F.lit(""))


def url_base(c: ColumnLike) -> Column:
    url = _tidy(as_column(c))
    return F.concat(
        F.lower(F.regexp_extract(url, SCHEME, 1)), F.lit("://"),
        F.regexp_extract(url, AFTER_SCHEME + r"//([^/?#]*)", 1),
    )


def url_host(c: ColumnLike) -> Column:
    """Host without user info, port and trailing dots, in its own case; also of a URL without scheme."""
    authority = F.regexp_extract(_tidy(as_column(c)), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r"(?::\d*)?\.*$", "")


def url_registered_domain(c: ColumnLike, suffixes: list[str] | None = None) -> Column:
    """``domain.suffix`` by the longest known suffix; ``host.`` when none is known.

    For a short list of plain suffixes; ``operators.domains`` takes a table of rules of any size, with wildcards.
    """
    known = suffixes or DEFAULT_SUFFIXES
    host = url_host(c)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    tails = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), ".")
    )
    suffix = F.get(F.filter(tails, lambda t: F.lower(t).isin(known)), F.lit(0))
    domain = F.get(labels, count - F.size(F.split(suffix, r"\.")) - 1)
    is_ip = host.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    return (
        F.when(is_ip, F.concat(host, F.lit(".")))
        .when(suffix.isNotNull(), F.concat(F.coalesce(domain, F.lit("")), F.lit("."), suffix))
        .otherwise(F.concat(F.get(labels, count - 1), F.lit(".")))
    )


def url_is_person(c: ColumnLike) -> Column:
    return F.lower(as_column(c)).rlike("/(" + "|".join(PERSON_SEGMENTS) + ")/")


def task_id(c: ColumnLike) -> Column:
    return F.sha2(url_normalize_strict(c), 256)


def task_id_loose(c: ColumnLike) -> Column:
    return F.sha2(url_normalize(c), 256)


def _resolved_path(base_path: Column, path: Column) -> Column:
    """Merge a reference path with its base and remove dot segments."""
    base_dir = F.regexp_replace(base_path, r"[^/]*$", "")
    relative = F.regexp_replace(F.concat(base_dir, path), r"(?<=.)/{2,}", "/")
    segments = F.split(F.when(path.startswith("/"), path).otherwise(relative), "/")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(s == ".", kept)
        .otherwise(F.concat(kept, F.array(s))),
    )
    joined = F.array_join(
        F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked),
        "/",
    )
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def url_join(base: ColumnLike, ref: ColumnLike) -> Column:
    """Resolve ``ref`` against ``base``; usable inside array lambdas, no Python worker."""
    base, ref = as_column(base), as_column(ref)

    def resolve(parts: Column) -> Column:
        b, r = parts["b"], parts["r"]
        scheme = F.when(r["scheme"] == "", b["scheme"]).otherwise(r["scheme"])
        foreign = (scheme != b["scheme"]) | ~scheme.isin(HIERARCHICAL)
        same_document = (r["path"] == "") & (r["params"] == "")
        return (
            F.when(foreign, ref)
            .when(r["netloc"] != "",
                  unsplit_url(scheme, r["netloc"], r["path"], r["params"], r["query"], r["fragment"]))
            .when(same_document,
                  unsplit_url(scheme, b["netloc"], b["path"], b["params"],
                              F.when(r["query"] == "", b["query"]).otherwise(r["query"]), r["fragment"]))
            .otherwise(
                unsplit_url(scheme, b["netloc"], _resolved_path(b["path"], r["path"]), r["params"], r["query"],
                            r["fragment"]))
        )

    # Plain absolute web links are the common case and pass through untouched.
    plain = ref.rlike(r"^https?://[^/?#\s;]+(?:/[^?#\s;]*)?(?:\?[^?#\s]+)?$") & base.rlike("^https?://")
    return (
        F.when(F.coalesce(base, F.lit("")) == "", ref)
        .when(F.coalesce(ref, F.lit("")) == "", base)
        .when(plain, ref)
        .otherwise(let(F.struct(split_url(base).alias("b"), split_url(ref).alias("r")), resolve))
    )


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def query_keys(c: ColumnLike) -> Column:
    """Names of query parameters that have a value."""
    query = F.regexp_extract(_tidy(as_column(c)), r"(?s)^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?s)^[^=]*=.+$"))
    return F.transform(pairs, lambda p: _decode(F.split_part(p, F.lit("="), F.lit(1))))


def has_cursor_param(c: ColumnLike) -> Column:
    return F.arrays_overlap(query_keys(c), F.array(F.lit("cursor"), F.lit("after"), F.lit("offset")))


def with_query_param(c: ColumnLike, name: str, value: Column) -> Column:
    """Set or replace one query parameter; blank-valued pairs and the fragment drop out.

    Equal names are grouped at their first position and a replaced name keeps its place.
    """
    def rebuild(u: Column) -> Column:
        pairs = F.filter(F.split(u["query"], "&"), lambda p: p.rlike(r"(?s)^[^=]*=.+$"))
        decoded = F.transform(
            pairs,
            lambda p: F.struct(
                _decode(F.regexp_extract(p, r"(?s)^([^=]*)=", 1)).alias("k"),
                _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
            ),
        )
        return let(decoded, lambda found: unsplit_url(
            u["scheme"], u["netloc"], u["path"], u["params"], requery(found), F.lit("")))

    def encode(text: Column) -> Column:
        # Java's encoder keeps '*' and escapes '~'; the form encoding wanted here is the reverse.
        return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def requery(found: Column) -> Column:
        def rebuilt(key: Column) -> Column:
            values = F.transform(F.filter(found, lambda p: p["k"] == key), lambda p: p["v"])
            values = F.when(key == name, F.array(value.cast("string"))).otherwise(values)
            return F.array_join(F.transform(values, lambda v: F.concat(encode(key), F.lit("="), encode(v))), "&")

        names = F.array_distinct(F.concat(F.transform(found, lambda p: p["k"]), F.array(F.lit(name))))
        return F.array_join(F.transform(names, rebuilt), "&")

    return let(split_url(as_column(c)), rebuild)

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from rosterline.llm import license_scan


def words(text: str) -> str:
    """The list of words of a text, A-Z lower-cased."""
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all(coalesce({low}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: One row with ``t``, the table of CRC-32.
CRC_TABLE = """(SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"""


def crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, by the table ``t``."""
    octets = f"list_transform(range(1, strlen({text}) * 2, 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])))"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, start: str) -> str:
    """All nodes (grp, level, pos, h, n) of the trees over ``start``'s; a level's ``n`` nodes stand at 0 to n - 1."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT grp, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY grp, level, pos // 3)"""


def _path(tree: str, of: str, pos: str) -> str:
    """Per level what stands before and after the ancestor of a node at ``pos``."""
    return f"""SELECT o.*, t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < o.{pos} // (3 ** t.level)::BIGINT), '') AS b,
    coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > o.{pos} // (3 ** t.level)::BIGINT), '') AS a
  FROM {of} o JOIN {tree} t ON t.grp IS NOT DISTINCT FROM o.grp AND t.n > 1 AND t.pos // 3 = o.{pos} // (3 ** (t.level + 1))::BIGINT GROUP BY ALL"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, {_leaf('text')} AS leaf,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS altered
  FROM documents, {CRC_TABLE}),
{_tree('inner_tree', "SELECT grp, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM leaves")},
subroots AS (SELECT grp AS name, h AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS k, 0 AS grp FROM inner_tree WHERE n = 1),
{_tree('outer_tree', "SELECT 0 AS grp, 0 AS level, k AS pos, subroot AS h, count(*) OVER () AS n FROM subroots")},
steps AS (
  SELECT doc_id, grp, pos, 0 AS half, level, b, a FROM ({_path('inner_tree', 'leaves', 'pos')})
  UNION ALL
  SELECT l.doc_id, l.grp, l.pos, 1, p.level, p.b, p.a FROM leaves l JOIN ({_path('outer_tree', 'subroots', 'k')}) p ON p.name IS NOT DISTINCT FROM l.grp),
ordered AS (SELECT *, row_number() OVER (PARTITION BY grp, pos ORDER BY half, level) AS step FROM steps),
folds AS (
  SELECT grp, pos, altered AS h, 0::BIGINT AS step FROM leaves
  UNION ALL
  SELECT f.grp, f.pos, sha256(o.b || f.h || o.a), o.step FROM folds f JOIN ordered o ON o.grp IS NOT DISTINCT FROM f.grp AND o.pos = f.pos AND o.step = f.step + 1),
folded AS (SELECT grp, pos, max_by(h, step) AS folded_root FROM folds GROUP BY ALL),
proofs AS (SELECT grp, pos, string_agg(b || a, '' ORDER BY step) AS p FROM ordered GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM leaves l JOIN subroots s ON s.name IS NOT DISTINCT FROM l.grp JOIN folded f ON f.grp IS NOT DISTINCT FROM l.grp AND f.pos = l.pos
LEFT JOIN proofs p ON p.grp IS NOT DISTINCT FROM l.grp AND p.pos = l.pos, (SELECT h FROM outer_tree WHERE n = 1) r"""


def _licenses() -> str:
    scan = license_scan.Scan()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda ws: "[" + ", ".join(map(quote, ws)) + "]"
    templates = ", ".join(f"({quote(label)}, {listed(ws)}, {size}, {scan.least(len(ws))})" for label, ws, size in scan.sets)
    phrases = ", ".join(f"({listed(p.split())}, {quote(label)})" for p, label in license_scan.PHRASES)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}),
templates(label, t, s, least) AS (VALUES {templates}),
starts AS (SELECT r, i, label FROM (SELECT r, w, unnest(range(len(w))) AS i FROM docs), phrases
  WHERE w[i + 1] = p[1] AND list_slice(w, i + 1, i + len(p)) = p),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM starts GROUP BY r),
blocks AS (SELECT r, s, list_distinct(list_slice(w, b * s + 1, b * s + 2 * s)) AS held
  FROM (SELECT r, w, s, unnest(range((len(w) + s - 1) // s)) AS b FROM docs, (SELECT DISTINCT s FROM templates))),
matches AS (SELECT r, label, len(list_intersect(held, t)) / len(t) AS share FROM blocks JOIN templates USING (s) WHERE len(list_intersect(held, t)) >= least),
own AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM matches GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN own USING (r)"""


def _runs(table: str) -> str:
    return f"""SELECT r, array_to_string(list_slice(w, i, i + k - 1), ' ') AS f
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM {table}, (VALUES (1), (2), (3)) v(k))"""


RESAMPLING = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
items AS (SELECT row_number() OVER () AS r, {words('text')} AS w FROM benchmark),
runs AS ({_runs('docs')}), aims AS ({_runs('items')}),
buckets AS (SELECT f, {crc32('f')} % 10000 AS b FROM (SELECT DISTINCT f FROM runs UNION SELECT f FROM aims), {CRC_TABLE}),
have AS (SELECT b, count(*)::DOUBLE AS s FROM runs JOIN buckets USING (f) GROUP BY b),
want AS (SELECT b, count(*)::DOUBLE AS t FROM aims JOIN buckets USING (f) GROUP BY b),
gains AS (SELECT h.b, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain
  FROM have h LEFT JOIN want USING (b), (SELECT count(*)::DOUBLE AS ss FROM runs), (SELECT count(*)::DOUBLE AS tt FROM aims)),
sums AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM runs JOIN buckets USING (f) JOIN gains USING (b) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) >= 20 AS able, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN sums USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS many FROM scored WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * many // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)"""

SQL: dict[str, str] = {
    "op11_merkle_manifest": MERKLE,
    "op12_license_scans": _licenses(),
    "op13_target_resampling": RESAMPLING,
}

"""URL and text functions over whole columns of pages, documents, customer and part."""

from pyspark.sql import functions as F

from registry import query, table
from rosterline.functions import text, urls
from rosterline.operators import domains
from rosterline.sources.pages import spread

# --- URLs ------------------------------------------------------------------------------------

VARIANTS = "array(url, upper(url), concat('  ', url, '/'), concat(url, '#frag'))"
VARIANTS_SQL = "SELECT page_id, unnest([url, upper(url), '  ' || url || '/', url || '#frag']) AS url FROM pages"
STRICT_SQL = """
    regexp_extract(u, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1)
    || CASE WHEN rtrim(regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/'
            ELSE rtrim(regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') END
    || CASE WHEN regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) <> ''
            THEN '?' || regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) ELSE '' END"""
LOOSE_SQL = """
    CASE WHEN regexp_matches(split_part(u, '#', 1), '^[a-z][a-z0-9+.-]*://[^/?#]*/[^?#]*[^/?#][^?#]*/([?]|$)')
         THEN rtrim(split_part(u, '#', 1), '/') ELSE split_part(u, '#', 1) END"""


def variants(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "url")).select(
        "page_id", F.explode(F.expr(VARIANTS)).alias("url"))


def _variant_query(key, build, out, expression):
    sql = f"""WITH v AS ({VARIANTS_SQL}), s AS (SELECT page_id, url, lower(trim(url)) AS u FROM v)
    SELECT page_id, url, {expression} AS {out} FROM s"""

    @query(key, sql)
    def run(spark, d):
        return variants(spark, d).withColumn(out, build("url"))


_variant_query("url_normalize_strict", urls.url_normalize_strict, "normalized", STRICT_SQL)
_variant_query("url_normalize", urls.url_normalize, "normalized", LOOSE_SQL)
_variant_query("task_id", urls.task_id, "task_id", f"sha256({STRICT_SQL})")
_variant_query("task_id_loose", urls.task_id_loose, "task_id", f"sha256({LOOSE_SQL})")

REFS = ["/x/y", "?page=2", "https://other.example.org/z?a=1", "//cdn.example.org/a", "sib", "../up", "#top"]


@query("url_join", """
    WITH refs AS (SELECT unnest(['/x/y', '?page=2', 'https://other.example.org/z?a=1', '//cdn.example.org/a', 'sib',
                                 '../up', '#top']) AS ref),
    p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
                 regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
                 regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, split_part(url, '#', 1) AS bare FROM pages)
    SELECT page_id, ref, CASE
        WHEN ref = '/x/y' THEN origin || ref WHEN ref = '?page=2' THEN origin || path || ref
        WHEN ref LIKE 'https:%' THEN ref WHEN ref LIKE '//%' THEN scheme || ':' || ref
        WHEN ref = 'sib' THEN origin || regexp_replace(path, '[^/]*$', '') || 'sib'
        WHEN ref = '../up' THEN origin || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'up'
        ELSE bare || '#top' END AS joined
    FROM p, refs""")
def url_join(spark, d):
    refs = F.explode(F.array(*map(F.lit, REFS))).alias("ref")
    return spread(table(spark, d, "pages").select("page_id", "url")).select("page_id", "url", refs).select(
        "page_id", "ref", urls.url_join("url", "ref").alias("joined"))


CUT = "array(url, regexp_replace(url, '^[a-z]+://', ''), regexp_replace(url, '//[^/]*', ''), '')"
CUT_SQL = ("SELECT page_id, unnest([url, regexp_replace(url, '^[a-z]+://', ''), regexp_replace(url, '//[^/]*', ''), '']) "
           "AS url FROM pages")


def cut_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.expr(CUT)).alias("url"))


@query("url_is_valid", f"""WITH v AS ({CUT_SQL})
    SELECT page_id, url, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]') AS valid FROM v""")
def url_is_valid(spark, d):
    return cut_urls(spark, d).withColumn("valid", urls.url_is_valid("url"))


@query("url_netloc", f"""WITH v AS ({CUT_SQL})
    SELECT page_id, url, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '') AS netloc FROM v""")
def url_netloc(spark, d):
    return cut_urls(spark, d).withColumn("netloc", urls.url_netloc("url"))


@query("url_registered_domain", """
    SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '([^.]+[.](com|net|org))$', 1) AS domain
    FROM pages""")
def url_registered_domain(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_registered_domain("url").alias("domain"))


RULES = ["com", "net", "org", "sg", "com.sg", "cn", "edu.cn", "*.ck", "!www.ck", "uk", "co.uk", "jp", "*.kobe.jp", "!city.kobe.jp"]
#: Hosts by page: of plain, longer, wildcard and excepted suffixes, and of none.
TAILS = ["a.b.com.sg", "x.uni.edu.cn", "p.q.ck", "www.ck", "shop.www.ck", "a.b.kobe.jp", "deep.city.kobe.jp", "New.CO.uk", "nowhere", "com"]


@query("domains_by_rules", f"""
    WITH r AS (SELECT ltrim(rule, '!') AS key, rule LIKE '!%' AS exc FROM (SELECT unnest({RULES}) AS rule)),
    h AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'h' || page_id % 50 || '.' ELSE '' END || ({TAILS})[page_id % {len(TAILS)} + 1] AS host FROM pages),
    l AS (SELECT *, string_split(host, '.') AS w FROM h),
    t AS (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS p FROM l),
    m AS (SELECT t.page_id, exc, len(w) - p + 1 - exc::INT AS size FROM t JOIN r
        ON key = lower(array_to_string(w[p:], '.')) OR (p < len(w) AND key = lower('*.' || array_to_string(w[p + 1:], '.')))),
    b AS (SELECT page_id, max_by(size, (exc::INT, size)) AS size FROM m GROUP BY page_id)
    SELECT page_id, CASE WHEN size IS NULL THEN w[len(w)] || '.' ELSE coalesce(w[len(w) - size], '') || '.' || array_to_string(w[len(w) - size + 1:], '.') END AS domain
    FROM l LEFT JOIN b USING (page_id)""")
def domains_by_rules(spark, d):
    host = F.concat(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("h"), F.col("page_id") % 50, F.lit("."))).otherwise(""),
                    F.get(F.array(*map(F.lit, TAILS)), (F.col("page_id") % len(TAILS)).cast("int")))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://u@"), host, F.lit(":80/x?y=/z")).alias("url"))
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    return domains.with_registered_domain(pages, rules).select("page_id", "domain")


@query("url_base", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base FROM pages")
def url_base(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_base("url").alias("base"))


LINKED = ("concat(split_part(url, '?', 1), '/', array('People','staff','about','researcher','profiles')"
          "[cast(page_id % 5 as int)], '/7')")


@query("url_is_person", """
    SELECT page_id, regexp_matches(lower(split_part(url, '?', 1) || '/'
        || ['People', 'staff', 'about', 'researcher', 'profiles'][(page_id % 5 + 1)::INT] || '/7'),
        '/(people|person|profile|faculty|staff|team|member|employee|researcher|expert)/') AS person FROM pages""")
def url_is_person(spark, d):
    linked = table(spark, d, "pages").select("page_id", F.expr(LINKED).alias("link"))
    return linked.select("page_id", urls.url_is_person("link").alias("person"))


# --- text ------------------------------------------------------------------------------------

SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
EMAIL_SQL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def clean_sql(expression: str) -> str:
    return (rf"trim(regexp_replace(regexp_replace({expression}, '{SPACE_SQL}+', ' ', 'g'), "
            r"'[^\p{L}\p{N}_ @.,;:!?()\-]', '', 'g'), ' ')")


def documents(spark, d):
    return spread(table(spark, d, "documents"))


@query("extract_emails", f"""
    SELECT doc_id, array_to_string(regexp_extract_all(text, '{EMAIL_SQL}'), ' ') AS emails FROM documents""")
def extract_emails(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(text.extract_emails("text"), " ").alias("emails"))


CALLS = ("concat('a+', c_nationkey + 10, ' 650 555 12', ' or ', lpad(cast(c_custkey as string), 10, '4'), ' or x(415) 555-',"
         " lpad(cast(c_custkey % 10000 as string), 4, '0'), ' or (415) 555-6789 or 555.010-', 1000 + c_custkey % 9000)")


@query("extract_phones", """
    SELECT c_custkey, lpad(c_custkey::VARCHAR, 10, '4') || ' | 555.010-' || (1000 + c_custkey % 9000)
        || ' | (415) 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
        || ' | +' || (c_nationkey + 10) || ' 650 555 12' AS phones FROM customer""")
def extract_phones(spark, d):
    calls = table(spark, d, "customer").select("c_custkey", F.expr(CALLS).alias("t"))
    return calls.select("c_custkey", F.array_join(text.extract_phones("t"), " | ").alias("phones"))


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", text.clean_text("text").alias("cleaned"))


@query("truncate_text", """
    SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500) || '...' END AS cut
    FROM documents""")
def truncate_text(spark, d):
    return documents(spark, d).select("doc_id", text.truncate_text("text").alias("cut"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return documents(spark, d).select("doc_id", text.content_hash("text").alias("hash"))


@query("reading_time_s", f"""
    SELECT doc_id, trunc((len(list_filter(regexp_split_to_array(text, '{SPACE_SQL}+'), lambda w: w <> ''))::DOUBLE
        / 200.0) * 60)::BIGINT AS seconds FROM documents""")
def reading_time_s(spark, d):
    return documents(spark, d).select("doc_id", text.reading_time_s("text").alias("seconds"))


@query("name_parts", """
    WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type
                   WHEN 2 THEN ' ' || p_name || '  ' || p_type || ' ' || p_brand ELSE '' END AS v FROM part),
    w AS (SELECT p_partkey, v, list_filter(string_split_regex(v, ' +'), lambda t: t <> '') AS t FROM n)
    SELECT p_partkey, coalesce(t[1], '') AS first, CASE WHEN len(t) > 2 THEN array_to_string(t[2:len(t)-1], ' ')
        ELSE '' END AS middle, CASE WHEN len(t) > 1 THEN t[len(t)] ELSE '' END AS last, v AS "full" FROM w""")
def name_parts(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type "
        "WHEN 2 THEN concat(' ', p_name, '  ', p_type, ' ', p_brand) ELSE '' END").alias("v"))
    return names.select("p_partkey", text.name_parts("v").alias("n")).select("p_partkey", "n.*")


MAILS = ("CASE c_custkey % 5 WHEN 0 THEN concat(c_name, '@mail.org') WHEN 1 THEN concat(lower(c_mktsegment), '@mail.example.org') "
         "WHEN 2 THEN concat('a.b+', c_custkey, '@x-y.co') WHEN 3 THEN concat(c_custkey, '@mail') "
         "ELSE concat('u', c_custkey, '@m.org\\n') END")


@query("email_valid", r"""
    WITH m AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN concat(c_name, '@mail.org')
        WHEN 1 THEN concat(lower(c_mktsegment), '@mail.example.org') WHEN 2 THEN concat('a.b+', c_custkey, '@x-y.co')
        WHEN 3 THEN concat(c_custkey, '@mail') ELSE concat('u', c_custkey, '@m.org', chr(10)) END AS mail FROM customer)
    SELECT c_custkey, regexp_matches(mail, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\n?\z') AS valid FROM m""")
def email_valid(spark, d):
    mails = table(spark, d, "customer").select("c_custkey", F.expr(MAILS).alias("mail"))
    return mails.select("c_custkey", text.email_valid("mail").alias("valid"))


@query("record_id", """
    SELECT c_custkey, substr(sha256(CASE c_custkey % 3 WHEN 0 THEN 'https://dir.example.org/people/' || c_custkey
        WHEN 1 THEN lower(c_name) || '|' || lower(c_mktsegment) || '@mail.org' ELSE 'src' || c_nationkey END), 1, 16)
        AS record_id FROM customer""")
def record_id(spark, d):
    people = table(spark, d, "customer").select(
        "c_custkey",
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('https://dir.example.org/people/', c_custkey) ELSE '' END").alias("u"),
        F.expr("CASE WHEN c_custkey % 3 < 2 THEN concat(' ', c_name, ' ') END").alias("n"),
        F.expr("CASE WHEN c_custkey % 3 < 2 THEN concat(c_mktsegment, '@mail.org') ELSE '' END").alias("e"),
        F.expr("concat('src', c_nationkey)").alias("s"))
    return people.select("c_custkey", text.record_id("u", "n", "e", "s").alias("record_id"))

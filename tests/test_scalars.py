"""URL and text scalars against literals and against Python's own URL and regex modules."""

import hashlib
import random
import re
import urllib.parse as up

from pyspark.sql import functions as F

from rosterline.operators import domains
from rosterline.functions import text, urls


def run(spark, values, build, cols="v string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {cols}").repartition(2)
    return [r.out for r in df.select("i", build().alias("out")).orderBy("i").collect()]


def test_normalize_strict(spark):
    values = ["https://Example.com/Path", "https://example.com/path/", "https://example.com/path#fragment",
              "https://e.com", " https://e.com/a/;x?q=1 ", "https://e.com/p/?q=/", "https://e.com?", "mailto:A@b"]
    assert run(spark, values, lambda: urls.url_normalize_strict("v")) == [
        "https://example.com/path", "https://example.com/path", "https://example.com/path", "https://e.com/",
        "https://e.com/a;x?q=1", "https://e.com/p?q=/", "https://e.com/", "mailto:a@b"]


def test_normalize_loose(spark):
    values = ["HTTPS://Example.COM/Path", "https://example.com#fragment", "https://e.com/p/?q=1",
              "https://e.com/p/?q=/", "https://e.com/", "https://e.com/p//"]
    assert run(spark, values, lambda: urls.url_normalize("v")) == [
        "https://example.com/path", "https://example.com", "https://e.com/p/?q=1", "https://e.com/p/?q=",
        "https://e.com/", "https://e.com/p"]


BASES = ["https://example.com/people", "https://example.com/a/b/c?x=1#f", "http://e.com", "https://e.com/a/;p",
         "https://e.com/a//b/", "", "mailto:x@y.z"]
REFS = ["/profile/1", "profile/1", "https://other.org/x", "?page=2", "#top", "../x", "../../../x", "./", "..",
        "//host/p", "", ".", "a/./b/../c", "https:", "http:foo", "mailto:a@b.c", "a;b?c#d", ";p", "javascript:void(0)",
        "/a/../b/.", "https://e.com?", "https://e.com/p#", "a//b", "/x//y", "HTTPS://E.com/Q"]


def test_join_matches_urllib(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    got = run(spark, pairs, lambda: urls.url_join("b", "r"), "b string, r string")
    wrong = [(p, g, up.urljoin(*p)) for p, g in zip(pairs, got) if g != up.urljoin(*p)]
    assert not wrong


def random_strings(alphabet, longest, count, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(count)]


def test_join_matches_urllib_random(spark):
    pairs = [("https://h.org/d/e?k=v", r) for r in random_strings("ab/.?#;=&:", 10, 4000)]
    got = run(spark, pairs, lambda: urls.url_join("b", "r"), "b string, r string")
    assert got == [up.urljoin(*p) for p in pairs]


def test_validity_netloc_base_person(spark):
    values = ["https://example.com", "http://sub.example.com:80/p", "not-a-url", "/relative/path", "http://[::1", None]
    assert run(spark, values, lambda: urls.url_is_valid("v")) == [True, True, False, False, False, False]
    assert run(spark, ["https://sub.Example.com/path", None, "", "//u:p@h:1/x", "x"], lambda: urls.url_netloc("v")) == [
        "sub.Example.com", None, None, "u:p@h:1", None]
    assert run(spark, ["HTTPS://E.com:8/p?q"], lambda: urls.url_base("v")) == ["https://E.com:8"]
    values = ["https://e.com/people/john", "https://e.com/Faculty/x", "https://e.com/profile/1", "https://e.com/about",
              "https://e.com/contact"]
    assert run(spark, values, lambda: urls.url_is_person("v")) == [True, True, True, False, False]


def test_registered_domain(spark):
    values = ["https://engineering.school.edu/x", "https://a.b.co.uk:80/", "http://localhost/", "b.com", "http://10.0.0.1/",
              "https://u@x.y.org", "https://co.uk/"]
    assert run(spark, values, lambda: urls.url_registered_domain("v")) == [
        "school.edu", "b.co.uk", "localhost.", "b.com", "10.0.0.1.", "y.org", ".co.uk"]
    assert run(spark, ["http://a.b.c.zz"], lambda: urls.url_registered_domain("v", ["c.zz"])) == ["b.c.zz"]


def test_task_ids(spark):
    strict, loose = [run(spark, ["https://e.com"], lambda f=f: f("v"))[0] for f in (urls.task_id, urls.task_id_loose)]
    assert strict == hashlib.sha256(b"https://e.com/").hexdigest()
    assert loose == hashlib.sha256(b"https://e.com").hexdigest()


def test_query_param_matches_urllib(spark):
    bases = ["https://e.com/list", "https://e.com/list?page=9&q=a%20b&e=&q=c", "https://e.com/l;p?x=*~é+1#frag"]

    def expected(base, n):
        parts = up.urlparse(base)
        params = up.parse_qs(parts.query)
        params["page"] = [str(n)]
        return up.urlunparse((*parts[:4], up.urlencode(params, doseq=True), ""))

    assert run(spark, bases, lambda: urls.with_query_param("v", "page", F.lit(3))) == [expected(b, 3) for b in bases]


EMAIL_PY = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
TEXTS = ["Write to ada@mail.org or bea.long@school.edu today.", "éa@b.com", ".a@b.com", "a@b.comé", "x a@b.c",
         "a@b.co|m", "a@b.com_ z@y.org", "", "no"]


def test_emails_match_python_regex(spark):
    assert run(spark, TEXTS, lambda: text.extract_emails("v")) == [re.findall(EMAIL_PY, t) for t in TEXTS]
    assert run(spark, TEXTS, lambda: text.first_email("v")) == [(re.findall(EMAIL_PY, t) or [""])[0] for t in TEXTS]


PHONES_PY = [r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\(\d{3}\)\s*\d{3}[-.]?\d{4}\b",
             r"\b\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b"]


def test_phones_match_python_regex(spark):
    values = ["Call 123-456-7890 or (415) 555-6789", "x(415) 555-6789 then 650.555.1234", "a+1 650 555 1234", "+1 650 555 1234",
              "1234567890 12345678901"]
    expected = [[m for p in PHONES_PY for m in re.findall(p, v)] for v in values]
    assert run(spark, values, lambda: text.extract_phones("v")) == expected
    assert run(spark, values, lambda: text.first_phone("v")) == [(e or [""])[0] for e in expected]


def test_text_matches_python_random(spark):
    values = random_strings("aé² \t\n\u00a0\u2003\x85@.|-_#%1(", 24, 4000)

    def clean(t):
        return re.sub(r"[^\w\s@.,;:!?()\-]", "", re.sub(r"\s+", " ", t)).strip() if t else ""

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(2)
    rows = df.select("i", text.clean_text("v").alias("c"), text.py_strip("v").alias("s"),
                     text.extract_emails("v").alias("e"), text.reading_time_s("v").alias("r")).orderBy("i").collect()
    assert [(r.c, r.s, r.e, r.r) for r in rows] == [
        (clean(v), v.strip(), re.findall(EMAIL_PY, v), int(len(v.split()) / 200 * 60)) for v in values]


def test_clean_truncate_validate_names(spark):
    assert run(spark, ["  Many   blanks\nand\tbreaks  ", None, "Éa ñ², x#"], lambda: text.clean_text("v")) == [
        "Many blanks and breaks", "", "Éa ñ², x"]
    assert run(spark, ["abc", "abcdef"], lambda: text.truncate_text("v", 3)) == ["abc", "abc..."]
    values = ["user@example.com", "first.last@sub.domain.org", "invalid", "@example.com", "user@", "a@b.com\n"]
    assert run(spark, values, lambda: text.email_valid("v")) == [True, True, False, False, False, True]
    parts = run(spark, ["Ada King", " Ada Q. Mary King ", "Cyd", ""], lambda: text.name_parts("v"))
    assert [tuple(p) for p in parts] == [
        ("Ada", "", "King", "Ada King"), ("Ada", "Q. Mary", "King", " Ada Q. Mary King "),
        ("Cyd", "", "", "Cyd"), ("", "", "", "")]


def test_record_id(spark):
    rows = [("", "Jo ", "J@e.com", "u1"), (None, "jo", "j@e.com", "u2"), ("p", "jo", "x", "u3"), ("", "", None, "u4")]
    got = run(spark, rows, lambda: text.record_id("p", "n", "e", "s"), "p string, n string, e string, s string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert got == [sha("jo|j@e.com"), sha("jo|j@e.com"), sha("p"), sha("u4")]


def test_domain_rules(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", " Com.SG", "sg", "edu.cn", "*.ck", "!www.ck", "", None)], "rule string")
    cases = {"https://a.b.com.sg/x": "b.com.sg", "x.uni.edu.cn": "uni.edu.cn", "http://p.q.ck:80": "p.q.ck", "http://q.ck": ".q.ck", "http://www.ck": "www.ck",
             "http://shop.WWW.ck.": "WWW.ck", "http://u@n.m.sg": "m.sg", "http://10.1.2.3/": "10.1.2.3.", "localhost": "localhost.", "com": ".com", "": ".", None: None}
    urls = spark.createDataFrame([(u, 1) for u in cases] * 2, "url string, rule int")
    got = domains.with_registered_domain(urls, rules).collect()
    assert len(got) == 2 * len(cases) and {r.url: r.domain for r in got} == cases
    none = domains.with_registered_domain(urls.where("url = 'localhost'"), rules.limit(0))
    assert {r.domain for r in none.collect()} == {"localhost."}

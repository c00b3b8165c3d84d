import pytest
from pyspark.sql import functions as F

from rosterline.operators import dedup, quality, ranking
from rosterline.operators.schema import PERSON, RecordSchema, apply_schema, missing_required, validate_records

RECORDS = [
    ("Ada King", "ada@mail.org", "Botanist", "https://dir.org/ada"),
    ("Bea Long", "bea@mail.org", "Welder", "https://dir.org/bea"),
    ("Ada King", "ada@mail.org", "Botanist", "https://dir.org/ada"),
    ("Cyd Marsh", "no address", "", "https://dir.org/cyd"),
    ("Dee Stone", "", "Baker", ""),
]
COLS = "name string, email string, title string, page_url string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RECORDS)], "seq bigint, " + COLS)


def test_report(people):
    records = people.drop("seq")
    rows = {(r.section, r.field, r.metric): (r.value, r.status) for r in quality.quality_report(records).collect()}
    assert rows["overview", "", "total_records"][0] == 5
    assert rows["overview", "", "duplicates"][0] == 1 and rows["overview", "", "unique_records"][0] == 4
    assert rows["overview", "", "duplicate_rate"][0] == pytest.approx(0.2)
    assert rows["completeness", "name", "percent"] == (100.0, "✅")
    assert rows["completeness", "title", "percent"] == (80.0, "⚠️")
    assert rows["validity", "email", "percent"] == (75.0, "❌")
    assert rows["validity", "page_url", "percent"] == (100.0, "✅")
    summary = quality.quality_summary(quality.quality_report(records)).first()
    assert summary.duplicates == 1 and list(summary.field_completeness)[0] == "name"


def test_warnings(people):
    records = people.drop("seq")
    got = [r.warning for r in quality.quality_warnings(records, expected_min=10, expected_max=4).orderBy("ord").collect()]
    assert got == [
        "Found 1 duplicates (20.0%) based on ['name', 'email']", "Low completeness for 'page_url': 80.0%",
        "Email validity: 75.0% (3/4)", "Very low record count: 5 (expected more for directory scraping)",
        "Record count 5 is below expected minimum 10 (difference: 5, 50.0%)",
        "Record count 5 is above expected maximum 4 (difference: 1, 25.0%)"]


def test_empty_input(people):
    report = {r.metric: r.value for r in quality.quality_report(people.drop("seq").where("false")).collect()}
    assert report == {"total_records": 0, "unique_records": 0, "duplicates": 0, "duplicate_rate": 0}


def test_tolerance(spark):
    ok = lambda n: quality.count_within_tolerance(spark.range(n), 6297).first()
    assert [ok(n).passed for n in (6300, 6297, 6250, 5000, 7000)] == [True, True, True, False, False]
    assert (ok(1).low, ok(1).high) == (5983, 6611)


def test_dedup(people, spark):
    kept = dedup.dedup_by_keys(people, ["name", "email"]).orderBy("seq")
    assert [r.seq for r in kept.collect()] == [0, 1, 3, 4]
    odd = spark.createDataFrame(
        [(0, "a", ""), (1, "", "a"), (2, None, ""), (3, "", None), (4, " A ", None)], "seq bigint, x string, y string")
    assert sorted(r.seq for r in dedup.dedup_by_keys(odd, ["x", "y"]).collect()) == [0, 2, 3]


def test_dedup_cuts_groups_before_the_shuffle(people):
    plan = dedup.dedup_by_keys(people, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dedup_record_id(spark):
    df = spark.createDataFrame(
        [(0, "u", "A", "", "s", 0.8), (1, "u", "B", "", "s", 0.9), (2, "", "C", "c@d.e", "s", 0.8),
         (3, "", "c ", "C@d.e", "t", 0.8)],
        "seq bigint, page_url string, name string, email string, source_url string, confidence double")
    assert sorted(r.seq for r in dedup.dedup_record_id(df).collect()) == [0, 2]
    assert sorted(r.seq for r in dedup.dedup_record_id(df, prefer="confidence").collect()) == [1, 2]


def test_ranks_and_cuts(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(5)
    ranked = ranking.with_global_rank(df, ["k"]).collect()
    assert sorted((r.k, r["rank"]) for r in ranked) == [(i, i) for i in range(1000)]
    assert sorted(r.k for r in ranking.first_n(df, ["k"], 20).collect()) == list(range(20))
    small, large = ranking.sample_n(df, 5, ["k"], 3).collect(), ranking.sample_n(df, 6, ["k"], 3).collect()
    assert len(small) == 5 and {r.k for r in small} < {r.k for r in large}
    assert ranking.sample_n(df, 5000, ["k"]).count() == 1000


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "date", "timestamp", "boolean", "binary", "decimal(20,3)", "array<bigint>"])
def test_first_n_is_exact_for_any_kind(spark, kind):
    made = {"bigint": "id * 7919 % 3001 - 1500", "double": "CASE id % 50 WHEN 0 THEN double('NaN') WHEN 1 THEN double('-Infinity') ELSE id / 7.0d END",
            "string": "CASE id % 40 WHEN 0 THEN '' ELSE concat(char(int(id * 31 % 255)), 'ü', id) END", "date": "date_add(date'2020-01-01', int(id * 13 % 900))",
            "timestamp": "timestamp_seconds(id * 7919 % 3001)", "boolean": "id % 3 = 0", "binary": "encode(concat(id * 7 % 100, 'x'), 'UTF-8')",
            "decimal(20,3)": "id * 7919 % 3001 / 3", "array<bigint>": "array(id % 5)"}[kind]
    df = spark.range(3000).select(F.expr(f"CAST(CASE WHEN id % 60 = 7 THEN NULL ELSE {made} END AS {kind})").alias("k"), "id").repartition(5)
    for n in (0, 1, 45, 1700, 3000, 5000):
        want = df.orderBy("k", "id").limit(n).select("id").collect()
        assert {r.id for r in ranking.first_n(df, ["k", "id"], n).collect()} == {r.id for r in want}, n


def test_first_n_stores_little_more_than_n(spark, monkeypatch):
    stored = []
    keep = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df: (out := keep(df), stored.append(out.count()))[0])
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("k"))
    assert ranking.first_n(df, ["k"], 1000).count() == 1000
    assert max(stored) < 2000
    # A bound that falls short is widened.
    monkeypatch.setattr(ranking, "_SLACK", -0.004)
    monkeypatch.setattr(ranking, "_widen", lambda slack: slack + 0.003)
    assert sorted(r.k for r in ranking.first_n(df, ["k"], 1000).collect()) == sorted(r.k for r in df.orderBy("k").limit(1000).collect())


def test_schema(spark):
    schema = RecordSchema.of('{"name": "str", "n": "int?", "ok": "bool?", "site": "url?"}')
    df = apply_schema(spark.createDataFrame([("A", "7", "x"), (None, "z", "y")], "name string, n string, extra string"), schema)
    assert [tuple(r) for r in df.orderBy("n").collect()] == [("", None, None, "", "y"), ("A", 7, None, "", "x")]
    assert df.schema["site"].metadata["semantic"] == "url" and df.schema["name"].metadata["required"]
    assert PERSON.is_required("name") and not PERSON.is_required("title") and not PERSON.is_required("nope")
    with pytest.raises(ValueError):
        RecordSchema.of({"a": "float"})


def test_validate_and_missing(spark):
    schema = RecordSchema.of({"fields": [
        {"name": "name", "type": "str", "pattern": "^[A-Z]"}, {"name": "email", "type": "email?"},
        {"name": "page_url", "type": "url"}, {"name": "age", "type": "int?"}]})
    df = spark.createDataFrame([("Al", "", "https://e.com", "x"), ("al", "bad", "ftp://e", "4"), ("", None, None, None)],
                               "name string, email string, page_url string, age string")
    got = [r.violations for r in validate_records(df, schema).collect()]
    assert sorted(got, key=len) == [
        ["age: not int"], ["name: missing", "page_url: missing"],
        ["name: pattern", "email: not email", "page_url: not url"]]
    types = {f.name: f.dataType for f in df.schema.fields}
    assert df.where("name = ''").select(missing_required(schema, types).alias("m")).first().m == ["name", "page_url"]

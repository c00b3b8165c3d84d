"""Every registered query against its SQL on the smallest data set. Whole crawls have their own tests."""

import os

import pytest

import __spark_entry__ as entry
import oracle_check

SF = f"{oracle_check.DATA}/sf0.001"
#: Queries that come with the training-data operators have tests of their own.
OWN_TESTS = {key for key, fn in entry.queries().items() if fn.__module__.startswith(("rosterline.llm", "corpus_pipeline"))}
CRAWLS = OWN_TESTS | {"crawl_replay", "crawl_limits", "crawl_output", "crawl_chain", "run_stats"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_query_has_its_sql():
    assert set(entry.queries()) - OWN_TESTS <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(set(entry.queries()) - CRAWLS))
def test_query_matches_sql(spark, key):
    verdict, _, _ = oracle_check.compare(spark, SF, key, entry.queries(), entry.oracle_sql())
    assert verdict == "ok"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

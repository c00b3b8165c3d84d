import pyarrow as pa
from pyspark.sql import functions as F

from rosterline.functions import html as H
from rosterline.operators.ranking import with_order_id
from rosterline.session import BucketedTable


def test_a_batch_is_parsed_in_bounded_parts():
    pages = pa.array(["<p>a</p>" * (k % 5) for k in range(500)] + [None, "<b>" + "x" * (2 * H.PART_CHARS) + "</b>", "", "<i>é</i>"])
    found = list(H._page_dom.func(iter([pages, pages.slice(0, 0), pages.slice(3, 2)])))
    assert max(len(part) for part in found) <= H.PART_PAGES
    assert max(sum(len(t) for t in part.field("text").to_pylist()) for part in found if len(part) > 1) <= H.PART_CHARS
    whole = H.dom_array(pages).to_pylist()
    assert [row for part in found for row in part.to_pylist()] == whole + whole[3:5]


def test_plain_pages_give_the_parsers_tree():
    pages = [
        "<!DOCTYPE html><html lang='en'><head><title>a &amp; b</title><script>if (a < b) x('</p>')</script></head><body><p>x &lt; y<br/>z<p class=\"q\" hidden>w</body></html>",
        "<UL><LI ID=\"a\" id=\"b\">1<LI>2</UL><!-- note --><input disabled/><img src=\"i\"/>&amp",
    ]
    odd = ["<b class=x>1</b>", "<a href='?a=1&amp;b'>2</a>", "<a href=\"x\"title=\"y\">3</a>", "a <b", "<!---->c", "<textarea><b></textarea>", "<script>var a = '<!--<script>'</script>d"]
    for html in pages + odd:
        tree = H._Tree()
        tree.feed(html)
        tree.close()
        tree._ensure_body()
        tree._pop_to(0)
        assert H.build_tree(html) == ("".join(tree.chunks), tree.nodes), html
    assert [H._feed_plain(H._Tree(), html) for html in pages + odd] == [True] * len(pages) + [False] * len(odd)


def test_small_steps_take_few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ranked = with_order_id(spark.range(0, 40, 1, 8), ["id"], expand=lambda df: df.select("id", F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("k")))
        assert ranked.rdd.getNumPartitions() < 64
        assert [(r.id, r.k) for r in ranked.orderBy("rank").collect()] == [(i, k) for i in range(40) for k in range(i % 3 + 1)]
        held = BucketedTable(spark, "id")
        held.append(spark.range(50))
        held.append(spark.range(50, 70))
        assert sorted(r.id for r in held.close().collect()) == list(range(70))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_an_unclosed_script_takes_linear_time():
    assert not H._feed_plain(H._Tree(), "<script>" + "a b " * 20_000 + "< c" * 2000)

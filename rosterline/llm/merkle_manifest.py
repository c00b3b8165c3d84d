"""Merkle manifest of a dataset: blocks of leaves hash their own subtree, then swap roots in a butterfly exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm.common import store
from rosterline.operators.ranking import with_global_rank


@dataclass(frozen=True)
class Shape:
    """Children of a node, and the levels (at least 1) of the subtree that one block hashes by itself: ``fanout ** levels`` leaves."""

    fanout: int = 3
    levels: int = 6

    def __post_init__(self):
        if self.fanout < 2 or self.levels < 1:
            raise ValueError("a node has two children at least, a block one level")

    @property
    def block(self) -> int:
        return self.fanout**self.levels


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value (integers in decimal)."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def with_positions(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``grp``, ``id``, ``leaf``, more) plus ``pos``: the place within the group by id, then leaf; nulls first.

    One sort by range, whose last key splits even equal rows. A row's place follows from where its group starts in the row's
    own partition and how many of the group lie in earlier ones; a pair of partition and group has a partition's rows at most.
    """
    partitions = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("_tie")]
    placed = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = store(placed.drop("_tie").withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    runs = placed.groupBy("_part", "grp").agg(F.count("leaf").alias("rows"), F.min("_place").alias("start"))
    before = F.sum("rows").over(Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("_part").alias("p"), F.col("grp").alias("g"), (F.col("start") - F.coalesce(before, F.lit(0))).alias("zero"))
    placed = placed.join(runs, (F.col("_part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return placed.withColumn("pos", F.col("_place") - F.col("zero")).drop("_place", "_part", "p", "g", "zero")


def subtrees(leaves: DataFrame, shape: Shape, carry: list[str]) -> DataFrame:
    """``(grp, block, rows, tree)``: a row per aligned block of leaves; ``tree`` holds the hashes of each level, leaves first.

    Blocks reach full height, hashing lone nodes too, except a group's only one, which ends where one node remains.
    """
    rows = F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", *carry)))
    blocks = leaves.withColumn("block", F.floor(F.col("pos") / shape.block)).groupBy("grp", "block").agg(rows.alias("rows"))
    fanout = shape.fanout

    def above(tree: Column, _: Column) -> Column:
        low = F.element_at(tree, -1)
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(low) - 1) / fanout).cast("int")), lambda k: _node(F.slice(low, k * fanout + 1, fanout)))
        return F.when((F.size(low) == 1) & (F.col("block") == 0), tree).otherwise(F.concat(tree, F.array(runs)))

    first = F.array(F.transform("rows", lambda r: r["leaf"]))
    return blocks.withColumn("tree", F.aggregate(F.sequence(F.lit(1), F.lit(shape.levels)), first, above))


def butterfly(nodes: DataFrame, fanout: int) -> DataFrame:
    """From ``nodes`` (``grp``, ``at`` from 0 without gaps, ``root``): ``(grp, at, root, up)``, each node with its group's root
    and its own proof, ``up``: what is hashed before and after it, level by level.

    In a round that joins subtrees of w nodes, the nodes at the same place of the subtrees of a run swap their roots, so a
    message goes to a run of at most ``fanout`` and each hashes the parent by itself; nothing has to be sent down afterwards.
    In a last, smaller subtree the nodes there stand in for the missing ones: at most as many messages again. Each round
    is stored; their number is the logarithm of the largest group.
    """
    many = nodes.groupBy(F.col("grp").alias("g")).agg(F.count("root").alias("n"))
    none = F.lit([]).cast("array<struct<before:string,after:string>>")
    state = store(nodes.join(many, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "at", "n", "root", none.alias("up")))
    most, width = state.agg(F.max("n")).first()[0] or 0, 1
    while width < most:
        state = store(_round(state, width, fanout))
        width *= fanout
    return state.select("grp", "at", "root", "up")


def _round(state: DataFrame, width: int, fanout: int) -> DataFrame:
    w = F.lit(width).cast("long")
    state = state.withColumn("tree", F.floor(F.col("at") / w)).withColumn("place", F.col("at") % w)
    held = F.least(w, F.col("n") - F.col("tree") * w)  # nodes of this subtree
    digit = F.col("tree") % fanout
    # Places of the run that this node speaks for: its own, and those that its subtree lacks.
    spoken = F.when((held < w) & (digit > 0), F.sequence(F.col("place"), w - 1, held)).otherwise(F.array("place"))
    sent = state.select("grp", "n", F.floor(F.col("tree") / fanout).alias("run"), F.col("place").alias("own"), F.explode(spoken).alias("place"),
                        digit.cast("int").alias("digit"), "root", "at", "up")
    member = F.struct("digit", "root", (F.col("own") == F.col("place")).alias("here"), "at", "up")
    met = sent.groupBy("grp", "n", "run", "place").agg(F.sort_array(F.collect_list(member)).alias("met"))

    def sides(e: Column) -> Column:
        part = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: x["root"]), "")
        return F.struct(part(lambda x: x["digit"] < e["digit"]).alias("before"), part(lambda x: x["digit"] > e["digit"]).alias("after"))

    joined = F.transform(F.filter("met", lambda e: e["here"]), lambda e: F.struct(
        e["at"].alias("at"),
        F.when(F.col("n") > w, _node(F.transform("met", lambda x: x["root"]))).otherwise(e["root"]).alias("root"),
        F.when(F.col("n") > w, F.concat(e["up"], F.array(sides(e)))).otherwise(e["up"]).alias("up")))
    return met.select("grp", "n", F.inline(joined)).select("grp", "at", "n", "root", "up")


def manifest(leaves: DataFrame, shape: Shape = Shape(), carry: list[str] | None = None) -> DataFrame:
    """From ``leaves`` (``grp``, ``id``, ``leaf``, and the columns of ``carry``): ``(id, grp, leaf, carry, subroot, root, path)``.

    A group's leaves stand by id (nulls first; rows of equal id by leaf, equal rows each on their own); while several nodes
    remain, every ``fanout`` consecutive ones become the hash of their digests. Groups' roots, by group (null first, UTF-8
    bytewise), become the root alike. ``path`` holds per level the digests before and after the own one, from leaf to root.
    Leaves are all that is moved, never texts; a group that holds a third of all rows is many blocks. An empty table
    gives no rows.
    """
    carry = carry or []
    blocks = store(subtrees(with_positions(leaves.select("grp", "id", "leaf", *carry)), shape, carry))
    tops = blocks.select("grp", F.col("block").alias("at"), F.element_at(F.element_at("tree", -1), 1).alias("root"))
    inner = butterfly(tops, shape.fanout)
    roots = inner.where("at = 0").select(F.col("grp").alias("name"), "root")
    ranked = with_global_rank(roots, [F.col("name").asc_nulls_first()], "at")
    outer = butterfly(ranked.select(F.lit(0).alias("grp"), "at", "root"), shape.fanout)
    named = store(ranked.select("name", F.col("at").alias("k"), F.col("root").alias("subroot")).join(
        outer.select(F.col("at").alias("k"), "root", F.col("up").alias("over")), "k").drop("k"))
    proofs = inner.select("grp", "at", "up").join(named, F.col("grp").eqNullSafe(F.col("name")))
    proofs = proofs.select(F.col("grp").alias("g"), "at", "subroot", "root", F.concat("up", "over").alias("up"))
    found = blocks.join(proofs, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("at")))

    fanout = shape.fanout
    powers = F.array(*[F.lit(fanout**k) for k in range(shape.levels + 1)])

    def step(level: Column, k: Column) -> Column:
        """What stands beside the ``k``-th leaf's ancestor on a level."""
        nodes = F.get("tree", level)
        of = F.floor(k / F.get(powers, level)).cast("int")
        start, digit = of - of % fanout, of % fanout
        return F.struct(F.array_join(F.slice(nodes, start + 1, digit), "").alias("before"),
                        F.array_join(F.slice(nodes, start + digit + 2, fanout - 1 - digit), "").alias("after"))

    heights = F.filter(F.sequence(F.lit(0), F.lit(shape.levels)), lambda x: x < F.size("tree") - 1)
    rows = F.transform("rows", lambda r, k: F.struct(
        r["id"].alias("id"), r["leaf"].alias("leaf"), *[r[c].alias(c) for c in carry],
        F.concat(F.transform(heights, lambda level: step(level, k)), F.col("up")).alias("path")))
    return found.select("grp", "subroot", "root", F.inline(rows)).select("id", "grp", "leaf", *carry, "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all digests of a path, from leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def verified_documents(docs: DataFrame, shape: Shape = Shape(), doc_id: str = "doc_id", source: str = "source", lang: str = "lang",
                       n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row per document.

    The leaf hashes all five columns. The check folds the leaf of a copy in which every document whose decimal id has an even
    CRC-32 lost its line feeds (a null id has none, so that row is not altered); only texts with line feeds then fail.
    Null values are leaves of their own kind, apart from empty ones; whole texts are hashed where they lie; extra columns
    are passed over. The rest is as ``manifest`` says.
    """
    c = {k: docs[v] for k, v in (("doc_id", doc_id), ("source", source), ("lang", lang), ("n_chars", n_chars), ("text", text))}
    even = F.crc32(c["doc_id"].cast("string").cast("binary")) % 2 == 0
    altered = F.when(even, F.replace(c["text"], F.lit("\n"), F.lit(""))).otherwise(c["text"])
    head = [c[k] for k in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(c["source"].cast("string").alias("grp"), c["doc_id"].alias("id"), leaf_hash(*head, c["text"]).alias("leaf"),
                         leaf_hash(*head, altered).alias("altered"))
    found = manifest(leaves, shape, ["altered"])
    found = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                         folded(F.col("altered"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import Forest, binary_matrix, group_ends, map_batches, map_groups, row_pairs, store, with_block_pairs
from rosterline.llm.components import components


@dataclass(frozen=True)
class Hashing:
    """Tables of ``projections`` Gaussian projections, cut into cells of ``width``.

    Unit vectors of cosine c lie sqrt(2 - 2c) apart. At 0.93 one projection keeps a pair together with probability 0.80,
    a table with 0.33 and 26 tables with 0.99997, in any dimension; unrelated vectors (1.41 apart) meet in 0.8 % of a table's cells.
    """

    tables: int = 26
    projections: int = 5
    width: float = 1.5
    seed: int = 7
    #: Vectors of one cell that meet in a task; larger cells are compared block by block.
    block: int = 1000


def unit_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``(rep, label, many, unit)``: one row per label and distinct vector; those that link with nothing are left out."""
    plain = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"),
                           vectors[embedding].cast("array<double>").alias("v"))
    sound = plain.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return sound.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("v").alias("many"))


def _units(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def cells(unit: np.ndarray, hashing: Hashing) -> np.ndarray:
    """Four bytes for each unit vector's cell in each table."""
    dim, count = unit.shape[1], hashing.tables * hashing.projections
    rng = np.random.default_rng([hashing.seed, dim])
    lines, shift = rng.standard_normal((dim, count)), rng.uniform(0, hashing.width, count)
    mix = rng.integers(1, 1 << 62, hashing.projections) * 2 + 1
    cell = np.floor((unit @ lines + shift) / hashing.width).astype(np.int64)
    key = (cell.reshape(len(unit), hashing.tables, -1) * mix).sum(axis=2)
    return (key ^ (key >> 32)).astype(np.int32)


def similar_vectors(vectors: DataFrame, threshold: float = 0.93, hashing: Hashing = Hashing(),
                    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Linked are vectors of equal, non-null label and equal dimension whose cosine in double precision reaches ``threshold``.
    Equal vectors are folded first and counted with their number, so a vector that fills a third of the table costs one
    row. The rest meet in the cells of any table; a cell's pairs are compared in blocks inside tasks, each pair in the first
    table where it meets, and tasks send counts and spanning forests, never pairs. Vectors travel in single precision where
    that holds their values exactly, and are scaled to length 1 in double precision where they meet. Null, zero and non-finite vectors, and
    those with null label or id, link with nothing; repeated ids are counted as vectors of their own. A component's id is
    its smallest ``vec_id``. An empty table gives no rows.
    """
    reps = store(unit_vectors(vectors, vec_id, embedding, label))

    def hashed(batch: dict):
        values = [np.asarray(v, np.float64) for v in batch["v"]]
        out: dict[str, list] = {k: [] for k in ("rep", "label", "many", "dim", "raw", "cells")}
        by_dim: dict[int, list[int]] = {}
        for k, v in enumerate(values):
            by_dim.setdefault(len(v), []).append(k)
        for dim, rows in by_dim.items():
            plain = np.stack([values[k] for k in rows])
            unit = _units(plain)
            with np.errstate(over="ignore"):
                short = plain.astype(np.float32)
            exact = (short == plain).all(axis=1)
            keys = cells(unit, hashing)
            out["rep"] += [batch["rep"][k] for k in rows]
            out["label"] += [batch["label"][k] for k in rows]
            out["many"] += [batch["many"][k] for k in rows]
            out["dim"] += [dim] * len(rows)
            out["raw"] += [(a if e else b).tobytes() for a, b, e in zip(short, plain, exact)]
            out["cells"] += [c.tobytes() for c in keys]
        yield out

    posted = map_batches(reps.select("rep", "label", "many", "v"), hashed,
                         "rep long, label string, many long, dim int, raw binary, cells binary")
    # Four bytes of a table's cell are its key: with label, dimension and table.
    posted = posted.select("*", F.explode(F.sequence(F.lit(0), F.lit(hashing.tables - 1))).alias("t"))
    posted = posted.withColumn("cell", F.substring("cells", F.col("t") * 4 + 1, F.lit(4)))
    posted = posted.withColumn("key", F.xxhash64("label", "dim", "t", "cell"))
    sizes = posted.groupBy("key").agg(F.count("rep").alias("size")).where("size > 1")
    # The vector and its cells in all tables travel with the row; nothing is looked up afterwards.
    together = with_block_pairs(posted.join(sizes, "key"), F.col("size"), hashing.block, F.col("rep"))

    def compare(table: pa.Table):
        # Vectors of several dimensions may follow each other; their groups never mix.
        dims = table.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = table.filter(pa.array(dims == dim)) if (dims != dim).any() else table
            yield from compare_one(part, int(dim))

    def compare_one(table: pa.Table, dim: int):
        column = lambda name: table.column(name).to_numpy()
        key, bi, bj, rep, many, tab = (column(n) for n in ("key", "bi", "bj", "rep", "many", "t"))
        unit = np.empty((len(rep), dim))
        wide = pc.binary_length(table.column("raw")).to_numpy() > 4 * dim
        for mask, dtype in ((wide, np.float64), (~wide, np.float32)):
            if mask.any():
                unit[mask] = _units(binary_matrix(table.column("raw").filter(pa.array(mask)), dtype, dim).astype(np.float64))
        own = binary_matrix(table.column("cells"), np.int32, hashing.tables)
        ends = group_ends(key, bi, bj)
        label = np.unique(np.asarray(table.column("label").to_pylist(), object).astype(str), return_inverse=True)[1]
        counts, forest, edges = np.zeros(len(rep), np.int64), Forest(len(rep)), ([], [])
        before = np.arange(hashing.tables)
        for i, j in row_pairs(ends, column("side"), bi != bj, 1 << 15):
            # A pair counts in the first table where its cells agree.
            first = ~((own[i] == own[j]) & (before < tab[i][:, None])).any(axis=1) & (label[i] == label[j]) & (tab[i] == tab[j])
            i, j = i[first], j[first]
            linked = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            i, j = i[linked], j[linked]
            np.add.at(counts, i, many[j])
            np.add.at(counts, j, many[i])
            i, j = forest.apart(i, j)
            for a, b in zip(i.tolist(), j.tolist()):
                if forest.join(a, b):
                    edges[0].append(rep[a])
                    edges[1].append(rep[b])
        has = np.flatnonzero(counts)
        a = np.concatenate([rep[has], np.array(edges[0], np.int64)])
        b = np.concatenate([rep[has], np.array(edges[1], np.int64)])
        yield {"a": a, "b": b, "n": np.concatenate([counts[has], np.zeros(len(edges[0]), np.int64)])}

    found = store(map_groups(together.select("key", "bi", "bj", "side", "rep", "label", "many", "dim", "raw", "cells", "t"),
                             ["key", "bi", "bj"], compare, "a long, b long, n long"))
    roots = components(found.where("a <> b").select("a", "b"))
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    facts = reps.select("label", "v", "rep", "many").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    facts = facts.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"),
                          vectors[embedding].cast("array<double>").alias("v"))
    out = rows.join(facts, (rows["label"] == facts["label"]) & (rows["v"] == facts["v"]) & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce(facts["component_id"], rows["vec_id"])
    return out.select(rows["vec_id"], F.coalesce(facts["n_links"], F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(rows["vec_id"] == component, F.lit(False)).alias("kept"))

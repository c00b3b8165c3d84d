"""What the operators share: stored tables, Arrow stages, block pairs and per-process objects."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.session import ensure_checkpoint_dir


def store(df: DataFrame) -> DataFrame:
    """Write once as Parquet in the shared checkpoint folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rosterline-llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give what a finished task no longer holds back to the system: workers live on, and other stages need their memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def one_blas_thread() -> None:
    """Let this worker's matrix products take one thread: tasks already fill the cores, and further threads wait busily.

    Spark gives workers as many threads as an executor has cores; OpenBLAS reads that when it is loaded, so it is told here.
    """
    process_object("one BLAS thread", _set_one_blas_thread)


def _set_one_blas_thread() -> bool:
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split(maxsplit=5)[5].strip() for line in maps if "openblas" in line}
        for path in paths:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
    except (OSError, IndexError):
        pass  # not this system
    return True


def process_object(key: str, make: Callable[[], object], grows: bool = False) -> object:
    """One object per Python process. Functions sent by value get new globals in every task, so it is kept in a module.

    Of the objects that grow (caches) a process keeps one; asking for another lets it go.
    """
    held = sys.modules.setdefault("_rosterline_llm_objects", types.ModuleType("_rosterline_llm_objects")).__dict__
    if key not in held:
        if grows:
            held.pop(held.pop("growing", None), None)
            held["growing"] = key
            release_memory()
        held[key] = make()
    return held[key]


def columns_as(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under fixed names, so that further columns can't clash: ``columns_as(df, id="doc_id")``."""
    return df.select(*[df[name].alias(alias) for alias, name in names.items()])


def map_batches(df: DataFrame, fn: Callable[[dict], Iterator[dict] | None], schema: str,
                rows: int = 1000) -> DataFrame:
    """``fn`` gets the columns of at most ``rows`` rows of an Arrow batch as lists and yields columns of output rows."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        one_blas_thread()
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                for out in fn(batch.slice(lo, rows).to_pydict()):
                    yield to_batch(out, target)
        release_memory()

    return df.mapInArrow(run, schema)


def to_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """Bring rows of equal keys together and call ``fn`` with tables of whole groups, several groups at a time.

    A table holds all complete groups of about one Arrow batch, sorted by the keys, so that ``fn`` can work on many small
    groups in one numpy call. Callers bound the groups by splitting large ones into blocks first.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def key_of(table: pa.Table, row: int) -> tuple:
        return tuple(table.column(k)[row].as_py() for k in keys)

    def last_start(table: pa.Table) -> int:
        """Where the table's last group starts."""
        last, low, high = key_of(table, table.num_rows - 1), 0, table.num_rows - 1
        start = high
        step = 1
        while start > 0 and key_of(table, max(0, start - step)) == last:
            start = max(0, start - step)
            step *= 2
        low = max(0, start - step)
        while low < start:
            middle = (low + start) // 2
            low, start = (low, middle) if key_of(table, middle) == last else (middle + 1, start)
        return start

    def run(batches):
        one_blas_thread()
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            start = last_start(table)
            if start:
                for out in fn(table.slice(0, start)):
                    yield to_batch(out, target)
            rest = table.slice(start).combine_chunks()
        if rest is not None:
            for out in fn(rest):
                yield to_batch(out, target)
        release_memory()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def with_block_pairs(df: DataFrame, size: Column, block: int, salt: Column) -> DataFrame:
    """Split groups of more than ``block`` rows: adds ``bi``, ``bj`` (the block pair) and ``side`` (the row's own block).

    Every two rows of a group meet in exactly one block pair; a row of a group with n blocks is sent n times.
    """
    blocks = F.greatest(F.lit(1), F.ceil(size / F.lit(block))).cast("int")
    own = F.pmod(F.xxhash64(salt), F.col("_blocks")).cast("int")
    out = df.withColumn("_blocks", blocks).withColumn("side", own)
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return out.withColumn("bi", F.least("side", "_other")).withColumn("bj", F.greatest("side", "_other")).drop("_blocks", "_other")


def group_ends(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by the keys: one past the last row of each row's group."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.concatenate([[0], np.flatnonzero(new), [n]])
    return np.repeat(starts[1:], np.diff(starts))


def row_pairs(ends: np.ndarray, side: np.ndarray, cross: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All row pairs (i, j), i before j, within the groups; in cross blocks only pairs of both sides. Many groups at a time."""
    rows, distance = np.arange(len(ends)), 1
    while True:
        rows = rows[rows + distance < ends[rows]]
        if not len(rows):
            return
        for lo in range(0, len(rows), most):
            i = rows[lo : lo + most]
            j = i + distance
            use = ~cross[i] | (side[i] != side[j])
            if use.any():
                yield i[use], j[use]
        distance += 1


class Forest:
    """Union-find over row numbers. ``join`` is true if it connected two trees; ``apart`` filters pairs of different trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.labels, self.stale = np.arange(n), False

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.stale = True
        return True

    def apart(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.stale:
            labels = np.array(self.up)
            while (labels != (after := labels[labels])).any():
                labels = after
            self.labels, self.stale = labels, False
        use = self.labels[i] != self.labels[j]
        return i[use], j[use]


def binary_matrix(column, dtype, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix, without a Python object per row."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(-1, width) if data.ctypes.data % np.dtype(dtype).itemsize == 0 else data.copy().view(dtype).reshape(-1, width)

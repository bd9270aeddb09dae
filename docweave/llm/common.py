"""Shared pieces of the training-data operators: Arrow tasks, vectorised word hashing, components.

Executors can be lost at any time, so every table that several later jobs read is written to the folder named by
``spark.checkpoint.dir`` and read back (``materialize``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import discard, materialize, ship_package

MASK64 = (1 << 64) - 1
#: Rows that a Python worker handles at once.
SLICE = 1000


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], object]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with a per-task state: ``make()`` runs once in each task and returns batch -> batch(es)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return arrow_tasks(df, run, schema)


def arrow_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` on executors that have this package; batches are cut to ``SLICE`` rows, so that what a worker
    makes of one stays small."""
    ship_package(df.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield batch.slice(at, SLICE)

    return df.mapInArrow(lambda batches: run(sliced(batches)), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------------------------------------------
# vectorised words and hashes
# --------------------------------------------------------------------------------------------------------------
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD_CLASS = (~_SPACE).astype(np.uint8)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (or of its inverse), kept between calls."""
    key = (base, inverse)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        size = 1 << max(12, (n - 1).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < size:  # doubling: out[done:2*done] = out[:done] * b**done
            out[done : 2 * done] = out[:done] * np.uint64(pow(b, done, 1 << 64))
            done *= 2
        _POWERS[key] = have = out
    return have[:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` consecutive values, modulo 2**64."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[width:] - total[:n]) * powers(base, n, True)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: ``hash`` per word, byte ``start`` and ``end`` in ``data``,
    and ``first[i]:first[i+1]`` the words of text i.  With ``classes`` (a table of 256; 0: between words) a word also
    ends where the class changes."""

    __slots__ = ("data", "start", "end", "first", "hash")

    def __init__(self, texts: list[bytes], classes: np.ndarray | None = None):
        data = b" ".join(texts) + b" "
        self.data = data
        raw = np.frombuffer(data, dtype=np.uint8)
        kind = _WORD_CLASS[raw] if classes is None else classes[raw]
        edge = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(raw)]))
        inside = kind[edge[:-1]] != 0
        self.start, self.end = edge[:-1][inside], edge[1:][inside]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, begins)
        total = np.empty(len(raw) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw] * powers(_BASES[0], len(raw)), out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * powers(_BASES[0], len(raw), True)[self.start])


def pieces(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) in runs of about ``limit`` bytes; a null text counts as empty."""
    run: list[bytes] = []
    size = at = 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t
        if run and size + len(b) > limit:
            yield at, run
            run, size, at = [], 0, i
        run.append(b)
        size += len(b) + 1
    if run:
        yield at, run


# --------------------------------------------------------------------------------------------------------------
# connected components
# --------------------------------------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (64-bit node ids): rows (node, root), root the smallest node.

    Alternates large-star and small-star (Kiveris et al. 2014): each round is two partial-aggregated minima and two
    joins on node ids, and ends after the round that changes nothing, which the method's proof puts at the square of the
    logarithm of the number of nodes at most.  Hot centres are joined against one row per node, so adaptive execution
    can split them; nothing is collected but one checksum per round.  The result reads a table in the shared folder.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = materialize(small, "cc")
        mark = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(large)
        discard(e)
        e = small
        if mark == seen:
            break
        seen = mark
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    out._docweave_path = e._docweave_path
    return out


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` if its rows come from files without a shuffle, in one order for each task; else a table of it."""
    return materialize(df, name) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def row_hash(docs: DataFrame):
    """A hash of all columns of a row; maps, which have no order, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(docs[c])) if "map<" in kind else docs[c] for c, kind in docs.dtypes])

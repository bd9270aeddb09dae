"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct 64-bit fingerprint emits all variants within half the radius (radius 2: itself and its 64 one-bit
flips).  Two fingerprints within the radius share a variant, and a variant is emitted by at most 65 fingerprints, so
no shuffle group can grow with the data, whatever the number of copies.  Colliding pairs are deduplicated, verified
by their bit distance and closed into components.

Defined results: a null or wordless text has fingerprint 0 and is linked like any other; equal texts share one
fingerprint row; repeated rows with one doc_id keep one output row each; rows with a null doc_id get a fingerprint
and a component like the others, but never name a component (its id is the smallest non-null doc_id, else null);
texts of any length are read whole; a bit that exactly half the hashes set is 0; an empty table gives an empty result;
other columns are ignored.

Two bits hold nearly equal texts only.  With ``similarity`` the links are all those of that Jaccard similarity of the
shingles: the ball's links are verified by it, and further candidates join those that no ball of a workable radius
reaches (at 0.8 about ten of 64 bits differ): :mod:`.nearcopies`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, nearcopies

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included; bytes are UTF-8."""
    if not text:
        return 0
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    last = ends[shingle - 1 :]
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, last, strict=True)), dtype=">u8", count=n)
    by_byte = h.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row's whole text; fp holds the 64 bits as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_arrow(rows, make, "doc_id long, fp long")


def ball_edges(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) that connect all fingerprints (column fp, distinct) within an even ``radius``.

    All members of a variant's group lie within ``radius`` of each other, so linking each to the next one in order
    keeps every connection; links met in several groups are deduplicated.
    """
    if radius != 2:
        raise ValueError("ball hashing is laid out for radius 2: each group has 65 members at most")
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {i})") for i in range(64)])
    # a small table is a few file splits: spread it before each row becomes 65
    spread = distinct_fps.repartition(int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = spread.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp")
    groups = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select(F.array_sort("fps").alias("fps"))
    pairs = groups.select(F.explode(F.arrays_zip(F.expr("slice(fps, 1, size(fps) - 1)").alias("a"), F.expr("slice(fps, 2, size(fps) - 1)").alias("b"))).alias("p")).select("p.a", "p.b")
    return pairs.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that its links reach, itself included).
    With ``similarity``, links are by the Jaccard similarity of the shingles, and rows without an id are left out."""
    if similarity is not None:
        return nearcopies.near_copies(docs, shingle, similarity, id_col=id_col, text_col=text_col, seed=seed, radius=radius).select("doc_id", "fp", "component_id")
    prints = common.materialize(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    nodes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    linked = common.components(ball_edges(nodes.select("fp"), radius))
    roots = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = common.materialize(roots.join(lows, "root").select("fp", "component_id"), "simhash-named")
    common.discard(nodes)
    common.discard(linked)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

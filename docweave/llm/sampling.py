"""Document fingerprints by consistent weighted sampling (Ioffe 2010).

A text is a bag of words weighted by their counts.  For each of ``samples`` draws every word gets, from its hash
alone, two Gamma(2,1) variables and a uniform one; the word that minimises the sampled 'hash value' is kept with its
quantised weight.  Two texts keep the same pair with a probability equal to their generalised Jaccard similarity
(sum of minima over sum of maxima), so the share of equal entries estimates it.  An entry is stored as 16 bits.

Whole texts are used.  A worker keeps the variables of words it has met in a table of fixed size; a word that stands
once in a text, as most do, needs only what its variables come to at weight 1, which the table holds ready.

Defined results: null, empty and wordless texts have the empty fingerprint, alike (1) to each other and unlike (0)
all others; equal texts have equal fingerprints; rows are ordered by doc_id and then by a hash of the text, a null
doc_id first; of words with one sampled value the one with the smallest hash is taken; the only row of a table is its
own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_U = np.uint64


class Sampler:
    """Signatures of texts; ``slots`` words keep their variables between texts."""

    def __init__(self, samples: int = 64, seed: int = 7, slots: int = 40_000):
        self.samples, self.slots = samples, slots
        self.salts = common.mix64((np.arange(2 * samples, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(seed)).reshape(2, samples)
        self.table = np.empty((slots, 3, samples), dtype=np.float32)  # r, ln c and beta
        self.ready = np.empty((slots, samples), dtype=np.float32)  # what they come to at weight 1
        self.at: dict[int, int] = {}

    def _draw(self, terms: np.ndarray) -> np.ndarray:
        """(terms, [r, ln c, beta], samples)"""
        x = common.mix64(terms[:, None, None] ^ self.salts[None])
        # each hash holds three uniform numbers of 21 bits
        u0, u1, u2 = (((x >> _U(s)) & _U(0x1FFFFF)).astype(np.float32) + np.float32(0.5) for s in (43, 22, 1))
        scale = np.float32(2.0**-21)
        r = -np.log(u0[:, 0] * scale * (u1[:, 0] * scale))
        c = -np.log(u0[:, 1] * scale * (u1[:, 1] * scale))
        return np.stack((np.maximum(r, np.float32(1e-6)), np.log(np.maximum(c, np.float32(1e-6))), u2[:, 0] * scale), axis=1)

    def _places(self, terms: np.ndarray) -> list[int]:
        """Where the tables hold the words; at most 4096 at a time, far fewer than there are slots."""
        keys = terms.tolist()
        if new := [k for k in keys if k not in self.at]:
            if len(self.at) + len(new) > self.slots:
                self.at.clear()
                new = keys
            places = range(len(self.at), len(self.at) + len(new))
            v = self._draw(np.array(new, dtype=_U))
            self.table[places.start : places.stop] = v
            self.ready[places.start : places.stop] = v[:, 1] + v[:, 0] * v[:, 2] - v[:, 0]  # the quantised weight is 0
            self.at.update(zip(new, places, strict=True))
        return [self.at[k] for k in keys]

    def signature(self, text: str | None) -> np.ndarray:
        """``samples`` entries of 16 bits, or none for a text without words."""
        words = common.Words([(text or "").encode("utf-8", "surrogatepass")]).hash
        if not len(words):
            return np.empty(0, dtype=np.uint16)
        terms, counts = np.unique(words, return_counts=True)
        best = np.full(self.samples, np.inf, dtype=np.float32)
        term, at = np.zeros(self.samples, dtype=_U), np.zeros(self.samples, dtype=np.float32)
        one, more = terms[counts == 1], np.flatnonzero(counts > 1)

        def take(own: np.ndarray, a: np.ndarray, level: np.ndarray | None) -> None:
            k = np.argmin(a, axis=0)
            low = np.take_along_axis(a, k[None], 0)[0]
            better = (low < best) | ((low == best) & (own[k] < term))
            best[better], term[better] = low[better], own[k][better]
            at[better] = 0 if level is None else np.take_along_axis(level, k[None], 0)[0][better]

        for s in range(0, len(one), 4096):  # bounded memory for very long texts
            take(one[s : s + 4096], self.ready[self._places(one[s : s + 4096])], None)
        for s in range(0, len(more), 1024):
            own = terms[more[s : s + 1024]]
            v = self.table[self._places(own)]
            r, c, beta = v[:, 0], v[:, 1], v[:, 2]
            t = np.floor(np.log(counts[more[s : s + 1024], None]).astype(np.float32) / r + beta)
            take(own, c - r * (t - beta) - r, t)
        return (common.mix64(term ^ (at.astype(np.int64).astype(_U) * _U(0xC2B2AE3D27D4EB4F))) & _U(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated generalised Jaccard similarity of two signatures of one sampler."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.mean(a == b))


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 64, seed: int = 7) -> DataFrame:
    """(doc_id, fingerprint) of every row's whole text."""

    def make():
        sampler = Sampler(samples, seed)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hex(sampler.signature(t.as_py())) for t in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

        return step

    return common.map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, fingerprint string")


def _cuts(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Lower bounds (k, h) of at most ``parts`` ranges of about equally many rows; a key with more rows than a range
    is cut by the hash h of the text."""
    found = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"] if parts > 1 else None
    out = []
    for k in sorted(set(found or [])):
        n = found.count(k)
        out += [(k, -(1 << 63) + i * ((1 << 64) // n)) for i in range(n)]
    return out


def _dealer(spark, parts: int) -> list[int]:
    """For each of ``parts`` shuffle partitions a number that Spark's hash deals to it."""
    numbers = spark.range(0, 40 * parts, 1, 1).select(F.col("id").cast("int").alias("i"))
    found = numbers.groupBy(F.pmod(F.hash("i"), F.lit(parts)).alias("p")).agg(F.min("i").alias("i")).collect()
    own = {r["p"]: r["i"] for r in found}
    return [own.get(p, 40 * parts + p) for p in range(parts)]


def with_next(docs: DataFrame, pair, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Applies ``pair()``'s function (id, text, next text) -> row values to each row and the next one by (id, hash of
    the text); after the last comes the first.  One shuffle by ranges of these keys, one range to a task; the first row
    of a range is also sent to the range before it, so no row is read alone and no task sees more than its range.
    The bounds of the ranges are data of the tasks, not part of the plan."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(rows, parts)
    numbers = _dealer(spark, parts)
    common.ship_package(spark)

    def ranges(k: pd.Series, h: pd.Series) -> np.ndarray:
        """The number of the last cut at or below each key."""
        own = np.array([c[0] for c in cuts], dtype=np.int64)
        low, high = np.searchsorted(own, k.to_numpy(), "left"), np.searchsorted(own, k.to_numpy(), "right")
        for i in np.flatnonzero(low < high):
            high[i] = bisect.bisect_right(cuts, (int(k.iloc[i]), int(h.iloc[i])))
        return high

    @F.pandas_udf("int")
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranges(k, h))

    keyed = rows.select("k", "h", range_of("k", "h").alias("p"))
    heads = {r["p"]: (r["m"]["k"], r["m"]["h"]) for r in keyed.groupBy("p").agg(F.min(F.struct("k", "h")).alias("m")).collect()}
    order = sorted(heads)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        """The range of a row, and the one before it if the row is the first of its range; as numbers to deal by."""
        out = []
        for p, key in zip(ranges(k, h).tolist(), zip(k.tolist(), h.tolist(), strict=True), strict=True):
            out.append([numbers[p], numbers[before[key]]] if key in before else [numbers[p]])
        return pd.Series(out)

    dealt = rows.select("k", "h", "text", F.posexplode(places("k", "h")).alias("after", "p"))
    dealt = dealt.repartition(parts, "p").sortWithinPartitions("p", "after", "k", "h").select("p", "after", "k", "text")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = pair()
        last = None
        for batch in batches:
            out = []
            ps, after, ks, texts = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                p, nxt, text = ps[i].as_py(), after[i].as_py(), texts[i].as_py()
                if last is not None and last[0] == p:
                    out.append(work(last[1], last[2], text))
                last = None if nxt else (p, ks[i].as_py(), text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    return common.arrow_tasks(dealt, run, schema).withColumn(names[0], F.expr(f"nullif({names[0]}, {-(1 << 63) + 1}L - 1L)"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprints of every document and of its edited text, and their likeness to it and the next document."""

    def pair():
        sampler = Sampler()
        kept: list = [None, None]  # the text met last and its signature

        def work(doc_id: int, text: str | None, after: str | None):
            text, after = text or "", after or ""
            own = kept[1] if kept[0] == text else sampler.signature(text)
            n = len(text)
            edited = text[: n - n // 2] + after[: n // 2]
            changed = own if edited == text else sampler.signature(edited)
            kept[:] = after, own if after == text else sampler.signature(after)
            return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(own), _hex(changed), likeness(own, changed), likeness(own, kept[1])

        return work

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(common.table(spark, sf_dir, "documents"), pair, schema)

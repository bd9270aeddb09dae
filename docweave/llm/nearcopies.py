"""Near copies by SimHash and Jaccard similarity: the mode of op5 that goes beyond the radius of its ball.

A text is the set of its different runs of ``shingle`` lower-cased words (a shorter one is its whole run).  Texts of one
set are one node.  Candidates come from three steps:

1. op5's own method: the 64-bit SimHash of a text's runs, and ball hashing of the different fingerprints.  Nodes of one
   fingerprint are held each against the next one, and fingerprints within two bits by a node of either.
2. Two bits hold nearly equal texts only (at 0.8 about ten of 64 differ).  So ``bands`` hashes of ``rows`` minima each put
   a node into that many groups; two nodes of similarity s share one with probability 1 - (1 - s**rows)**bands (0.9996 at
   0.8).  The members of all groups are sorted by group and then by further minima, and each is held against the next
   ``ahead`` ones, which share the most minima with it.  That is linear work, and joins most copies of a text.
3. In groups that still span several components, an exact prefix filter: with shingles in one order, rare ones first,
   two sets of the similarity share one of the first n - ceil(similarity * n) + 1 shingles of either.  A text that was
   edited a lot has shingles of its own there and meets nobody.  Who shares one is held against the members of other
   components if their lengths and positions allow the similarity (length and positional filter).

All steps verify by the Jaccard similarity of the whole sets, so every link is right, and no link among candidates is
lost that would join two components.

Defined results: null and wordless texts are one set and linked to each other; rows without an id are left out; rows
that share an id are nodes by their own texts and take the component of their own text; texts of any length are read
whole; ties in the sort are in the order of the set's hash; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, SIMILARITY, BANDS, ROWS, AHEAD = 5, 0.8, 20, 5, 2
#: Further minima by which the members of a group are sorted, 16 bits of each.
TAIL = 8


def _shingles(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): first[i]:first[i+1] are the shingles of text i, at least one."""
    words = common.Words([t.lower() for t in texts])
    long = common.rolling(words.hash, shingle, common._BASES[1])
    parts = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        parts.append(long[a : b - shingle + 1] if b - a >= shingle else common.rolling(words.hash[a:b], b - a, common._BASES[1]) if b > a else np.zeros(1, np.uint64))
    first = np.cumsum([0, *map(len, parts)])
    return common.mix64(np.concatenate(parts) ^ np.uint64(_BASE)), first


_BASE = 0xD1B54A32D192ED03


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0x717)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _key(own: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(own.tobytes()))


def _groups(docs: DataFrame, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, key, fp, groups, codes) of every row: the hash of its set, its SimHash, one group for each band, and 16
    bits of each minimum, the first ``TAIL`` once more at the end."""

    def make():
        times, plus = _family(bands * rows)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, texts in common.pieces(batch.column(1).to_pylist()):
                h, first = _shingles(texts, shingle)
                lows = [np.minimum.reduceat(h * a + b, first[:-1]) for a, b in zip(times, plus, strict=True)]
                groups = np.empty((len(texts), bands), dtype=np.uint64)
                codes = np.empty((len(texts), bands * rows + TAIL), dtype=">u2")
                for k in range(bands):
                    g = np.full(len(texts), k + 1, dtype=np.uint64)
                    for low in lows[k * rows : (k + 1) * rows]:
                        g = common.mix64(g * np.uint64(_BASE) ^ low)
                    groups[:, k] = g
                for k in range(bands * rows + TAIL):
                    codes[:, k] = common.mix64(lows[k % (bands * rows)]) >> np.uint64(48)
                keys = [_key(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
                fps = np.array([simhash.fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
                flat = pa.array(groups.reshape(-1).view(np.int64))
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands)
                columns = [batch.column(0).slice(at, len(texts)), pa.array(keys, pa.int64()), pa.array(fps.view(np.int64)), pa.ListArray.from_arrays(offsets, flat), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "groups", "codes"])

        return step

    return common.map_arrow(docs, make, "doc_id long, key long, fp long, groups array<long>, codes binary")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, own) of the rows (doc_id, text, key): the sorted set, 32 bits of each shingle."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            wanted = batch.column(2).to_pylist()
            for at, texts in common.pieces(batch.column(1).to_pylist()):
                h, first = _shingles(texts, shingle)
                keys, own = [], []
                for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    one = np.unique(h[a:b])
                    if _key(one) == wanted[at + i]:  # rows of one id can have different texts
                        keys.append(wanted[at + i])
                        own.append(np.unique(one.view(np.int64) >> 32).astype(np.int32))
                if keys:
                    offsets = pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own)))], ["key", "own"])

        return step

    return common.map_arrow(docs, make, "key long, own array<int>")


def _neighbours(member: DataFrame, ahead: int) -> DataFrame:
    """Pairs (a, b) of members (group, tail, key) of one group, at most ``ahead`` places apart in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = np.empty(0, np.int64), np.empty(0, np.int64)  # the last rows of the batch before
        for batch in batches:
            old = len(key)
            group, key = np.concatenate((group, batch.column(0).to_numpy())), np.concatenate((key, batch.column(1).to_numpy()))
            for far in range(1, min(ahead, len(key) - 1) + 1):
                at = np.flatnonzero(group[far:] == group[:-far])
                at = at[at + far >= old]
                a, b = key[at], key[at + far]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            group, key = group[-ahead:], key[-ahead:]

    ordered = member.repartitionByRange("group", "tail", "key").sortWithinPartitions("group", "tail", "key")
    return common.arrow_tasks(ordered.select("group", "key"), run, "a long, b long")


def _ball(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes by their SimHash: neighbours in one fingerprint, and a node of each of two fingerprints that
    ball hashing links."""
    spots = common.materialize(prints.select("fp", "key").distinct(), "near-spots")
    first = common.materialize(spots.groupBy("fp").agg(F.min("key").alias("key")), "near-firsts")
    edges = simhash.ball_edges(first.select("fp"), radius).withColumnsRenamed({"a": "x", "b": "y"})
    near = edges.join(first.select(F.col("fp").alias("x"), F.col("key").alias("kx")), "x").join(first.select(F.col("fp").alias("y"), F.col("key").alias("ky")), "y")
    near = near.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"))
    same = _neighbours(spots.select(F.col("fp").alias("group"), F.lit(0).alias("tail"), "key"), 1)
    pairs = common.materialize(near.filter("a <> b").unionByName(same).distinct(), "near-ball")
    common.discard(spots)
    common.discard(first)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity; a table."""
    met = pairs.distinct().join(sets.select(F.col("key").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("own").alias("own_b")), "b").select("a", "b", "own_a", "own_b")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                small, large = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if small >= similarity * large else 0
                keep.append(both >= similarity * (len(x) + len(y) - both))
            return batch.select(["a", "b"]).filter(pa.array(keep))

        return step

    return common.materialize(common.map_arrow(met, make, "a long, b long"), "near-links")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(s, key, n, pos): the shingles in the prefix of each set of n, and their places in the order, of those that
    stand in two sets or more.  The order is by the number of sets that hold a shingle, then by the shingle."""
    held = sets.select("key", F.size("own").alias("n"), F.explode("own").alias("s"))
    shared = held.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    own = held.join(shared, "s").groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("own"))
    alone = F.col("n") - F.size("own")  # shingles of this set only come first, and meet nobody
    reach = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    first = own.select("key", "n", alone.alias("alone"), F.expr("own").alias("own"), F.greatest(F.lit(0), reach - alone).alias("take")).filter("take > 0")
    return first.select("key", "n", "alone", F.posexplode(F.slice("own", F.lit(1), F.col("take")))).select("col.s", "key", "n", (F.col("pos") + F.col("alone")).alias("pos"))


def _across(prefix: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of different components that share a shingle of both prefixes: in each shingle's group the
    members outside its largest component, each with the members of other components."""
    rooted = prefix.join(linked.select(F.col("node").alias("key"), "root"), "key", "left").select("s", "key", "n", "pos", F.coalesce("root", "key").alias("root"))
    sizes = rooted.groupBy("s", "root").agg(F.count("*").alias("size"))
    spread = sizes.groupBy("s").agg(F.max(F.struct("size", "root"))["root"].alias("major"), F.count("*").alias("roots")).filter("roots > 1").select("s", "major")
    mixed = common.materialize(rooted.join(spread, "s"), "near-mixed")
    x, y = mixed.filter("root <> major").alias("x"), mixed.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.major")) | (F.col("x.key") < F.col("y.key")))
    lengths = (F.col("x.n") >= similarity * F.col("y.n") - 1e-9) & (F.col("y.n") >= similarity * F.col("x.n") - 1e-9)
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    places = rest >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & apart & lengths & places)
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, ahead: int = AHEAD, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, key (the hash of its set), fp (its SimHash), component_id (the smallest doc_id that its links reach,
    itself included) of every row with an id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    prints = common.materialize(_groups(docs, shingle, bands, rows, seed), "near-prints")
    ball = _ball(prints, radius)
    nodes = prints.groupBy("key").agg(F.min("doc_id").alias("low"), F.first("groups").alias("groups"), F.first("codes").alias("codes"))
    nodes = common.materialize(nodes, "near-nodes")
    width = 2 * rows
    tail = F.substring(F.col("codes"), (F.col("band") + 1) * width + 1, F.lit(2 * TAIL))
    each = nodes.select("key", "codes", F.posexplode("groups").alias("band", "group")).select("group", "key", tail.alias("tail"))
    shared = each.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    member = common.materialize(each.join(shared, "group"), "near-groups")  # groups of one node link nothing

    met = member.select("key").unionByName(ball.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    wanted = nodes.join(met, "key", "left_semi").select(F.col("low").alias("doc_id"), "key")
    sets = common.materialize(_sets(docs.join(wanted, "doc_id").select("doc_id", "text", "key"), shingle).dropDuplicates(["key"]), "near-sets")
    close = _verified(ball.unionByName(_neighbours(member, ahead)), sets, similarity)
    common.discard(ball)
    linked = common.components(close)

    rooted = member.select("group", "key").join(linked.select(F.col("node").alias("key"), "root"), "key", "left").select("group", "key", F.coalesce("root", "key").alias("root"))
    mixed = rooted.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("group")
    open_keys = rooted.join(mixed, "group").select("key").distinct()
    prefix = _prefixes(sets.join(open_keys, "key", "left_semi"), similarity)
    rest = _verified(_across(prefix, linked, similarity), sets, similarity)
    common.discard(member)
    common.discard(sets)

    common.discard(linked)
    linked = common.components(close.unionByName(rest))
    roots = nodes.join(linked, nodes["key"] == linked["node"], "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = common.materialize(roots.join(lows, "root").select("key", "component_id"), "near-named")
    common.discard(nodes)
    common.discard(linked)
    return prints.select("doc_id", "key", "fp").join(named, "key").select("doc_id", "key", "fp", "component_id")

"""Substring deduplication: repeated fixed-length token windows, merged into maximal removal intervals.

Every window of ``length`` consecutive words gets a 128-bit Rabin-Karp hash (two 64-bit polynomials over mixed word
hashes) and is counted in Spark by the smallest document id it starts in.  A window is removed from a document when a
smaller document id holds it too, and the removed words of overlapping windows form maximal intervals.

What keeps the shuffle small without dropping a window:
  * rows with one and the same word sequence are represented by the smallest id; the other rows of 'length' words or
    more are removed whole, which is what their windows would say one by one;
  * equal windows have equal minimizers (the least hash of the k-grams inside).  Only minimizers, about one for a
    dozen words, are shuffled for all documents; windows whose minimizer occurs in a single document cannot repeat
    and need no count.  All others are hashed, shuffled and counted one by one.
Counts are minima with map-side combine; a passage held by a third of all documents is one row per task.

Defined results: null and wordless texts have no words and hash as the empty string; a text shorter than a window
keeps all its words; rows that share a doc_id are judged each by its own text, and do not remove each other's words;
a row without doc_id is returned untouched, as no id is smaller or larger; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EMPTY = hashlib.sha256(b"").hexdigest()
_B1, _B2, _BM = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if width > have else out


def _minimizers(hashes: np.ndarray, length: int, k: int) -> np.ndarray:
    """The minimizer of each window, by its first word."""
    if len(hashes) < length:
        return np.empty(0, dtype=np.uint64)
    return _least(common.mix64(common.rolling(hashes, k, _BM)), length - k + 1)


def _windows(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    second = common.mix64(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return common.mix64(common.rolling(hashes, length, _B1)), common.mix64(common.rolling(second, length, _B2))


def _tag(sha: str) -> int:
    """Tells the texts of rows with one doc_id apart."""
    return int(np.int64(np.uint64(int(sha[:16], 16))))


def _read(texts: list, length: int):
    """(index, words' hashes, sha256 of the space-joined words, its word list's bytes) for each text."""
    for at, run in common.pieces(texts):
        words = common.Words(run)
        for i, raw in enumerate(run):
            a, b = words.first[i], words.first[i + 1]
            yield at + i, words.hash[a:b], b" ".join(raw.split())


def _scan(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Per row: doc_id, n_words, sha (of the words), tag, mins (distinct minimizers)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, shas, mins = [], [], []
            for _, h, joined in _read(batch.column(1).to_pylist(), length):
                m = _minimizers(h, length, k)
                n.append(len(h))
                shas.append(hashlib.sha256(joined).hexdigest())
                mins.append(np.unique(m).view(np.int64) if len(m) else np.empty(0, dtype=np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, mins)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(mins)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas), pa.array([_tag(s) for s in shas], pa.int64()), lists], ["doc_id", "n_words", "sha", "tag", "mins"])

        return step

    return common.map_arrow(docs, make, "doc_id long, n_words long, sha string, tag long, mins array<long>")


def _emit(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(h1, h2, doc_id, tag, pos) of every window whose minimizer is in the row's ``shared`` list."""

    def make():
        def step(batch: pa.RecordBatch):
            ids, shared = batch.column(0).to_pylist(), batch.column(2)
            for i, h, joined in _read(batch.column(1).to_pylist(), length):
                m = _minimizers(h, length, k)
                at = np.flatnonzero(np.isin(m, np.array(shared[i].as_py(), dtype=np.int64).view(np.uint64)))
                if len(at):
                    h1, h2 = _windows(h, length)
                    tag = _tag(hashlib.sha256(joined).hexdigest())
                    yield pa.RecordBatch.from_arrays([pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(np.full(len(at), ids[i], dtype=np.int64)), pa.array(np.full(len(at), tag, dtype=np.int64)), pa.array(at.astype(np.int32))], ["h1", "h2", "doc_id", "tag", "pos"])

        return step

    return common.map_arrow(docs, make, "h1 long, h2 long, doc_id long, tag long, pos int")


def merge(positions: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of words that windows at the sorted, distinct ``positions`` cover."""
    if not len(positions):
        return []
    cut = np.flatnonzero(np.diff(positions) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(positions, cut)]


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """Removes the intervals of the row's hits (tag, pos) from its words."""
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string, words_sha256 string"
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string()), ("words_sha256", pa.string())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            ids, hits = batch.column(0).to_pylist(), batch.column(2)
            for i, raw in enumerate(batch.column(1).to_pylist()):
                words = (raw or "").encode("utf-8", "surrogatepass").split()
                sha = hashlib.sha256(b" ".join(words)).hexdigest()
                own = hits[i].values
                tags, at = own.field(0).to_numpy(), own.field(1).to_numpy()
                spans = merge(np.unique(at[tags == _tag(sha)]), length)
                if spans:
                    kept, last = [], 0
                    for s, e in spans:
                        kept += words[last:s]
                        last = e
                    kept += words[last:]
                    rows.append({"doc_id": ids[i], "n_words": len(words), "n_removed": sum(e - s for s, e in spans), "spans": [{"start": s, "end": e} for s, e in spans], "kept": b" ".join(kept).decode("utf-8", "surrogatepass"), "words_sha256": sha})
            return pa.RecordBatch.from_pylist(rows, schema=kind)

        return step

    return common.map_arrow(docs, make, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 25) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed word intervals), kept (the remaining words
    joined by one space; null where nothing was removed) and words_sha256 (of all its words, space-joined)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scan = common.materialize(_scan(rows, length, k), "substring-scan")
    # what is joined to rows of a hot key is written first: a join of two plain shuffles can be split by its skew
    lows = scan.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).filter("n > 1").select("sha", "low")
    lows = common.materialize(lows, "substring-copies")
    facts = common.materialize(scan.select("doc_id", "n_words", "sha", "tag").join(lows, "sha", "left"), "substring-facts")
    whole = f"low < doc_id and n_words >= {length}"  # copies of a smaller document

    own = scan.join(facts.filter(f"doc_id is not null and n_words >= {length} and coalesce(low, doc_id) = doc_id").select("doc_id", "tag").distinct(), ["doc_id", "tag"], "left_semi")
    mins = own.select("doc_id", F.explode("mins").alias("m"))
    shared = mins.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("m")
    shared = common.materialize(shared, "substring-shared")
    wanted = mins.join(shared, "m").groupBy("doc_id").agg(F.collect_set("m").alias("shared"))
    windows = common.materialize(_emit(rows.join(wanted, "doc_id"), length, k), "substring-windows")
    for done in (scan, shared):  # the windows are on disk: nothing reads these again
        common.discard(done)
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("h1", "h2", "low")
    first = common.materialize(first, "substring-first")
    hits = windows.join(first, ["h1", "h2"]).filter("doc_id > low").select("doc_id", "tag", "pos")
    hits = common.materialize(hits.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "pos")).alias("hits")), "substring-hits")
    for done in (windows, first):
        common.discard(done)

    cut = _cut(rows.join(hits, "doc_id"), length)
    marked = hits.select("doc_id", F.explode(F.array_distinct(F.col("hits.tag"))).alias("tag"))
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    copies = facts.filter(whole).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))).alias("spans"), F.lit("").alias("kept"), F.col("sha").alias("words_sha256"))
    same = facts.filter(f"not coalesce({whole}, false)").join(marked, ["doc_id", "tag"], "left_anti")
    same = same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), nothing.alias("spans"), F.lit(None).cast("string").alias("kept"), F.col("sha").alias("words_sha256"))
    return cut.unionByName(copies).unionByName(same)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: doc_id, n_words, n_removed, kept_sha256 of every document, by 50-word windows."""
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    digest = F.when(F.col("kept").isNull(), F.col("words_sha256")).otherwise(F.sha2(F.col("kept"), 256))
    return out.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50
), hashed AS (
  SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM win
), lows AS (
  SELECT h, min(doc_id) AS low FROM hashed GROUP BY h
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM hashed JOIN lows USING (h) WHERE low < doc_id
), word AS (
  SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

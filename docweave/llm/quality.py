"""Quality rules: base rules on every text, then a hashed n-gram log-likelihood ratio.

Tokens are runs of letters and digits or runs of other visible characters; unigrams and bigrams fall into buckets by
their hash.  One pass counts two multinomials: of the whole raw corpus (every document) and of the trusted target
(documents labelled good, from a sample of at most ``max_labelled`` label rows, which is what bounds the broadcast).
A document's score is the mean over its n-grams of log((c_target + k) / (expected + k)), expected being the count
that the raw distribution would give the target and k a smoothing count.  Every document is kept or not by the fixed
``threshold`` on its score.

The number of buckets is a power of two, 16 to 32 characters of trusted text for each: so it grows with the corpus (as
far as the trusted sample does), a bucket's count in the target stays the same on average, and with it what the
smoothing count and the threshold mean.  Counts of a task are sent in ranges of buckets, a few bytes for each bucket
met, and added up range by range; the driver gets eight bytes for each bucket.

Defined results: null and wordless texts have no words, fail the base rules and have score 0; repeated rows are
judged each and counted each; texts of any length are read whole; a score equal to the threshold is kept; without
labels or documents all scores are 0; labels of unknown documents or with null
columns are ignored, and of several labels of one document the lowest quality and highest toxicity counts; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_WHITE = b" \t\n\r\x0b\f"
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[common._SPACE] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CHARS_PER_BUCKET, SMOOTHING, THRESHOLD, MAX_LABELLED, MIN_WORDS = 32, 5.0, -0.5, 100_000, 50
_RANGE = 1 << 14


def base_facts(raw: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text and its words' hashes."""
    n = len(hashes)
    chars = len(raw.decode("utf-8", "surrogatepass")) if not raw.isascii() else len(raw)
    word_chars = chars - (len(raw) - len(raw.translate(None, _WHITE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_WHITE):
            seen.add(line)
    repeat = 0
    if n >= 4:
        h = common.rolling(hashes, 3, common._BASES[1])
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            twice = np.zeros(n, dtype=bool)
            at = np.concatenate((order[1:][same], order[:-1][same]))
            twice[at] = twice[at + 1] = twice[at + 2] = True
            repeat = int(twice.sum())
    return n, word_chars, n_symbols, dup, repeat


def _grams(run: list[bytes], mask: int) -> Iterator[np.ndarray]:
    """Buckets of the unigrams and bigrams of each text."""
    words = common.Words(run, classes=_CLASS)
    one = (words.hash & np.uint64(mask)).astype(np.int64)
    two = (common.mix64(common.rolling(words.hash, 2, common._BASES[2])) & np.uint64(mask)).astype(np.int64)
    for i in range(len(run)):
        a, b = words.first[i], words.first[i + 1]
        yield np.concatenate((one[a:b], two[a : max(a, b - 1)]))


def trusted_ids(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, good: at most ``max_labelled`` labelled documents, those with the smallest hashes of their ids."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))).alias("good"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def _counted(rows: DataFrame, buckets: int) -> DataFrame:
    """(part, raw, target) of rows (text, good): float counts of a range of buckets, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int32), np.zeros(buckets, dtype=np.int32)
        for batch in batches:
            good = batch.column(1).to_pylist()
            for at, texts in common.pieces(batch.column(0).to_pylist()):
                grams = list(_grams(texts, buckets - 1))
                np.add.at(raw, np.concatenate(grams), np.int32(1))
                if own := [g for i, g in enumerate(grams) if good[at + i]]:
                    np.add.at(target, np.concatenate(own), np.int32(1))
        for part in range(0, buckets, _RANGE):
            met = np.flatnonzero(raw[part : part + _RANGE])
            if len(met):
                blob = met.astype("<u2").tobytes() + raw[part + met].astype("<i4").tobytes() + target[part + met].astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part // _RANGE], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(blob) // 10
                own = sums.setdefault(part, np.zeros((2, _RANGE)))
                met = np.frombuffer(blob, "<u2", n)
                own[0, met] += np.frombuffer(blob, "<i4", n, 2 * n)
                own[1, met] += np.frombuffer(blob, "<i4", n, 6 * n)
        for part, (raw, target) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw.astype("<f4").tobytes()]), pa.array([target.astype("<f4").tobytes()])], ["part", "raw", "target"])

    sent = common.arrow_tasks(rows, run, "part int, blob binary")
    return common.arrow_tasks(sent.repartition("part"), add, "part int, raw binary, target binary")


def fit(docs: DataFrame, labels: DataFrame, buckets: int | None = None, smoothing: float = SMOOTHING, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Log ratio of each bucket, from the counts of all documents and of the trusted ones.  ``buckets``, a power of two,
    follows the trusted characters where not given."""
    trusted = F.broadcast(trusted_ids(labels, max_labelled).filter("good"))
    if buckets is None:
        chars = docs.join(trusted, "doc_id").agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = 1 << max(12, (chars // CHARS_PER_BUCKET).bit_length())
    marked = docs.join(trusted, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    raw, target = np.zeros(buckets, np.float32), np.zeros(buckets, np.float32)
    for r in _counted(marked, buckets).collect():  # one row for each range of buckets
        at = slice(r["part"] * _RANGE, (r["part"] + 1) * _RANGE)
        n = len(raw[at])
        raw[at], target[at] = np.frombuffer(r["raw"], "<f4")[:n], np.frombuffer(r["target"], "<f4")[:n]
    share = float(target.sum(dtype=np.float64) / max(raw.sum(dtype=np.float64), 1.0))
    return np.log((target + np.float32(smoothing)) / (raw * np.float32(share) + np.float32(smoothing)))


def judge(docs: DataFrame, labels: DataFrame, buckets: int | None = None, smoothing: float = SMOOTHING, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ratio = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, buckets, smoothing, max_labelled))
    return common.map_arrow(rows, _judge_step(ratio, threshold, min_words), RESULT)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _judge_step(ratio, threshold: float, min_words: int):
    names = [f.split()[0] for f in RESULT.split(", ")]

    def make():
        table = ratio.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            ids = batch.column(0).to_pylist()
            for at, texts in common.pieces(batch.column(1).to_pylist()):
                words = common.Words(texts)
                for i, g in enumerate(_grams(texts, len(table) - 1)):
                    facts = base_facts(texts[i], words.hash[words.first[i] : words.first[i + 1]])
                    score = float(table[g].mean(dtype=np.float64)) if len(g) else 0.0
                    failed = facts[0] < min_words or 100 * facts[4] > 50 * facts[0]
                    out.append((ids[at + i], *facts, failed, score, not failed and score >= threshold))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.bool_()], strict=True)], names)

        return step

    return make


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; one pass over the text after the counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    threshold, min_words = options.pop("threshold", THRESHOLD), options.pop("min_words", MIN_WORDS)
    make = _judge_step(docs.sparkSession.sparkContext.broadcast(fit(rows, labels, **options)), threshold, min_words)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                kept = step(batch.select(["doc_id", "text"])).column("kept")
                yield batch.filter(kept).select(names)

    return common.arrow_tasks(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: base facts and verdict of every document."""
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

"""Line dedup by a log-template tree.

Each line walks a tree of fixed depth: first its token count, then its ``depth`` leading tokens, with tokens that
hold a digit generalised to a variable.  Two kinds of template can recur across documents and are dropped:
  * exact ones: all tokens, digit-bearing ones generalised;
  * patterns: lines of one leaf that agree with each other.  Behind the leading tokens each token of a line has a
    support, the number of different lines of the leaf with that token in that place.  The upper half of a line's
    supports sets its level; tokens with at least ``agree`` of that level are constant, the others are variable
    fields.  Lines with the same constants are one template, so a leaf holds as many templates as there are, each
    at its own level, and prose that merely begins alike shares none.

A template recurs by the number of texts that differ around it.  A text's surroundings of a line are two MinHash
values of the 3-word runs of its other templates; d1 and d2 different values and d12 different pairs of them make
d1 + d2 - d12 texts.  Texts without anything in common count one each; copies share both values and near copies one
of them at least, so a group of either counts about once, and stays the business of near-duplicate removal.  Lines
of n tokens need ``min_texts`` - n / 5 such texts, 3 at least.  What recurs is dropped from every text that holds it,
whatever its share of the text.

Lines of hot templates are counted by partial aggregation of hashes; a text is read twice, and shuffled once, to meet
its own list of lines by its hash.

Defined results: null texts have no lines and stay null; blank lines are kept; a text of recurring lines only becomes
its blank lines, or empty; repeated rows and rows that share a doc_id are treated by their own text; texts of any
length are parsed whole; a tie at a level's edge is constant; an empty table gives an empty result; other columns pass
through untouched, whatever their names, but for those that are named as ``counters``, which are replaced.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_TEXTS, DEPTH, AGREE, LEAST_TEXTS, TOKENS_PER_TEXT = 10, 3, 0.8, 3, 5
VARIABLE = b"<*>"
_AROUND = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_VARIABLE = common.Words([VARIABLE]).hash[0]


class Lines:
    """The lines of several texts, blank ones too: ``owner`` (the text), ``n`` tokens from ``first`` on, and the 64-bit
    hashes ``leaf`` and ``template`` of each line; ``word`` and ``token`` are the hashes of each word and of what the
    tree takes it for."""

    __slots__ = ("owner", "first", "n", "leaf", "template", "word", "token", "variable")

    def __init__(self, texts: list[bytes], depth: int = DEPTH):
        words = common.Words(texts)
        raw = np.frombuffer(words.data, np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at = np.sort(np.concatenate((begins[:-1], np.flatnonzero(raw == 0x0A) + 1)))
        self.owner = np.searchsorted(begins, at, "right") - 1
        first = np.append(np.searchsorted(words.start, at), len(words.start))
        self.first, self.n = first[:-1], np.diff(first)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
        self.variable = digits[words.end] > digits[words.start]
        self.word, self.token = words.hash, np.where(self.variable, _VARIABLE, words.hash)
        # sums of token * base**place, as of a Rabin-Karp hash
        total = np.zeros(len(self.token) + 1, np.uint64)
        np.cumsum(self.token * common.powers(common._BASES[2], len(self.token)), out=total[1:])
        start = np.append(common.powers(common._BASES[2], len(self.token), True), np.uint64(0))[self.first]
        salt = common.mix64(self.n.astype(np.uint64) * np.uint64(common._BASES[0]))
        self.leaf, self.template = (common.mix64((total[self.first + m] - total[self.first]) * start ^ salt ^ np.uint64(k)).view(np.int64) for k, m in enumerate((np.minimum(self.n, depth), self.n)))


def parse(line: bytes, depth: int = DEPTH) -> tuple[int, int, list[bytes]] | None:
    """(leaf, template, tokens) of a line, none for a blank one; the first two are signed 64-bit hashes."""
    tokens = line.split()
    if not tokens:
        return None
    one = Lines([line], depth)
    return int(one.leaf[0]), int(one.template[0]), [VARIABLE if v else t for t, v in zip(tokens, one.variable.tolist(), strict=True)]


def _lows(word: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two minima of the hashes of each line's 3-word runs (a shorter line is one run); no line is blank."""
    runs = np.concatenate((common.rolling(word, 3, common._BASES[1]), np.zeros(2, np.uint64)))
    short = n < 3
    runs[first[short]] = word[first[short]] * np.uint64(5) + word[first[short] + n[short] - 1]
    edges = np.column_stack((first, first + np.maximum(1, n - 2))).reshape(-1)
    runs = np.append(runs, np.uint64(0))  # the last edge may be the end
    return [np.minimum.reduceat(common.mix64(runs ^ salt), edges)[::2].view(np.int64) for salt in _AROUND]


def _minima(lines: list[bytes]) -> list[tuple[int, int]]:
    """:func:`_lows` of lines of which none is blank."""
    words = common.Words(lines)
    return list(zip(*(m.tolist() for m in _lows(words.hash, words.first[:-1], np.diff(words.first))), strict=True))


def _others(owner: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each row the smallest ``low`` of its owner's other rows, 0 where there is no other; owners are in order."""
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    size = np.diff(np.append(begin, len(owner)))
    order = np.lexsort((low, owner))
    second = low[order[np.minimum(begin + 1, len(owner) - 1)]]
    out = np.repeat(low[order[begin]], size)
    out[order[begin]] = second
    return np.where(np.repeat(size, size) > 1, out, 0)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The texts with a 128-bit hash as their key."""
    return docs.select(F.xxhash64(F.col(text_col), F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), F.col(text_col)).alias("k2"), F.col(text_col).alias("text"))


def _parsed(keyed: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, leaf, template, n, c1, c2, tokens) of the different templates of each text: number of tokens,
    surroundings, and 32 bits of each token behind the leading ones where these are two or more."""

    def make():
        def step(batch: pa.RecordBatch):
            for at, texts in common.pieces(batch.column(2).cast(pa.binary()).to_pylist()):
                found = Lines(texts, depth)
                lines = np.flatnonzero(found.n)
                if not len(lines):
                    continue
                lows = _lows(found.word, found.first[lines], found.n[lines])
                order = np.lexsort((found.template[lines], found.owner[lines]))
                line = lines[order]
                new = np.append(True, (found.owner[line][1:] != found.owner[line][:-1]) | (found.template[line][1:] != found.template[line][:-1]))
                each = np.flatnonzero(new)
                line = line[each]  # lines of a template have the same tokens
                owner, first, n = found.owner[line], found.first[line], found.n[line]
                c1, c2 = (_others(owner, np.minimum.reduceat(low[order], each)) for low in lows)
                size = np.where(n >= depth + 2, n - depth, 0)
                ends = np.concatenate(([0], np.cumsum(size)))
                behind = np.repeat(first + depth - ends[:-1], size) + np.arange(ends[-1])
                tokens = pa.array((found.token[behind] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                row = pa.array(at + owner)
                columns = [pa.array(c.astype(np.int64, copy=False)) for c in (found.leaf[line], found.template[line], n, c1, c2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens)], ["k1", "k2", "leaf", "template", "n", "c1", "c2", "tokens"])

        return step

    return common.map_arrow(keyed, make, "k1 long, k2 long, leaf long, template long, n long, c1 long, c2 long, tokens array<int>")


def _needed(min_texts: int) -> Column:
    return F.greatest(F.lit(LEAST_TEXTS), F.lit(min_texts) - F.floor(F.col("n") / TOKENS_PER_TEXT))


def _recurring(rows: DataFrame, key: str, min_texts: int) -> DataFrame:
    """The values of ``key`` that enough different texts hold, of rows (key, n, c1, c2)."""
    once = rows.groupBy(key, "c1", "c2").agg(F.first("n").alias("n"))
    texts = F.count_distinct("c1") + F.count_distinct("c2") - F.count("*")
    return once.groupBy(key).agg(F.first("n").alias("n"), texts.alias("texts")).filter(F.col("texts") >= _needed(min_texts)).select(key)


def templates(docs: DataFrame, min_texts: int = MIN_TEXTS, depth: int = DEPTH, agree: float = AGREE, text_col: str = "text") -> DataFrame:
    """By text (k1, k2): ``drop``, the exact templates that recur, by themselves or by their pattern."""
    keyed = _keyed(docs, text_col)
    parsed = common.materialize(_parsed(keyed, depth), "lines-parsed")
    often = parsed.groupBy("leaf", "template").agg(F.first("n").alias("n"), F.count_distinct("c1").alias("most"))
    often = common.materialize(often, "lines-counted")
    # most lines stand alone: only templates that could recur, and those of leaves in which a pattern could, go on
    long = often.filter(F.col("n") >= depth + 2)
    leaves = long.groupBy("leaf").agg(F.sum("most").alias("all"), F.first("n").alias("n")).filter(F.col("all") >= _needed(min_texts)).select("leaf", F.lit(True).alias("mixed"))
    maybe = F.col("most") >= _needed(min_texts)
    open_ = often.join(leaves, "leaf", "left").select("template", maybe.alias("maybe"), (F.coalesce("mixed", F.lit(False)) & (F.col("n") >= depth + 2)).alias("mixed")).filter("maybe or mixed")
    near = common.materialize(parsed.join(open_, "template"), "lines-near")  # a template has one leaf
    common.discard(parsed)
    exact = common.materialize(_recurring(near.filter("maybe").select("template", "n", "c1", "c2"), "template", min_texts), "lines-exact")
    reach = common.materialize(near.filter("mixed").join(exact, "template", "left_anti"), "lines-reach")
    once = reach.groupBy("template").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))  # a template has one list of tokens
    tokens = common.materialize(once.select("leaf", "template", F.posexplode("tokens").alias("pos", "token")), "lines-tokens")
    support = tokens.groupBy("leaf", "pos", "token").agg(F.count("*").alias("lines"))
    line = tokens.join(support, ["leaf", "pos", "token"]).groupBy("leaf", "template").agg(F.sort_array(F.collect_list(F.struct("lines", "pos", "token")), asc=False).alias("own"))
    level = F.col("own")[F.ceil(F.size("own") / 2).cast("int") - 1]["lines"]
    constant = F.filter("own", lambda x: x["lines"] >= level * agree)
    pattern = line.select("template", F.xxhash64("leaf", F.array_sort(F.transform(constant, lambda x: F.struct(x["pos"], x["token"])))).alias("pattern"))
    pattern = common.materialize(pattern, "lines-patterns")
    shared = _recurring(reach.join(pattern, "template").select("pattern", "n", "c1", "c2"), "pattern", min_texts)
    gone = exact.unionByName(pattern.join(shared, "pattern").select("template"))
    drop = common.materialize(near.join(gone, "template").groupBy("k1", "k2").agg(F.collect_set("template").alias("drop")), "lines-drop")
    for done in (near, often, exact, reach, tokens, pattern):
        common.discard(done)
    return drop


def clean(texts: list[bytes], drops: list[np.ndarray], depth: int = DEPTH) -> list[tuple[bytes, int, int, float]]:
    """(text without its recurring lines, lines with a word, lines dropped, their share of the words) of each text."""
    found, out = Lines(texts, depth), []
    edges = np.searchsorted(found.owner, np.arange(len(texts) + 1))
    for text, drop, a, b in zip(texts, drops, edges[:-1], edges[1:], strict=True):
        n = found.n[a:b]
        gone = np.isin(found.template[a:b], drop) & (n > 0)
        dropped = int(gone.sum())
        kept = b"\n".join(compress(text.split(b"\n"), (~gone).tolist())) if dropped else text
        out.append((kept, int(np.count_nonzero(n)), dropped, int(n[gone].sum()) / max(1, int(n.sum()))))
    return out


COUNTERS = ("n_lines", "n_dropped", "dropped_share")


def drop_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, depth: int = DEPTH, agree: float = AGREE, text_col: str = "text", counters: tuple[str, str, str] = COUNTERS) -> DataFrame:
    """``docs`` with the recurring lines gone from the text, and the columns ``counters``: lines with a word, lines
    dropped, and the share of the text's words that went with them."""
    lists = templates(docs, min_texts, depth, agree, text_col).select(F.col("k1").alias("lk1_"), F.col("k2").alias("lk2_"), F.col("drop").alias("drop_"))
    names = docs.columns
    # all other columns travel in one, so that no name of theirs can meet one of ours
    hold = docs.select(F.struct(F.lit(0).alias("_"), *[docs[c].alias(f"c{i}") for i, c in enumerate(names) if c != text_col]).alias("rest_"), docs[text_col].alias("text_"))
    keyed = hold.withColumn("k1_", F.xxhash64("text_", F.lit(1))).withColumn("k2_", F.xxhash64(F.lit(2), "text_"))
    joined = keyed.join(lists, (F.col("k1_") == F.col("lk1_")) & (F.col("k2_") == F.col("lk2_")), "left").select("rest_", "text_", "drop_")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(t, 0 if t is None else sum(1 for line in t.split(b"\n") if line.strip()), 0, 0.0) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            hit = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            drops = [d.values.to_numpy() for d in batch.column(2).take(pa.array(hit))]
            for at, texts in common.pieces([rows[i][0] for i in hit]):
                for k, cleaned in enumerate(clean(texts, drops[at : at + len(texts)], depth), at):
                    rows[hit[k]] = cleaned
            texts, *counts = zip(*rows, strict=True)
            columns = [pa.array(c, k) for c, k in zip(counts, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *columns], ["rest_", "text_", "n1_", "n2_", "n3_"])

        return step

    counts = [T.StructField("n1_", T.LongType()), T.StructField("n2_", T.LongType()), T.StructField("n3_", T.DoubleType())]
    out = common.map_arrow(joined, make, T.StructType([joined.schema["rest_"], T.StructField("text_", T.StringType()), *counts]))
    own = [F.col("text_").alias(c) if c == text_col else F.col("rest_")[f"c{i}"].alias(c) for i, c in enumerate(names) if c.lower() not in {x.lower() for x in counters}]
    return out.select(*own, *[F.col(f"n{k + 1}_").alias(c) for k, c in enumerate(counters)])


def query(spark, sf_dir: str) -> DataFrame:
    """op8: lines with a word, lines dropped, their share of the words and the remaining text's SHA-256 of every document."""
    out = drop_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "dropped_share", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

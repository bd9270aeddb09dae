"""Packing documents into training sequences by non-negative least squares.

Documents are tokenised, closed by an end token and cut into windows; what is left over (less than a window) forms a
histogram of lengths.  Shallow combinations of two and three lengths that fill a window exactly are enumerated, their
repeat counts are the non-negative least squares solution against the histogram, rounded and bounded by what is
there; the remaining pieces are packed greedily, longest first, cut where a window is full.  The last, unfilled
sequence of a block is cut into powers of two, so nothing needs padding.

Packing needs no shuffle: each task packs blocks of at most ``block_tokens`` tokens of its own documents, solving
each block's own histogram (all its documents), which bounds its memory; a sequence never spans two blocks.  At the
block size used the combinations fill windows as they would over the whole corpus, as each holds thousands of lengths.

Rows are packed in the order in which a task gets them: pack a table (files are read in one order), not the output of a
shuffle, of which a task that runs again gets the rows in another one; :func:`pack` sees to it.

Defined results: a null text is empty, and an empty text is one end token; repeated rows are packed each, as are rows
without doc_id; texts of any length are cut into windows; pieces of one length are taken last come, first packed;
combinations of one repeat count in the order of their lengths; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, END, BLOCK_TOKENS, CACHE_WORDS = 2048, 1, 8_000_000, 400_000
#: Characters whose lower case, composition and white space read alike here and in the tokenizer: ASCII, Latin, Greek,
#: Cyrillic, general punctuation, currency, kana, CJK and Hangul syllables, wide forms and pictures, without combining
#: marks, letters that were added lately, the final sigma and the dotted capital I.  All else is the tokenizer's to read.
_PLAIN = "\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u024f\u0370-\u03a2\u03a4-\u03ff\u0400-\u0482\u048a-\u052f\u1e00-\u1eff\u2000-\u200a\u2010-\u2029\u202f-\u205f\u20a0-\u20bf\u2100-\u2125\u3000-\u3029\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9ffc\uac00-\ud7a3\uff01-\uff9d\U0001f300-\U0001f5ff"
_ODD = re.compile(f"[^{_PLAIN}]|<\\|")
_TAIL = re.compile(r"^(.*?)([^\w\s']*)$", re.S)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet of public byte-pair encoders: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """``tokenizers`` ids of whole texts as little-endian unsigned 32-bit integers; words met often are kept.

    White space ends every pre-token, so a text's ids are those of its words in order.  Texts that could read
    otherwise (``_ODD``, or not in normal form C) go through the tokenizer as a whole; in all others the words are
    in their final form, which reading them once more does not change.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # one pre-token of letters: straight to the model
            raw = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            return np.array([t.id for t in self.tokenizer.model.tokenize(raw)], dtype="<u4").tobytes()
        core, tail = _TAIL.match(word).groups()
        if tail and core.isalpha():
            return self._known(core) + self._known(tail)
        return self._slow(word)

    def _known(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = self._slow(word) if not word.isalpha() and not _TAIL.match(word).group(1) else self._word(word)
            if len(self.known) >= self.cache_words:
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return self._slow(text)
        words = text.lower().split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known[w] if w in known else self._known(w) for w in words])


# --------------------------------------------------------------------------------------------------------------
# the plan of one block
# --------------------------------------------------------------------------------------------------------------
def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, wide: int = 48) -> list[tuple[int, ...]]:
    """Pairs of lengths, and triples with two of the ``wide`` most frequent ones, that fill the window exactly."""
    there = set(lengths.tolist())
    out = {(a, window - a) for a in there if a <= window - a and window - a in there}
    top = lengths[np.argsort(-counts, kind="stable")[:wide]].tolist()
    for i, a in enumerate(top):
        for b in top[i:]:
            if 0 < (c := window - a - b) and c in there:
                out.add(tuple(sorted((a, b, c))))
    return sorted(out)


def solve(combos: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares min |A x - counts| by accelerated projected gradients; A[l, s] = how often
    combination s holds length l.  ``counts`` is indexed by length."""
    if not combos:
        return np.empty(0)
    row = np.array([x for s in combos for x in s])
    col = np.repeat(np.arange(len(combos)), [len(s) for s in combos])
    degree = np.bincount(row, minlength=len(counts))
    step = 1.0 / max(1.0, 3.0 * degree.max())  # |A'A| <= largest column sum * largest row sum
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        rest = np.bincount(row, weights=y[col], minlength=len(counts)) - counts
        new = np.maximum(0.0, y - step * np.bincount(col, weights=rest[row], minlength=len(combos)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(sizes: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of documents of the given sizes exactly once."""
    sequences: list[list[tuple[int, int, int]]] = []
    left: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length of the rest -> (document, start)
    for d, n in enumerate(sizes):
        sequences += [[(d, s, window)] for s in range(0, n - window + 1, window)]
        if n % window:
            left[n % window].append((d, n - n % window))
    counts = np.zeros(window + 1)
    for length, own in left.items():
        counts[length] = len(own)
    lengths = np.flatnonzero(counts)
    combos = combinations(lengths, counts[lengths], window)
    repeat = solve(combos, counts)
    for s in np.argsort(-repeat, kind="stable"):
        combo = combos[s]
        n = int(min(np.floor(repeat[s] + 0.5), *(len(left[x]) // combo.count(x) for x in combo)))
        for _ in range(n):
            sequences.append([(*left[x].pop(), x) for x in combo])
    own: list[tuple[int, int, int]] = []
    room = window
    for length in sorted(left, reverse=True):
        for d, start in left[length]:
            rest = length
            while rest:
                take = min(rest, room)
                own.append((d, start + length - rest, take))
                rest, room = rest - take, room - take
                if not room:
                    sequences.append(own)
                    own, room = [], window
    fill = window - room
    for size in (1 << k for k in reversed(range(fill.bit_length()))):  # the last one: powers of two
        if fill & size:
            part, need = [], size
            while need:
                d, start, n = own.pop(0)
                part.append((d, start, min(n, need)))
                if n > need:
                    own.insert(0, (d, start + need, n - need))
                need -= min(n, need)
            sequences.append(part)
    return sequences


# --------------------------------------------------------------------------------------------------------------
RESULT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset.  sequence_id is the task's number times 2**36 plus a running number."""
    closing = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        at = TaskContext.get().partitionId() << 36
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at
            sizes = [len(t) // 4 for t in tokens]
            rows: list[tuple] = []
            for sequence in plan(sizes, window):
                offset = 0
                for d, start, n in sequence:
                    rows.append((ids[d], start, n, tokens[d][4 * start : 4 * (start + n)], sizes[d], at, offset))
                    offset += n
                at += 1
                if len(rows) >= 4000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            own = batch.column(0).to_pylist()
            for i, t in enumerate(batch.column(1)):
                ids.append(own[i])
                tokens.append(encoder.encode(t.as_py()) + closing)
                held += len(tokens[-1]) // 4
                if held >= block_tokens:
                    yield from flush()
                    ids, tokens, held = [], [], 0
        if tokens:
            yield from flush()

    rows = common.settled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "packing-rows")
    return common.arrow_tasks(rows, run, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in RESULT.split(", ")])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(pieces: DataFrame) -> DataFrame:
    """The columns that the query returns: the ids by their CRC-32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every piece of every packed document."""
    return digest(pack(common.table(spark, sf_dir, "documents"), vocabulary()))

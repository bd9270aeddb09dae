"""URL filter: a sorted array of 64-bit xxhash keys, memory-mapped by every worker and probed by binary search.

Entries are a host and a path prefix, written ``host/`` or ``host/prefix``; an entry fits its host and all subdomains
of it when the url's path starts with the prefix, and the longest entry that fits decides.  A url therefore turns
into candidate keys (each suffix of its host at a dot that is no longer than the longest host of an entry, times the
distinct path lengths of the entries), whose number is bounded by the list, however long the url.  All
candidates of a batch are hashed, found in the mapped array by one vectorised binary search, and a hit counts only
if the stored full string equals the candidate.

The list is a parameter of at most ``MAX_ENTRIES`` entries (checked), shipped once per executor as a file by
``SparkContext.addFile`` and shared by that executor's workers through the page cache; longer lists go through
:func:`judge_large`, a shuffle join on the same candidates.

Defined results: a null url or one without ``://`` has empty host and path, fits no entry and is allowed; an url
without a path has the empty path, which no entry fits; a doubled entry must not have two verdicts (an error);
repeated rows are judged each; urls of any length are judged whole; of entries of one length the longer host decides;
an empty table gives an empty result; other columns pass through untouched or are ignored.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ENTRIES = 5_000_000
#: Fixed rules of the op2 query.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: The method's own list: hosts of advertising, gambling, adult and pharmacy spam; with all subdomains.
SPAM_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
SPAM_LIST = {f"{name}.example.{top}/": "block" for name in SPAM_NAMES for top in ("com", "net", "org")}


def read_list(lines: Iterable[str]) -> dict[str, str]:
    """Blocking entries of a public block list: one host or ``host/prefix`` a line, or ``0.0.0.0 host`` as in a hosts
    file; what follows a ``#`` and empty lines are left out."""
    out = {}
    for line in lines:
        if words := line.partition("#")[0].split():
            host, _, prefix = words[-1].partition("/")
            out[f"{host.lower()}/{prefix}"] = "block"
    return out


def key(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode())


class Digests:
    """The file format: a head with the distinct path lengths and the length of the longest host, <n> sorted uint64 keys, n+1 uint64 offsets, n verdict bytes, then the strings."""

    MAGIC = 0x5552_4C31

    @staticmethod
    def write(entries: dict[str, str], path: str) -> None:
        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"{len(entries)} entries; at most {MAX_ENTRIES} are mapped, use judge_large()")
        if wrong := [e for e, v in entries.items() if "/" not in e or v not in ("allow", "block")]:
            raise ValueError(f"not a host/path entry with allow or block: {wrong[:3]}")
        order = sorted(entries, key=lambda e: (key(e), e))
        blobs = [e.encode() for e in order]
        lengths = sorted({len(e.partition("/")[2]) + 1 for e in entries})
        with open(path, "wb") as f:
            np.array([Digests.MAGIC, len(order), len(lengths), max((e.index("/") for e in entries), default=0), *lengths], dtype="<u8").tofile(f)
            np.array([key(e) for e in order], dtype="<u8").tofile(f)
            np.cumsum([0, *map(len, blobs)]).astype("<u8").tofile(f)
            np.array([entries[e] == "block" for e in order], dtype="u1").tofile(f)
            f.write(b"".join(blobs))

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r")
        head = raw[:32].view("<u8")
        if head[0] != self.MAGIC:
            raise ValueError("not a digest file")
        n, k, self.longest_host = (int(x) for x in head[1:])
        self.lengths = [int(x) for x in raw[32 : 32 + 8 * k].view("<u8")]
        at = 32 + 8 * k
        self.keys = raw[at : at + 8 * n].view("<u8")
        self.offsets = raw[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.block = raw[at + 16 * n + 8 : at + 17 * n + 8]
        self.strings = raw[at + 17 * n + 8 :]

    def entry(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def longest(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """For each url the longest entry that fits and whether it blocks; of equally long ones the longest host."""
        owner: list[int] = []
        texts: list[bytes] = []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            if not p:
                continue
            cut = [p[:k] for k in self.lengths if k <= len(p)]
            if len(h) > self.longest_host:  # from the first dot within reach
                h = h[-self.longest_host - 1 :].partition(".")[2]
            while h:
                owner += [i] * len(cut)
                texts += [(h + c).encode("utf-8", "surrogatepass") for c in cut]
                h = h.partition(".")[2]
        best: list[tuple[str, bool] | None] = [None] * len(hosts)
        if not texts or not len(self.keys):
            return best
        probe = np.fromiter(map(xxhash.xxh64_intdigest, texts), dtype=np.uint64, count=len(texts))
        at = np.searchsorted(self.keys, probe)
        for j in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probe)):
            k = int(at[j])
            while k < len(self.keys) and self.keys[k] == probe[j]:  # all entries of that key: confirm the string
                if self.entry(k) == texts[j]:
                    i, e = owner[j], texts[j].decode("utf-8", "surrogatepass")
                    if best[i] is None or (len(e), e.index("/")) > (len(best[i][0]), best[i][0].index("/")):
                        best[i] = (e, bool(self.block[k]))
                    break
                k += 1
        return best


_shipped: dict[tuple[str, int], str] = {}


def ship(spark, entries: dict[str, str]) -> str:
    """Send the digest file to all present and later executors, once for each list; returns the name to open it by."""
    own = spark.sparkContext.applicationId, xxhash.xxh64_intdigest(repr(sorted(entries.items())))
    if own not in _shipped:
        folder = tempfile.mkdtemp(prefix="docweave-urls-")  # the driver serves it as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"urls-{own[1]:016x}.bin")
        Digests.write(entries, path)
        spark.sparkContext.addFile(path)
        _shipped[own] = os.path.basename(path)
    return _shipped[own]


def host_path(url):
    """Host (after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased) and path (then up to ``?`` or ``#``)."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: dict[str, str], blocklist: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): the longest rule decides; else the block list; else allow."""
    spark = pages.sparkSession
    names = ship(spark, rules), ship(spark, blocklist)

    def make():
        first, second = (Digests(SparkFiles.get(n)) for n in names)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            ruled = first.longest(hosts, paths)
            # the list judges hosts alone: its entries end in the root path, which every url of the host has
            listed = second.longest(hosts, [p if p.startswith("/") else "/" for p in paths])
            rule = [r and r[0] for r in ruled]
            block = [r[1] if r else bool(s and s[1]) for r, s in zip(ruled, listed, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pc.if_else(pa.array(block, pa.bool_()), "block", "allow"), pa.array([s and s[0] for s in listed], pa.string())],
                ["page_id", "host", "path", "rule", "verdict", "listed"],
            )

        return step

    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return common.map_arrow(rows, make, "page_id long, host string, path string, rule string, verdict string, listed string")


def judge_large(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", lengths: list[int] | None = None) -> DataFrame:
    """The same decision for a list too long to map: ``entries(entry, verdict)`` joined by the full string.

    Returns (page_id, entry, verdict) of the urls that some entry fits.  ``lengths``: the distinct path lengths of
    the entries, found by one aggregation where not given.
    """
    if lengths is None:
        cut = F.expr("length(entry) - instr(entry, '/') + 1")
        lengths = sorted(r[0] for r in entries.select(cut).distinct().collect())
    reach = entries.agg(F.max(F.instr("entry", "/") - 1)).first()[0] or 0
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).filter("path <> '' and host <> ''")
    end = F.substring(F.col("host"), F.length("host") - reach, F.lit(reach + 1))  # from the first dot within reach
    near = F.when(F.length("host") <= reach, F.col("host")).otherwise(F.regexp_extract(end, r"(?s)^[^.]*\.(.*)$", 1))
    labels = F.split(near, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    tails = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]), lambda x: x.isNotNull())
    probes = rows.select("page_id", F.explode(suffixes).alias("h"), tails.alias("t"))
    probes = probes.select("page_id", F.explode(F.transform("t", lambda t: F.concat("h", t))).alias("entry"))
    hit = probes.join(entries.select("entry", "verdict"), "entry")
    rank = F.struct(F.length("entry"), F.instr("entry", "/"), "entry", "verdict")
    return hit.groupBy("page_id").agg(F.max(rank).alias("m")).select("page_id", "m.entry", "m.verdict")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the verdict on every page's url."""
    return judge(common.table(spark, sf_dir, "pages"), RULES, SPAM_LIST)


SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule, rhost, rpath, verdict) AS (
  VALUES {", ".join(f"('{e}', '{e.partition('/')[0]}', '/{e.partition('/')[2]}', '{v}')" for e, v in RULES.items())}
), l(entry, lhost) AS (
  VALUES {", ".join(f"('{e}', '{e[:-1]}')" for e in SPAM_LIST)}
), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), bad AS (
  SELECT page_id, arg_max(entry, length(entry)) AS listed FROM s JOIN l ON host = lhost OR ends_with(host, '.' || lhost) GROUP BY page_id
)
SELECT s.page_id, host, path, rule, coalesce(verdict, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed
FROM s LEFT JOIN fit USING (page_id) LEFT JOIN bad USING (page_id)
"""

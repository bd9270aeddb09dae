"""Each training-data operator against a plain brute-force version, and its defined results for odd input."""

import hashlib
import random
import time
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docweave.llm import chat, common, licenses, lines, mixing, packing, quality, sampling, simhash, substring, urlfilter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Prose with exact and near copies, shared passages, odd white space, nulls, empties and long texts."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", ",", ".\n"]) for _ in range(n))
    passage = prose(70)
    rows = [(i, prose(r.randint(5, 300))) for i in range(40)]
    rows += [(40 + i, prose(40) + " " + passage + " " + prose(40)) for i in range(6)]
    base = prose(400)
    rows += [(50 + i, base) for i in range(4)]
    for i in range(5):
        w = base.split(" ")
        w[r.randrange(len(w))] = "edited"
        rows.append((60 + i, " ".join(w)))
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "One"), (74, "a\x0bb\x0cc\x85d\u2028e  f"), (75, passage * 12), (76, "x " * 200), (77, prose(9000))]
    r.shuffle(rows)
    return rows


def test_url_filter(spark):
    got = urlfilter.query(spark, SF).toPandas().sort_values("page_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = db.execute(urlfilter.SQL).df().sort_values("page_id").reset_index(drop=True)[list(got.columns)]
    assert (got.fillna("-") == want.fillna("-")).all().all()


def test_url_filter_odd_urls_and_shuffle_join(spark):
    rows = [(1, None), (2, "nonsense"), (3, "http://A.Example.COM/en/x?q#f"), (4, "http://www.example.com/en/"), (5, "x://net"), (6, "http://a.net/es/1#/fr/"), (7, "http://xnet/es/"), (8, "http://b.net/fr/?"), (8, "http://b.net/fr/?"), (9, "http://h.com?x=/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.RULES, {}).collect())
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/x", "example.com/en/", "block"), (4, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (5, "net", "", None, "allow"), (6, "a.net", "/es/1", "net/es/", "block"), (7, "xnet", "/es/", None, "allow"), (8, "b.net", "/fr/", "net/fr/", "block"), (8, "b.net", "/fr/", "net/fr/", "block"), (9, "h.com", "", None, "allow"),
    ]
    entries = spark.createDataFrame(list(urlfilter.RULES.items()), "entry string, verdict string")
    large = {(r.page_id, r.entry, r.verdict) for r in urlfilter.judge_large(pages.distinct(), entries).collect()}
    assert large == {(p, rule, v) for p, _, _, rule, v in got if rule}
    assert urlfilter.judge(pages.limit(0), urlfilter.RULES, {}).count() == 0
    with pytest.raises(ValueError):
        urlfilter.Digests.write({"nohost": "block"}, "/dev/null")


def test_long_hosts_are_probed_within_the_longest_entry(spark, tmp_path):
    entries = {"a.b.example.com/": "block", "com/": "allow", "b.example.com/x": "allow"}
    urlfilter.Digests.write(entries, str(tmp_path / "d"))
    d = urlfilter.Digests(str(tmp_path / "d"))
    hosts = ["." * 1_000_000 + "com", "x." * 400_000 + "a.b.example.com", "xa.b.example.com", "y.b.example.com", "com", "yb.example.com", ""]
    want = [("com/", False), ("a.b.example.com/", True), ("b.example.com/x", False), ("b.example.com/x", False), ("com/", False), ("com/", False), None]
    assert d.longest(hosts, ["/x"] * len(hosts)) == want
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts[1:])], "page_id long, url string")
    large = {r.page_id: (r.entry, r.verdict == "block") for r in urlfilter.judge_large(pages, spark.createDataFrame(list(entries.items()), "entry string, verdict string")).collect()}
    assert large == {i: w for i, w in enumerate(want[1:]) if w}
    assert urlfilter.read_list(["# a list", "0.0.0.0 Ads.example.com # x", "bad.example.net/p", ""]) == {"ads.example.com/": "block", "bad.example.net/p": "block"}


def test_digest_collision_is_confirmed_by_the_string(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter, "key", lambda e: 7)
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b, *a: 7)
    urlfilter.Digests.write({"a.com/": "block", "b.com/": "allow"}, str(tmp_path / "d"))
    d = urlfilter.Digests(str(tmp_path / "d"))
    assert d.longest(["x.b.com", "a.com", "c.com"], ["/", "/p", "/"]) == [("b.com/", False), ("a.com/", True), None]


def test_chat(spark):
    got = chat.query(spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = db.execute(chat.SQL).df().sort_values("conv_id").reset_index(drop=True)
    assert got.equals(want[list(got.columns)].astype(got.dtypes.to_dict()))


def test_chat_snapshots(spark):
    logs = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "a", 6: "b", 7: "ba", None: "zz"}
    rows = [(c, i, "user" if i % 2 == 0 else None, t, 0) for c, s in logs.items() for i, t in enumerate(s)] + [(9, None, None, None, 1)]
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, i int")).collect()}
    assert set(got) == {2, 4, 7, 9, None}
    assert got[2] == (3, "<|user|>\na<|end|>\n<|-|>\nb<|end|>\n<|user|>\nc<|end|>\n".replace("-", ""))
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_windows(rows, n=50):
    seen = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            seen[k] = min(d, seen.get(k, d))
    out = {}
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring(spark, corpus):
    out = substring.remove_repeats(make(spark, corpus))
    digest = F.when(F.col("kept").isNull(), F.col("words_sha256")).otherwise(F.sha2("kept", 256))
    got = {r.doc_id: (r.n_words, r.n_removed, r.s) for r in out.withColumn("s", digest).collect()}
    assert got == brute_windows(corpus)
    assert sum(g[1] for g in got.values()) > 1000


def test_substring_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (1, "other " + long), (2, long), (None, long), (3, None)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring.remove_repeats(make(spark, rows)).collect()))
    assert got == [(False, 1, 60, 0), (False, 1, 60, 0), (False, 1, 61, 0), (False, 2, 60, 60), (False, 3, 0, 0), (True, 0, 60, 0)]
    assert substring.remove_repeats(make(spark, rows).limit(0)).count() == 0
    assert substring.merge(np.array([0, 1, 60, 200]), 50) == [(0, 51), (60, 110), (200, 250)]


def plain_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, corpus):
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(make(spark, corpus)).collect()}
    fps = {d: plain_fingerprint(t) for d, t in corpus}
    assert {d: g[0] for d, g in got.items()} == fps
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {d: g[1] for d, g in got.items()} == {d: find(d) for d in fps}


def test_ball_edges_connect_exactly_the_radius(spark):
    r = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        f = r.getrandbits(64)
        for k in range(4):
            g = f
            for b in r.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.ball_edges(spark.createDataFrame([(f,) for f in signed], "fp long"))
    linked = {r.node: r.root for r in common.components(edges).collect()}
    for a in fps:
        for b in fps:
            sa, sb = (f - (1 << 64) if f >> 63 else f for f in (a, b))
            if (a ^ b).bit_count() <= 2:
                assert linked.get(sa, sa) == linked.get(sb, sb)
    assert all((e.a ^ e.b) % (1 << 64) and ((e.a ^ e.b) % (1 << 64)).bit_count() <= 2 for e in edges.collect())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(64)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(65)} | {1000 + i: 1000 for i in range(50)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_base(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_base_facts(spark, corpus):
    rows = corpus + [(80, "a b\nc\na b\n\n \nc\n a b\n|x <*>"), (81, "p q r p q r p q"), (82, "q q q q")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (999, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.judge(make(spark, rows), labels).collect()}
    assert got == {d: plain_base(t) for d, t in rows}


def test_quality_drops_junk_and_keeps_clean(spark):
    r = random.Random(9)
    clean = lambda: " ".join(r.choice(["the", "house", "river", "of", "stone", "and", "green"]) + str(r.randrange(40)) for _ in range(120))
    junk = lambda: " ".join(r.choice(["buy", "win", "cash"]) + "$$$" for _ in range(20)) + " " + " ".join(f"x{r.randrange(10**6)}%%%" for _ in range(90))
    rows = [(i, clean() if i % 4 else junk()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    docs = make(spark, rows).withColumn("good", F.lit(1)).withColumn("score", F.lit("x"))
    kept = quality.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i in range(400) if i % 4}
    assert quality.filter_documents(docs.limit(0), labels).count() == 0


def test_quality_verdicts_stay_as_the_corpus_grows(spark):
    """Junk of a wide vocabulary is rejected, and held-out clean text kept, at 300 and at 2,400 documents."""
    r = random.Random(10)
    vocab = ["".join(r.choice("aeioubdfgklmnprst") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    clean = lambda: " ".join(r.choices(vocab, [1 / (i + 20) for i in range(3000)], k=150))
    junk = lambda: " ".join(r.choice(["%%", "$", "##", "|"]) + str(r.randrange(500)) for _ in range(150))
    for n in (300, 2400):
        rows = [(i, clean() if i % 10 else junk()) for i in range(n)]
        labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")
        got = {x.doc_id: x.kept for x in quality.judge(make(spark, rows), labels).collect()}
        assert [d for d in got if got[d] != bool(d % 10)] == []


def plain_ratio(rows, good):
    """The same multinomials, token by token."""
    raw, target = Counter(), Counter()
    for d, t in rows:
        tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", t or "")
        for g in [(x,) for x in tokens] + list(zip(tokens, tokens[1:], strict=False)):
            raw[g] += 1
            target[g] += d in good
    share = sum(target.values()) / max(1, sum(raw.values()))
    return {g: np.log((target[g] + quality.SMOOTHING) / (raw[g] * share + quality.SMOOTHING)) for g in raw}


def test_quality_scores(spark, corpus):
    rows = [(d, t) for d, t in corpus if d < 60]
    labels = spark.createDataFrame([(d, 1, 0) for d in range(0, 30)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.judge(make(spark, rows), labels, buckets=1 << 22).collect()}
    ratio = plain_ratio(rows, set(range(30)))
    for d, t in rows:
        tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", t or "")
        grams = [(x,) for x in tokens] + list(zip(tokens, tokens[1:], strict=False))
        assert abs(got[d] - np.mean([ratio[g] for g in grams])) < 0.01


def test_packing_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    rows = corpus + [(90, "it's <|endoftext|> we'll İstanbul ΑΣ áe\x1fx e\u0301 don't,ok... 12,345"), (91, "a,T\u0308"), (92, "2T\u0308"), (93, "x-J\u030c y"), (94, "b\U00010d50"), (95, "Y\ua7dc")]
    got = packing.pack(make(spark, rows), packing.vocabulary(), block_tokens=20_000).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(pieces) == {d for d, _ in rows}
    for d, t in rows:
        own = sorted(pieces[d], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in own), dtype="<u4").tolist()
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]
        assert all(p.doc_tokens == len(ids) and p.length == len(p.ids) // 4 for p in own)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1].tolist()]
        total = sum(p.length for p in s)
        assert total <= 2048 and total & (total - 1) == 0  # nothing to pad
    digest = packing.digest(spark.createDataFrame([(1, 0, 2, bytearray(b"\x01\0\0\0\2\0\0\0"), 2, 0, 0)], packing.RESULT)).first()
    assert digest.ids_crc32 == zlib.crc32(b"\x01\0\0\0\2\0\0\0")


def test_ids_equal_the_tokenizers_over_all_planes():
    r = random.Random(77)
    encoder = packing.Encoder(packing.vocabulary())
    blocks = [(0x20, 0x7F), (0x80, 0x250), (0x300, 0x370), (0x370, 0x530), (0x1E00, 0x2150), (0x3000, 0x3100), (0xA640, 0xA800), (0xAC00, 0xAC80), (0xFF00, 0xFFE0), (0x10400, 0x10E00), (0x1F300, 0x1F700), (1, 0xD800), (0xE000, 0x110000)]
    plain = 0
    for _ in range(30_000):
        own = r.choices(blocks, k=r.randint(1, 3))
        text = "".join(chr(r.randrange(*r.choice(own))) if r.random() < 0.8 else r.choice(" '\t\n.,sStTdmlr") for _ in range(r.randint(1, 9)))
        plain += not packing._ODD.search(text)
        assert encoder.encode(text) == encoder._slow(text), ascii(text)
    assert plain > 5_000


def test_packing_settles_the_order_of_a_shuffle(spark, corpus):
    shuffled = make(spark, corpus).repartition(3, "doc_id")
    assert "Exchange" not in common.settled(shuffled, "x")._jdf.queryExecution().executedPlan().toString()
    table = common.materialize(make(spark, corpus), "x")
    assert common.settled(table, "y") is table


def test_nnls_meets_a_mixed_histogram():
    r = random.Random(1)
    sizes = [x for a in (700, 500, 300) for x in (a, 2048 - a) for _ in range(50)] + [r.randint(1, 6000) for _ in range(300)]
    counts = np.zeros(2049)
    for n in sizes:
        counts[n % 2048] += n % 2048 > 0
    combos = packing.combinations(np.flatnonzero(counts), counts[np.flatnonzero(counts)], 2048)
    x = packing.solve(combos, counts)
    assert (x >= 0).all() and all(sum(c) == 2048 for c in combos)
    fit = counts.copy()
    for c, n in zip(combos, x, strict=True):
        for length in c:
            fit[length] -= n
    assert np.abs(fit).sum() < 0.8 * counts.sum()
    seen = Counter((d, i) for s in packing.plan(sizes) for d, a, n in s for i in range(a, a + n))
    assert set(seen.values()) == {1} and len(seen) == sum(sizes)


def plain_lines(rows, min_texts):
    """Which lines go, by the definitions of the docstring, one line at a time."""
    texts = {t for _, t in rows if t}
    parsed = {t: {p[1]: (p, line) for line in reversed(t.split("\n")) if (p := lines.parse(line.encode()))} for t in texts}
    around = {}
    for t, own in parsed.items():
        minima = {}
        for line in t.split("\n"):
            if p := lines.parse(line.encode()):
                m = lines._minima([line.encode()])[0]
                minima[p[1]] = tuple(map(min, m, minima.get(p[1], m)))
        for k in own:
            others = [m for o, m in minima.items() if o != k]
            around[t, k] = tuple(min(m[c] for m in others) if others else 0 for c in (0, 1))
    need = lambda n: max(3, min_texts - n // 5)

    def recurring(groups):
        out = set()
        for key, members in groups.items():  # (n, c1, c2) of each text and line
            pairs = {m[1:] for m in members}
            if len({p[0] for p in pairs}) + len({p[1] for p in pairs}) - len(pairs) >= need(members[0][0]):
                out.add(key)
        return out

    exact = defaultdict(list)
    for t, own in parsed.items():
        for k, (p, _) in own.items():
            exact[k].append((len(p[2]), *around[t, k]))
    gone = recurring(exact)
    leaves = defaultdict(dict)
    most = Counter()
    for own in parsed.values():
        for k, (p, _) in own.items():
            if k not in gone and len(p[2]) >= 5:
                leaves[p[0]][k] = p[2]
    for leaf, own in leaves.items():
        most[leaf] = sum(len({m[1] for m in exact[k]}) for k in own)
    pattern = {}
    for leaf, own in leaves.items():
        n = len(next(iter(own.values())))
        if most[leaf] < need(n):
            continue
        support = Counter((i, w) for w3 in own.values() for i, w in enumerate(w3) if i >= 3)
        for k, tokens in own.items():
            held = sorted((support[i, tokens[i]] for i in range(3, n)), reverse=True)
            level = held[(len(held) + 1) // 2 - 1]
            pattern[k] = leaf, tuple((i, tokens[i]) for i in range(3, n) if support[i, tokens[i]] >= 0.8 * level)
    groups = defaultdict(list)
    for k, p in pattern.items():
        groups[p] += exact[k]
    shared = recurring(groups)
    return gone | {k for k, p in pattern.items() if p in shared}


def check_lines(spark, rows, min_texts):
    gone = plain_lines(rows, min_texts)
    got = Counter((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in lines.drop_lines(make(spark, rows), min_texts=min_texts).collect())
    want = Counter()
    for d, t in rows:
        own = [(line, lines.parse(line.encode())) for line in (t or "").split("\n")]
        kept = [line for line, p in own if not p or p[1] not in gone]
        want[d, t if t is None else "\n".join(kept), sum(1 for _, p in own if p), len(own) - len(kept)] += 1
    assert got == want
    return {d: n for (d, _, _, n) in got}


def prose(r, n_lines=6, n=9):
    return "\n".join(" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)) for _ in range(n_lines))


def test_line_dedup(spark):
    r = random.Random(2)
    body = [prose(r) for _ in range(40)]
    rows = [(i, f"{b}\nSubscribe to our news letter today\nPage {i} of {i + 7}\nposted in general by user {chr(97 + i % 26) * 5} on monday") for i, b in enumerate(body)]
    rows += [(100 + i, body[0] + f"\nunique ending {chr(97 + i)}") for i in range(12)] + [(200, None), (201, ""), (202, "\n\n"), (203, "Subscribe to our news letter today"), (204, "Ox.\nSubscribe to our news letter today\n"), (0, rows[0][1])]
    docs = make(spark, rows).withColumn("k1", F.lit(1)).withColumn("drop", F.lit(2)).withColumn("rest_", F.lit(3)).withColumn("text_", F.lit(4))
    out = lines.drop_lines(docs, min_texts=10)
    assert out.columns == [*docs.columns, *lines.COUNTERS]
    got = {x.doc_id: x for x in out.collect()}
    assert out.count() == len(rows) and got[3].rest_ == 3 and got[3].text_ == 4
    for i in range(1, 40):
        assert got[i].text == body[i], i  # exact, digit-bearing and positional templates are gone, prose stays
    for i in range(12):
        assert got[100 + i].n_dropped == 0  # what near copies have in common is theirs
    assert got[200].text is None and got[201].text == "" and got[202].text == "\n\n"
    assert (got[203].text, got[203].dropped_share) == ("", 1.0) and got[204].text == "Ox.\n"  # whatever its share
    assert lines.drop_lines(docs.limit(0)).count() == 0
    taken = lines.drop_lines(docs.withColumn("n_lines", F.lit("x")))
    assert taken.columns.count("n_lines") == 1 and taken.schema["n_lines"].dataType.simpleString() == "bigint"
    check_lines(spark, rows, 10)


def test_line_dedup_tells_templates_of_a_leaf_apart(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(7))
    rows = [(i, prose(r, 3) + f"\nThis page was written by {word()} and may be shared freely here") for i in range(40)]
    rows += [(100 + i, prose(r, 3) + f"\nThis page was printed for {word()} under rules kept at our office") for i in range(30)]
    rows += [(200 + i, prose(r, 3) + "\nThis page was " + " ".join(word() for _ in range(9))) for i in range(30)]  # prose that begins alike
    rows += [(300 + i, prose(r, 3) + f"\nposted in general by user {'bob' if i < 15 else word()} on monday") for i in range(40)]
    dropped = check_lines(spark, rows, 10)
    assert all(dropped[d] == (not 200 <= d < 300) for d, _ in rows)


def test_line_dedup_by_brute_force(spark, corpus):
    r = random.Random(4)
    vocab = "one two three four five six seven".split()
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(1, 8)))
    rows = corpus + [(1000 + i, "\n".join(line() for _ in range(r.randint(1, 12)))) for i in range(150)]
    assert sum(check_lines(spark, rows, 6).values()) > 100


TEMPLATE = licenses.Template


def test_license_scan(spark):
    rows = [(1, "x MIT-License, mit license mit\nlicense y"), (2, None), (3, "All rights reserved!\nfoo"), (4, "Licensed under CC BY-NC 4.0."), (5, "Apache  LICENSE é cc by"), (6, "reserved rights"), (7, "gnu general public license")]
    got = {r.doc_id: tuple(r)[1:8] for r in licenses.scan(make(spark, rows)).drop("blocks").collect()}
    assert got[1][:5] == (8, 3, 1, 5, "mit")
    assert got[2] == (0, 0, None, None, "", "", 0.0)
    assert got[3] == (4, 0, None, None, "", "all-rights-reserved", 1.0)
    assert got[4][4:6] == ("cc-by", "cc-by,cc-by-nc")
    assert got[5][:5] == (5, 2, 0, 3, "apache,cc-by")
    assert got[6][5] == "" and got[6][6] == 0.0
    assert got[7][4] == "gpl"


def test_license_labels_are_the_most_specific_ones(spark):
    mit = next(t.text for t in licenses.TEXTS if t.label == "mit")
    want = {
        "Licensed under CC BY 4.0.": "cc-by",
        "Licensed under the terms of the GNU General Public License.": "gpl",
        "licensed under the terms of the GNU Lesser General Public License": "lgpl",
        "Released under the BSD License.": "bsd",
        "Released under the Apache License.": "apache",
        "all the people reserved their rights to leave": "",
        "Copyright by somebody\n\n" + textwrap.fill(mit, 72) + "\nend": "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": "mit",
    }
    rows = list(enumerate(want))
    got = {x.doc_id: x.labels for x in licenses.scan(make(spark, rows), phrases={}).collect()}
    assert [got[i] for i, _ in rows] == list(want.values())
    for t in licenses.TEMPLATES:  # each template finds its own label, wrapped or not
        index = licenses.Index(licenses.TEMPLATES, {}, licenses.THRESHOLD)
        words = licenses._flat("before it " + textwrap.fill(t.text, 40) + " behind it").split()
        assert t.label in {index.sets[f[3]][0] for f in index.winners(index.matches(words))}, t


def plain_blocks(text, templates, threshold):
    """Every block by trying every word of the text as its first."""
    ws = [w.decode() for w in licenses._flat(text).split()]
    found = []
    for no, t in enumerate(templates):
        run = [w.decode() for w in licenses._flat(t.text).split()]
        for i in range(len(ws)):
            own = ws[i : i + len(run)]
            if ws[i] in run and len(set(own) & set(run)) >= threshold * len(set(run)) - 1e-9 and set(t.names.split()) <= set(own):
                found.append((i, i + max(k for k, w in enumerate(own) if w in run), len(set(own) & set(run)) / len(set(run)), no))
    better = lambda y, x: (y[2], len(set(templates[y[3]].text.split())), -y[3]) > (x[2], len(set(templates[x[3]].text.split())), -x[3])
    return found, [x for x in found if not any(templates[y[3]].label != templates[x[3]].label and y[0] <= x[1] and x[0] <= y[1] and better(y, x) for y in found)]


def test_license_join_is_exact(spark):
    r = random.Random(4)
    vocab = [f"t{i}" for i in range(40)]
    templates = []
    for i in range(30):
        own = r.choices(vocab, k=r.randint(1, 12))
        templates.append(TEMPLATE(f"l{i % 20}", " ".join(r.sample(own, r.randint(0, 1))), " ".join(own)))
    rows = [(i, "\n".join(" ".join(r.choices(vocab, k=r.randint(1, 25))) for _ in range(3))) for i in range(120)]
    index = licenses.Index(templates, Counter(w.encode() for _, t in rows for w in set(t.split())), 0.7)
    for _, t in rows:
        found, won = plain_blocks(t, templates, 0.7)
        assert sorted(index.matches(licenses._flat(t).split())) == sorted(found)
        assert sorted(index.winners(sorted(found))) == sorted(won)
    got = {x.doc_id: x for x in licenses.scan(make(spark, rows), templates, {}, 0.7).collect()}
    for d, t in rows:
        won = plain_blocks(t, templates, 0.7)[1]
        assert got[d].labels == ",".join(sorted({templates[w[3]].label for w in won})) and abs(got[d].score - max([w[2] for w in won], default=0)) < 1e-12
        held = {(b.label, i) for b in got[d].blocks for i in range(b.first_word, b.last_word + 1)}
        assert held == {(templates[w[3]].label, i) for w in won for i in range(w[0], w[1] + 1)}
    with pytest.raises(ValueError):
        licenses.Index([TEMPLATE("x", "", "w " * 200_000)], {}, 0.8)


def general_jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark, corpus, tmp_path):
    make(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sampling.query(spark, str(tmp_path)).collect()}
    rows = sorted(corpus)
    errors = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        g = got[d]
        assert (g.n_chars, g.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        if len(words(t)) > 20:
            errors += [g.near_edited - general_jaccard(t, edited), g.near_next - general_jaccard(t, after)]
    assert len(got) == len(rows) and abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.3
    same = defaultdict(set)
    for d, t in rows:
        same[t].add(got[d].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    assert got[71].near_edited == 1.0 and got[71].fingerprint == ""


def test_fingerprints_odd_tables(spark):
    pair = lambda: lambda d, t, after: (d, t or "", after or "")
    run = lambda rows: sorted(tuple(r) for r in sampling.with_next(make(spark, rows), pair, "doc_id long, a string, b string").collect())
    assert run([(5, "x")]) == [(5, "x", "x")]
    assert run([(i, str(i)) for i in range(9)]) == [(i, str(i), str((i + 1) % 9)) for i in range(9)]
    assert run([(1, "a"), (1, "b"), (2, "c")]) == [(1, "a", "b"), (1, "b", "c"), (2, "c", "a")]
    assert len(run([(7, "same")] * 5)) == 5
    assert sampling.with_next(make(spark, [(1, "a")]).limit(0), pair, "doc_id long, a string, b string").count() == 0


def test_mixing_meets_targets(spark):
    r = random.Random(8)
    own = {"good": ["river", "stone", "house"], "low": ["zzz", "qqq"], "toxic": ["idiot", "moron"]}
    rows, truth = [], {}
    for i in range(300):
        d = "good" if i % 5 else r.choice(["low", "toxic"])
        truth[i] = d
        rows.append((i, " ".join(r.choice(own[d] if r.random() < 0.4 else ["the", "of", "and", "to"]) for _ in range(r.randint(20, 200)))))
    rows += [(900, None), (901, ""), (None, "the of")]
    domains = spark.createDataFrame([(i, truth[i]) for i in range(0, 300, 2)], "doc_id long, domain string")
    target = {"good": 0.7, "low": 0.2, "toxic": 0.1}
    names, found, log = mixing.mix(make(spark, rows).withColumn("domain", F.lit(0)).withColumn("rate", F.lit(0)), domains, target)
    got = {x.doc_id: x for x in found.collect()}
    assert len(got) == 303 and all(x.rate >= 0 for x in got.values())
    best = lambda x: names[int(np.argmax([x.p0, x.p1, x.p2]))]
    assert np.mean([best(got[i]) == truth[i] for i in range(1, 300, 2)]) > 0.95  # held out
    total = sum(x.tokens for x in got.values())
    assert log[-1]["state"] == "met"
    for i, d in enumerate(names):
        share = sum(x.rate * x.tokens * x[f"p{i}"] for x in got.values()) / total
        assert abs(share - target[d]) < 1e-3 and abs(log[-1]["share"][d] - share) < 1e-9
    assert sum(len(words(t)) for _, t in rows) == total


def plain_posteriors(rows, truth, names):
    """Smoothed document counts of hashed words, added up word by word."""
    bucket = lambda ws: set(ws)  # noqa: E731  the buckets are wide enough here: a word each
    docs = {d: {w.lower() for w in words(t)} for d, t in rows if d in truth}
    counts = {n: Counter(w for d, ws in docs.items() if truth[d] == n for w in bucket(ws)) for n in names}
    sums = {n: sum(counts[n].values()) for n in names}
    whole = sum(sums.values())
    weight = {}
    for w in set().union(*docs.values()):
        every = sum(counts[n][w] for n in names)
        ratio = [np.log((counts[n][w] + mixing.SMOOTHING) / (every * sums[n] / whole + mixing.SMOOTHING)) for n in names]
        if max(map(abs, ratio)) >= mixing.EVIDENCE:
            weight[w] = np.array(ratio)
    prior = np.log([sum(truth[d] == n for d in docs) / len(docs) for n in names])
    out = {}
    for d, t in rows:
        x = np.exp(prior + sum((weight[w] for w in {w.lower() for w in words(t)} if w in weight), np.zeros(len(names))))
        out[d] = x / x.sum()
    return out


def test_mixing_posteriors_and_rates_by_brute_force(spark, corpus):
    r = random.Random(12)
    rows = [(d, t) for d, t in corpus if d < 77]
    truth = {d: r.choice("xyz") for d, _ in rows[::2]}
    domains = spark.createDataFrame(list(truth.items()), "doc_id long, domain string")
    names, found = mixing.posteriors(make(spark, rows), domains)
    got = {x.doc_id: x for x in found.collect()}
    want = plain_posteriors(rows, truth, names)
    for d, _ in rows:
        assert np.allclose([got[d][f"p{i}"] for i in range(3)], want[d], atol=1e-9)
    # non-negative least squares with an anchor at 1, by plain projected gradients
    t = np.array([got[d].tokens for d in want], dtype=float)
    t /= t.sum()
    p = np.array([want[d] for d in want])
    goal = np.array([0.5, 0.3, 0.2])
    for ceiling in (None, 1.0):
        rated, log = mixing.rates(found, names, dict(zip(names, goal, strict=True)), ceiling=ceiling, ease=0.05, tolerance=1e-6)
        own = {x.doc_id: x.rate for x in rated.collect()}
        metric = np.linalg.pinv((p * t[:, None]).T @ p)
        x = np.ones(len(t))
        for _ in range(20_000):
            rest = (p * (t * x)[:, None]).sum(0) - goal
            x = np.clip(x - 0.04 * (p @ metric @ rest / 0.05 + x - 1), 0, ceiling)
        assert np.allclose([own[d] for d in want], x, atol=1e-4)
        assert log[-1]["state"] == ("met" if max(abs(v) for v in log[-1]["residual"].values()) <= 1e-6 else "nearest")


def test_mixing_reports_targets_out_of_reach(spark):
    post = spark.createDataFrame([(i, 100, 0.8, 0.2) for i in range(50)], "doc_id long, tokens long, p0 double, p1 double")
    _, log = mixing.rates(post, ["a", "b"], {"a": 0.5, "b": 0.5})
    assert log[-1]["state"] == "nearest" and log[-1]["residual"]["a"] > 0.05 > -0.05 > log[-1]["residual"]["b"]


def test_mixing_projection_and_sampling(spark):
    post = spark.createDataFrame([(i, 100, float(i % 4 > 0), float(i % 4 == 0)) for i in range(400)], "doc_id long, tokens long, p0 double, p1 double")
    rated, log = mixing.rates(post, ["a", "b"], {"a": 1.0, "b": 0.0}, ceiling=1.0)
    assert {(x.doc_id % 4 > 0, round(x.rate, 2)) for x in rated.collect()} == {(True, 1.0), (False, 0.0)}
    rated, _ = mixing.rates(post, ["a", "b"], {"a": 0.5, "b": 0.5}, budget=400 * 100)
    docs = make(spark, [(i, "x") for i in range(400)])
    n = Counter(x.doc_id % 4 == 0 for x in mixing.sample(docs, rated).collect())
    assert abs(n[True] - 200) <= 1 and abs(n[False] - 200) < 40
    assert mixing.rates(post.limit(0), ["a", "b"], {"a": 1.0})[0].count() == 0


def test_lines_of_many_texts_at_once_by_plain_python():
    """Leaves, templates and tokens of a batch are those of each line alone; and no Python runs for a line of the batch."""
    r = random.Random(31)
    word = lambda: r.choice(["a", "b", "a1", "7", "été", "x" * 30, "<*>"])
    texts = ["\n".join(r.choice(["", " ", "\t\r", "  "]) + r.choice([" ", "  ", "\x0b"]).join(word() for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 9))) for _ in range(400)]
    texts += ["", "\n", "a\n", "\na", "a b c", "a b c\n\n"]
    found, at, leaves, templates = lines.Lines([t.encode() for t in texts]), 0, defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for line in t.encode().split(b"\n"):
            tokens = tuple(b"<*>" if any(c in b"0123456789" for c in w) else w for w in line.split())
            assert (found.owner[at], found.n[at]) == (i, len(tokens))
            if tokens:
                assert lines.parse(line) == (found.leaf[at], found.template[at], list(tokens))
                leaves[len(tokens), tokens[:3]].add(found.leaf[at])
                templates[tokens].add(found.template[at])
            at += 1
    assert at == len(found.n)
    for kinds in (leaves, templates):
        assert all(len(k) == 1 for k in kinds.values()) and len(set.union(*kinds.values())) == len(kinds) > 100
    assert lines.clean([b"a b\n\nc 1\nd", b""], [found.template[:0], found.template[:0]]) == [(b"a b\n\nc 1\nd", 3, 0, 0.0), (b"", 0, 0, 0.0)]
    assert lines.clean([b"a b\n\nc 1\nd"], [np.array([lines.parse(b"c 22")[1]])]) == [(b"a b\n\nd", 3, 1, 0.4)]
    many = [prose(r, 10).encode() for _ in range(2000)]
    lines.Lines(many)
    start = time.process_time()
    lines.Lines(many)
    batch, start = time.process_time() - start, time.process_time()
    for t in many:
        for line in t.split(b"\n"):
            lines.parse(line)
    assert batch < 0.3 * (time.process_time() - start)

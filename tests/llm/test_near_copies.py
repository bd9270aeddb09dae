"""The pipeline's near-duplicate stage against Jaccard similarity of 5-word shingles."""

import random

import corpus_pipeline
from docweave.llm import nearcopies, simhash


def test_stage_removes_edited_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], set()
    for k in range(60):
        text = [word() for _ in range(200)]
        near, far = list(text), list(text)
        near[100] = word()  # 191 of 201 shingles in common
        for at in range(5, 200, 10):
            far[at] = word()
        rows += [(3 * k, " ".join(text)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
        want |= {3 * k, 3 * k + 2}
    rows += [(1000 + k, "one short text  here") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want | {1000}


def test_links_beyond_the_smallest_member(spark):
    """A chain of edits: neighbours are similar, the ends are not; one component all the same."""
    rng = random.Random(6)
    text = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(text)))
        for _ in range(3):
            text[rng.randrange(300)] = f"w{rng.randrange(10**9)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


def test_links_of_a_large_group_of_edited_copies_by_brute_force(spark):
    """Copies of one text at all distances: components as all pairs make them, and far fewer pairs than there are."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(150)]
    rows = []
    for k in range(150):
        text = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 14)):
            text[at] = word()
        rows.append((k, " ".join(text)))
    grams = {k: {tuple(t.split()[i : i + 5]) for i in range(146)} for k, t in rows}
    root = {k: k for k in grams}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in grams:
        for b in range(a):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in grams} and 1 < len(set(got.values())) < 100


def test_stage_takes_the_fingerprints_and_links_of_the_ball(spark):
    """Bands of so many rows that edited copies share no group: what is linked is linked by the ball, if similar."""
    rng = random.Random(8)
    rows, fps = [], {}
    for k in range(20):
        text = [f"w{rng.randrange(10**9)}" for _ in range(1500)]
        rows.append((2 * k, " ".join(text)))
        text[rng.randrange(100, 1400)] = "edited"
        rows.append((2 * k + 1, " ".join(text)))
    rows += [(100, "A b"), (101, "a  b"), (102, None), (103, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {k: simhash.fingerprint(t, 5) for k, t in rows}
    near = {k for k in range(0, 40, 2) if (fps[k] ^ fps[k + 1]).bit_count() <= 2}
    assert 5 < len(near) < 20
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, bands=1, rows=2000).collect()}
    assert {k for k in range(0, 40, 2) if got[k + 1] == k} >= near
    assert got[101] == 100 and got[103] == 102
    found = {r.doc_id: r for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
    assert {k: r.fp % 2**64 for k, r in found.items()} == fps
    assert all(found[k + 1].component_id == k for k in range(0, 40, 2))
    apart = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=0.999).collect()}
    assert all(apart[k] == k for k in range(40))  # 5 of 1500 runs differ: the ball's links are verified

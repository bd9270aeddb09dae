"""Every query of the subpackage over odd tables: nulls in any column, repeated rows, clashing names, empty tables."""

import hashlib

import pytest

import corpus_pipeline
from docweave.llm import common, queries

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
DOCS = [
    (1, "a b c\nd e f", "en", "s", 11, "x", 1), (1, "a b c\nd e f", "en", "s", 11, "x", 1), (2, None, None, None, None, None, None), (None, "no id here", "en", None, 10, None, 2), (None, None, None, None, None, None, None),
    (3, "", "en", "s", 0, "x", 1), (4, LONG, "en", "s", len(LONG), "x", 1), (5, LONG, "en", "s", len(LONG), "x", 1), (-7, " \n ", "en", "s", 3, "x", 1), (6, "é \x85\x0b|#|\U0001f600", "xx", "s", 7, "x", 1), (2**62, "tie", "en", "s", 3, "x", 1),
]
PAGES = [(1, "http://a.com/x", "h", "v"), (1, "http://a.com/x", "h", "v"), (None, "http://b.net/es/", None, None), (2, None, None, None), (3, "://", "", ""), (4, "HTTP://SPAM-FARM.example.org", "h", "v")]
TURNS = [(1, 0, "user", "hi", 5), (1, 0, "user", "hi", 5), (1, 1, None, None, None), (None, None, None, None, None), (2, 0, "user", "hi", 5), (3, None, "assistant", "", 5)]
LABELS = [(1, 1, 0, 1), (1, 0, 1, 1), (4, 1, 0, 1), (None, 1, 1, None), (5, None, None, None), (999, 1, 0, 1)]
#: Names that the operators use inside.
CLASHING = ["n_lines", "N_Dropped", "dropped_share", "copies_", "copy_", "rest_", "text_", "drop_", "k1_", "row_", "own_", "id_", "hash_", "kept_", "good", "rate", "tokens", "key", "groups", "a", "b", "k", "h", "p", "after", "score", "bucket", "label"]
KINDS = {
    "documents": ([(*row, *range(len(CLASHING))) for row in DOCS], "doc_id long, text string, lang string, source string, n_chars long, fp string, k1 long, " + ", ".join(f"{c} int" for c in CLASHING)),
    "pages": (PAGES, "page_id long, url string, html string, host string"),
    "conversations": (TURNS, "conv_id long, turn long, role string, text string, i long"),
    "labels": (LABELS, "doc_id long, quality int, toxic int, good int"),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    odd, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    for name, (rows, kind) in KINDS.items():
        df = spark.createDataFrame(rows, kind)
        df.repartition(2).write.parquet(f"{odd}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(odd), str(empty)


#: Rows of the result over the odd tables: one per row, or per document id where the operator says so.
ROWS = {"op1_mixing": 9, "op2_url_filter": len(PAGES), "op3_chat_format": 3, "op4_substring_dedup": len(DOCS), "op5_simhash": len(DOCS), "op6_quality": len(DOCS), "op8_line_dedup": len(DOCS), "op9_licenses": len(DOCS), "op10_fingerprints": len(DOCS)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


#: Some values of the results, by the docstrings: rows as tuples of the named columns.
VALUES = {
    "op1_mixing": (("doc_id", "tokens"), {(1, 12), (2, 0), (None, 3), (3, 0), (4, 30_000), (5, 30_000), (-7, 0), (6, 2), (2**62, 1)}),
    "op2_url_filter": (("page_id", "host", "path", "rule", "verdict"), {(1, "a.com", "/x", "com/", "allow"), (None, "b.net", "/es/", "net/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "spam-farm.example.org", "", None, "block")}),
    "op3_chat_format": (("conv_id", "n_turns"), {(1, 3), (None, 1), (3, 1)}),
    "op4_substring_dedup": (("doc_id", "n_words", "n_removed"), {(1, 6, 0), (2, 0, 0), (None, 3, 0), (None, 0, 0), (3, 0, 0), (4, 30_000, 0), (5, 30_000, 30_000), (-7, 0, 0), (6, 2, 0), (2**62, 1, 0)}),
    "op5_simhash": (("doc_id", "component_id"), {(1, 1), (2, -7), (None, None), (None, -7), (3, -7), (4, 4), (5, 4), (-7, -7), (6, 6), (2**62, 2**62)}),
    "op6_quality": (("doc_id", "n_words", "n_dup_lines", "base_failed"), {(1, 6, 0, True), (2, 0, 0, True), (None, 3, 0, True), (None, 0, 0, True), (3, 0, 0, True), (4, 30_000, 0, True), (5, 30_000, 0, True), (-7, 0, 0, True), (6, 2, 0, True), (2**62, 1, 0, True)}),
    "op8_line_dedup": (("doc_id", "n_lines", "n_dropped", "kept_sha256"), {(1, 2, 0, sha("a b c\nd e f")), (2, 0, 0, sha("")), (None, 1, 0, sha("no id here")), (None, 0, 0, sha("")), (3, 0, 0, sha("")), (4, 1, 0, sha(LONG)), (5, 1, 0, sha(LONG)), (-7, 0, 0, sha(" \n ")), (6, 1, 0, sha(DOCS[9][1])), (2**62, 1, 0, sha("tie"))}),
    "op9_licenses": (("doc_id", "n_words", "n_base", "labels", "score"), {(1, 6, 0, "", 0.0), (2, 0, 0, "", 0.0), (None, 3, 0, "", 0.0), (None, 0, 0, "", 0.0), (3, 0, 0, "", 0.0), (4, 30_000, 0, "", 0.0), (5, 30_000, 0, "", 0.0), (-7, 0, 0, "", 0.0), (6, 2, 0, "", 0.0), (2**62, 1, 0, "", 0.0)}),
    "op10_fingerprints": (("doc_id", "n_chars"), {(1, 11), (2, 0), (None, 10), (None, 0), (3, 0), (4, len(LONG)), (5, len(LONG)), (-7, 3), (6, 8), (2**62, 3)}),
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_and_empty(spark, tables, name):
    odd, empty = tables
    got = queries.queries()[name](spark, odd).collect()
    assert len(got) == ROWS[name] if name in ROWS else got
    if name in VALUES:
        columns, want = VALUES[name]
        assert {tuple(r[c] for c in columns) for r in got} == want
    assert queries.queries()[name](spark, empty).collect() == []


def test_stages_take_clashing_names(spark, tables):
    """Every stage over the odd table itself: all columns stay as they were, but for texts that change."""
    docs = common.table(spark, tables[0], "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables[0])
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == i for r in rows for i, c in enumerate(CLASHING)), name
        ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
        assert ids == {"quality rules": [1, 1], "line dedup": sorted(d[0] for d in DOCS if d[0] is not None), "near-duplicates": [-7, 1, 4, 6, 2**62], "mixing": ids}[name], name


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, f"text {i} " + " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 1) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {corpus_pipeline.near_dedup(spark, docs.repartition(n), "").first().text for n in (1, 2, 4)}
    assert len(kept) == 1


def test_odd_pipeline(spark, tables):
    odd, empty = tables
    assert {r.doc_id for r in corpus_pipeline.run(spark, odd).select("doc_id").collect()} <= {1}
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_packing_keeps_every_row(spark, tables):
    got = queries.queries()["op7_packing"](spark, tables[0]).collect()
    assert sum(r.length for r in got if r.start == 0 and r.doc_tokens == 1) == 4  # null, empty and blank texts: an end token
    assert len({(r.doc_id, r.start, r.sequence_id) for r in got}) == len(got)

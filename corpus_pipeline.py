"""The training-data pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next stage's
docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import common, lines, mixing, packing, quality, simhash

#: The mix of the pipeline: toxic and low documents go down to next to nothing.  With every document at most once, there
#: are fewer good tokens than this asks for (the report of the rates says 'nearest'): so good ones stay whole.
TARGETS = {"good": 0.98, "low": 0.01, "toxic": 0.01}
#: Clean pages can be short: the 50 words of op6's contract are for its query.
MIN_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those of less than ``MIN_WORDS`` words (null and empty ones too), those that repeat
    themselves, and those whose words are not the trusted ones.  Rows that share an id are judged each by their own text;
    all columns pass through."""
    return quality.filter_documents(docs, common.table(spark, sf_dir, "labels"), min_words=MIN_WORDS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and n_chars follows the text; null texts and texts without such lines stay as they are, a
    text of nothing else becomes empty.  All columns pass through, whatever their names."""
    counters = tuple(common.free_name(docs, c) for c in lines.COUNTERS)
    out = lines.drop_lines(docs, counters=counters)
    n_chars = F.when(F.col(counters[1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[n_chars.alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word similarity 0.8 and more stays, the one with the smallest doc_id.  Rows that
    repeat that id count once: the one with the smallest hash of all its columns stays.  Rows without an id stay as they
    are; null and empty texts are one group."""
    found = simhash.near_duplicates(docs, shingle=5, similarity=0.8).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_")).distinct()
    # both steps take the rows by their id: a single shuffle of the texts
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id_"), F.struct(*docs.columns).alias("row_"), common.row_hash(docs).alias("hash_"))
    kept = own.join(found, F.col("id_") == F.col("kept_"), "left_semi").groupBy("id_").agg(F.min_by("row_", "hash_").alias("row_")).select("row_.*")
    return kept.unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their rates, at most once each.  Rows that share an id (null included) have one rate and stay or go
    together; null and empty texts are rated by the domains' shares; all columns pass through, whatever their names."""
    domains = mixing.domains_of(common.table(spark, sf_dir, "labels"))
    _, rated, _ = mixing.mix(docs, domains, TARGETS, ceiling=1.0)
    return mixing.sample(docs, rated)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences: every row's text (null: empty) and an end token, each token in one piece."""
    return packing.digest(packing.pack(docs, packing.vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes, components, fitted rates and packing plans are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two stages is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage-{name.replace(' ', '-')}")
    return docs

"""Scripts on streams: row-local ones run on a streaming DataFrame as they do on a table.

``apply`` takes the native tier where the schema is known and the dynamic tier for documents as text.  Commands that
need more than a row (sorts, joins of collections, merges) raise Unsupported when the script is compiled, before the
stream starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..operators import document


def apply(stream: DataFrame, script: list | str, column: str | None = None, source: str = "json") -> DataFrame:
    """The transformed stream; ``column`` names a text column of documents, else each row is a document."""
    if column is None:
        return document.transform(stream, script)
    return Engine().documents(stream, script, column, source)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that is there as Parquet, exactly once across restarts (the checkpoint holds the progress)."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table in a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)

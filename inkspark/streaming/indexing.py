"""Incremental indexing: a stream over a vault's files that parses, chunks and writes new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import chunking
from inkspark.sources import files


def chunk_notes(notes: DataFrame, size: int = 512, overlap: int = 75) -> DataFrame:
    """path, title, chunk, text, n_tokens, content_sha, source_type of the notes' chunks."""
    cut = chunking.chunk(notes, "path", "content", "structure", F.lit(size), F.lit(overlap))
    about = notes.select("path", "title", F.sha2("content", 256).alias("content_sha"))
    return cut.join(about, "path").withColumn("source_type", F.lit("vault"))


def index_new_files(spark: SparkSession, vault: str, out: str, checkpoint: str, size: int = 512) -> None:
    """Index the files that came since the last call and return.

    Every micro-batch overwrites its own folder batch=N of out, so that a batch that is run again after a
    failure writes the same rows once. Changed and deleted files are found by ledger.changes instead.
    """
    stream = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").format("text").load(vault)

    def write(rows: DataFrame, batch: int) -> None:
        chunk_notes(files.notes_of(rows), size).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    named = files._named(stream)
    named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

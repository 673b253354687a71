"""Notes, their link graph and the tables of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as T


def first_loaded(rows: DataFrame, key: str, loaded: str = "ingested_at") -> DataFrame:
    """One row per key, the first loaded; rows with a null key are left out."""
    others = [c for c in rows.columns if c != key]
    once = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), loaded).alias("r"))
    return once.select(key, *[F.col("r")[c].alias(c) for c in others])


def note_links(notes: DataFrame) -> DataFrame:
    """note_id, link_pos (from 0) and target of every link of the content."""
    return notes.select("note_id", F.posexplode(T.wikilinks(F.col("content"))).alias("link_pos", "target"))


def link_graph(notes: DataFrame) -> DataFrame:
    """src_id, link_pos, dst_id of the links whose target is the title or stem of a note.

    Where several notes share a name, the last by path wins, a stem over a title of the same path.
    Links without a target note are dropped; repeats and links to the note itself stay.
    """
    names = notes.select("note_id", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("title").alias("name")), F.struct(F.lit(1).alias("kind"), F.col("stem").alias("name")))).alias("n"))
    target = names.where("n.name is not null").groupBy(F.col("n.name").alias("target")).agg(F.max_by("note_id", F.struct(F.coalesce("path", F.lit("")), "n.kind", "note_id")).alias("dst_id"))
    return note_links(notes).join(target, "target").select(F.col("note_id").alias("src_id"), "link_pos", "dst_id")


def expand(hits: DataFrame, graph: DataFrame, max_links: int = 3, penalty: float = 0.1) -> DataFrame:
    """hits (query_id, note_id, score) and, behind them, the notes they link to.

    Each hit gives its first max_links links, before notes already hit are taken out; new ones score the
    query's lowest hit less the penalty, at least 0. hop says 0 or 1.
    """
    lowest = hits.groupBy("query_id").agg(F.greatest(F.lit(0.0), F.min(F.coalesce("score", F.lit(0.0))) - penalty).alias("score"))
    out = graph.where(F.col("link_pos") < max_links).select(F.col("src_id").alias("note_id"), "dst_id")
    new = hits.join(out, "note_id").select("query_id", F.col("dst_id").alias("note_id")).distinct()
    new = new.join(hits.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti").join(lowest, "query_id")
    return hits.select("query_id", "note_id", "score", F.lit(0).alias("hop")).unionByName(new.select("query_id", "note_id", "score", F.lit(1).alias("hop")))


def sections(notes: DataFrame) -> DataFrame:
    """note_id, section (from 0) and text of each heading section; # within code fences is no heading.

    Empty and null contents give no section.
    """
    from pyspark.sql import Window as W

    content = F.regexp_replace("content", r"\r\n?", "\n")
    lines = notes.where("content is not null and content <> ''").select("note_id", F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    order = W.partitionBy("note_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    fenced = F.sum(F.col("line").rlike("^```|^~~~").cast("int")).over(order) % 2
    marked = lines.withColumn("head", (F.col("line").rlike("^#{1,6} ") & (fenced == 0)).cast("int"))
    numbered = marked.withColumn("section", F.sum("head").over(order))
    joined = numbered.groupBy("note_id", "section").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return joined.select("note_id", F.col("section").cast("int").alias("section"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def parent_context(chunks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """chunks with total_chunks and parent_summary (first 200 characters of the first three chunks, cut to 500)."""
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", F.substring(text, 1, 200).alias("s")))))
    from pyspark.sql import Window as W

    ranked = chunks.withColumn("rank", F.row_number().over(W.partitionBy(doc).orderBy(order)))
    per_doc = ranked.groupBy(doc).agg(F.count("*").alias("total_chunks"), first.alias("f"))
    summary = F.substring(F.array_join(F.transform("f", lambda x: x["s"]), " "), 1, 500)
    return chunks.join(per_doc.select(doc, "total_chunks", summary.alias("parent_summary")), doc)

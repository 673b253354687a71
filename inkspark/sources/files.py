"""Vaults of Markdown notes, exported chats, evaluation cases and index tables on a file system."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import text as T


def _check_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(hadoop).isDirectory():
        raise NotADirectoryError(path)


def read_texts(spark: SparkSession, path: str, extension: str = ".md") -> DataFrame:
    """path, file_name, stem and content of the files below path with that extension, whole."""
    _check_folder(spark, path)
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").text(path, wholetext=True)
    return _named(rows)


def _named(rows: DataFrame) -> DataFrame:
    plain = F.try_url_decode(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"), "^file:/+", "/"))
    name = F.regexp_extract(plain, "[^/]*$", 0)
    return rows.select(plain.alias("path"), name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("value").alias("content"))


def _scalar(value: str) -> object:
    value = value.strip()
    if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
        return value[1:-1]
    if value.startswith("[") and value.endswith("]"):
        return [_scalar(x) for x in value[1:-1].split(",") if x.strip()]
    return value


def parse_frontmatter(body: str) -> str:
    """JSON of a block of key: value lines, with inline lists and lists of - items; deeper nesting stays text."""
    out: dict = {}
    key = ""
    for line in body.splitlines():
        if m := re.match(r"([\w-]+):\s*(.*)$", line):
            key = m[1]
            out[key] = _scalar(m[2]) if m[2].strip() else []
        elif (m := re.match(r"\s*-\s+(.*)$", line)) and isinstance(out.get(key), list):
            out[key].append(_scalar(m[1]))
    return json.dumps(out, ensure_ascii=False)


def notes_of(texts: DataFrame) -> DataFrame:
    """Notes of texts (path, file_name, stem, content): title, content without frontmatter, frontmatter as JSON, wikilinks, tags and dates.

    The title is the frontmatter's, else the stem. Tags are the frontmatter's (a list or one string) and
    those of the content. extra keeps the frontmatter without title, tags and dates.
    """
    block = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
    has = F.col("content").rlike(block)
    parse = F.pandas_udf(lambda s: s.map(lambda x: parse_frontmatter(x) if isinstance(x, str) else None), "string")
    rows = texts.withColumn("frontmatter", parse(F.when(has, F.regexp_extract("content", block, 1))))
    body = F.when(has, F.regexp_replace("content", block, "")).otherwise(F.col("content"))
    get = lambda k: F.get_json_object("frontmatter", f"$.{k}")
    given = F.when(get("tags").startswith("["), F.from_json(get("tags"), "array<string>")).when(get("tags") != "", F.array(get("tags")))
    known = ["title", "tags", "created", "modified"]
    extra = F.to_json(F.map_filter(F.from_json(F.coalesce("frontmatter", F.lit("{}")), "map<string,string>"), lambda k, v: ~k.isin(known)))
    return rows.select(
        "path", "file_name", "stem", F.coalesce(F.nullif(get("title"), F.lit("")), "stem").alias("title"), body.alias("content"), "frontmatter",
        T.wikilinks(body).alias("wikilinks"), T.tags(body, given).alias("tags"), get("created").alias("created_date"), get("modified").alias("modified_date"), extra.alias("extra"),
    )


def read_vault(spark: SparkSession, path: str, extension: str = ".md") -> DataFrame:
    """Notes of a vault; a missing path or a file in its place is an error, an empty folder gives no rows."""
    return notes_of(read_texts(spark, path, extension))


TURN_HEAD = r"(?im)^###[ \t]+(USER|ASSISTANT|HUMAN)[ \t]*(?:\(([^)\n]*)\))?[ \t]*$"
TURN = rf"(?sd){TURN_HEAD}(.*?)(?=^###[ \t]+(?:USER|ASSISTANT|HUMAN)\b|^---|\z)"


def conversations_of(texts: DataFrame) -> DataFrame:
    """Conversations of exported chats: title, source, date, metadata, turns and totals.

    The title is the first line's heading, else the stem. The source is that of the metadata in upper
    case, unless the path names one. Numbers may have commas. A turn ends at the next turn or rule; turns
    without text, and conversations without turns, are left out.
    """
    rows = texts.where(~F.upper("file_name").startswith("INDEX") & F.lower("path").contains("conversations"))
    rows = rows.withColumn("content", F.regexp_replace("content", r"\r\n?", "\n"))
    head = F.regexp_extract("content", r"(?s)## Metadata\s*\n(.*?)(?:\n---|\z)", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda x: F.struct(F.regexp_replace(F.lower(F.trim(F.regexp_extract(x, r"^- \*\*(.+?)\*\*:", 1))), " ", "_").alias("key"), F.trim(F.regexp_extract(x, r"^- \*\*.+?\*\*:(.*)$", 1)).alias("value"))), lambda p: p["key"] != "")
    # Of repeated keys the last one counts.
    metadata = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    parts = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(TURN), F.lit(i)).alias(n) for i, n in ((1, "role"), (2, "time"), (3, "body"))])
    turns = F.transform(parts, lambda t: F.struct(F.when(F.lower(t["role"]) == "human", "user").otherwise(F.lower(t["role"])).alias("role"), F.trim(F.regexp_replace(t["body"], r"^\s+|\s+$", "")).alias("content"), F.nullif(F.trim(t["time"]), F.lit("")).alias("timestamp")))
    rows = rows.withColumn("metadata", metadata).withColumn("turns", F.filter(turns, lambda t: t["content"] != "")).where(F.size("turns") > 0)
    number = lambda k: F.regexp_replace(F.col("metadata")[k], ",", "").try_cast("long")
    p = F.lower("path")
    source = F.when(p.contains("chatgpt"), "CHATGPT").when(p.contains("claude"), "CLAUDE").when(p.contains("gemini"), "GEMINI").otherwise(F.coalesce(F.upper(F.col("metadata")["source"]), F.lit("UNKNOWN")))
    day = F.try_to_date(F.nullif(F.regexp_extract("file_name", r"^(\d{8})_", 1), F.lit("")), "yyyyMMdd").cast("string")
    first = F.regexp_extract("content", r"^# (.+)", 1)
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.length(t["content"]))
    return rows.select(
        "path", F.when(first != "", F.trim(first)).otherwise(F.col("stem")).alias("title"), source.alias("source"), F.coalesce(F.col("metadata")["date"], day).alias("date"), "turns",
        F.coalesce(number("total_messages"), F.size("turns").cast("long")).alias("total_messages"), F.coalesce(number("total_characters"), chars).alias("total_characters"), "metadata",
    )


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return conversations_of(read_texts(spark, path))


CASES = "question string, ground_truth string, expected_sources array<string>, metadata map<string,string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array; question and ground truth are required."""
    return spark.read.schema(CASES).json(path, multiLine=True).where("question is not null and ground_truth is not null")


MODES = {"create": "errorifexists", "append": "append", "overwrite": "overwrite"}


def write_index(chunks: DataFrame, path: str, mode: str = "create") -> None:
    """Write chunks as a table parted by source_type; mode: create, append or overwrite."""
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {', '.join(MODES)}")
    chunks.write.mode(MODES[mode]).partitionBy("source_type").parquet(path)


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read there; any error counts as no."""
    try:
        spark.read.parquet(path).schema
        return True
    except Exception:
        return False


def read_index(spark: SparkSession, path: str, source_types: list[str] | None = None) -> DataFrame:
    """The chunks of an index, of some source types only if given, which prunes partitions; rows without text are left out."""
    rows = spark.read.parquet(path).where("text is not null")
    return rows.where(F.col("source_type").isin(source_types)) if source_types else rows


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """path of what is processed; a missing or unreadable table counts as empty."""
    try:
        return spark.read.parquet(path).select("path").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "path string")


def mark_processed(rows: DataFrame, path: str) -> None:
    rows.select("path").write.mode("append").parquet(path)


def write_report(report: DataFrame, detail: DataFrame, folder: str, name: str) -> None:
    """The report as JSON and the cases as CSV with a header."""
    report.write.mode("overwrite").json(f"{folder}/{name}_report")
    detail.write.mode("overwrite").csv(f"{folder}/{name}_detailed", header=True)

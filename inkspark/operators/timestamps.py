"""Normalised timestamps of the three record kinds (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions.timestamps import normalize_timestamps, render

KINDS = (("conversation", "conversations", "conv_id", "date"), ("turn", "turns", "turn_id", "timestamp"), ("note", "notes", "note_id", "created_date"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_type, rec_id, raw, home_zone, date_order of all three kinds; a missing account leaves both null."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    accounts = read("accounts").groupBy("account_id").agg(F.min("home_zone").alias("home_zone"), F.min("date_order").alias("date_order"))
    rows = None
    for kind, table, key, raw in KINDS:
        part = read(table).select(F.lit(kind).alias("rec_type"), F.col(key).alias("rec_id"), F.col(raw).alias("raw"), "account_id")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(accounts, "account_id", "left").drop("account_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: one row per record whose raw value names exactly one instant or one day.

    Repeated rows of a key count once; should they disagree, the earliest value stands. Rows with a
    null key are left out.
    """
    rows = normalize_timestamps(raw_records(spark, sf_dir).where("rec_id is not null and raw is not null"), "raw", "home_zone", "date_order")
    code = F.shiftleft("ts_micros", 1) + F.when(F.col("ts_status") == "day", 1).otherwise(0)
    one = rows.where("ts_micros is not null").groupBy("rec_type", "rec_id").agg(F.min(code).alias("code"))
    value = render(F.shiftright("code", 1), F.col("code") % 2 != 0)
    return one.select("rec_type", "rec_id", value.alias("norm_value"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_formats: rows by kind, matched pattern (none: null) and status, over every row."""
    rows = normalize_timestamps(raw_records(spark, sf_dir), "raw", "home_zone", "date_order")
    return rows.groupBy("rec_type", "ts_format", "ts_status").agg(F.count("*").alias("n_rows"))

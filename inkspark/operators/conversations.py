"""Chat turns: roles, context, totals, rendering and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspark.functions import text as T
from inkspark.operators.chunking import sentences


def role(column: str) -> Column:
    """user or assistant whatever the spelling; human is user."""
    r = F.lower(F.trim(column))
    return F.when(r == "human", "user").otherwise(r)


def turn_context(turns: DataFrame) -> DataFrame:
    """turn_id, conv_id, turn_index, role, content with the first 200 characters of the turns before and after, null at the ends."""
    w = W.partitionBy("conv_id").orderBy("turn_index", "turn_id")
    near = lambda c: T.excerpt(c)
    return turns.where("content is not null and trim(content) <> ''").select(
        "turn_id", "conv_id", "turn_index", role("role").alias("role"), "content",
        near(F.lag("content").over(w)).alias("previous"), near(F.lead("content").over(w)).alias("next"),
    )


def totals(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_user, n_chars of the turns with content."""
    rows = turns.where("content is not null and trim(content) <> ''")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count(F.when(role("role") == "user", 1)).alias("n_user"), F.sum(F.length("content")).alias("n_chars"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id and text: the turns in order, each under a heading with role and time."""
    stamp = F.when(F.coalesce(F.trim("timestamp"), F.lit("")) != "", F.concat(F.lit(" ("), F.trim("timestamp"), F.lit(")"))).otherwise("")
    piece = F.concat(F.lit("### "), F.upper(F.coalesce(role("role"), F.lit("unknown"))), stamp, F.lit("\n\n"), F.trim("content"))
    rows = turns.where("content is not null and trim(content) <> ''").select("conv_id", "turn_index", "turn_id", piece.alias("piece"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_index", "turn_id", "piece"))), lambda x: x["piece"]), "\n\n").alias("text"))


def chunks(turns: DataFrame, size: int = 512, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, chunk, first_turn, last_turn, n_tokens, text: whole turns under their roles, packed in order while they fit size tokens.

    The first chunk of a conversation begins with its title, where conversations (conv_id, title) has one.
    A turn above the size is cut at sentences into chunks of its own, behind what came before it. Turns
    arrive sorted, so a task holds one chunk at a time however long the conversation.
    """
    names = ["conv_id", "chunk", "first_turn", "last_turn", "n_tokens", "text"]
    tokens = lambda words: words * 13 // 10

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, number, now, words = None, 0, [], 0  # now: turn and text of what waits

        def close(out: list) -> None:
            nonlocal number, now, words
            if now:
                out.append((conv, number, now[0][0], now[-1][0], tokens(words), "\n\n".join(x for _, x in now)))
                number, now, words = number + 1, [], 0

        for b in batches:
            out: list = []
            for this, turn, head, text in zip(b["conv_id"], b["turn_index"], b["title"], b["text"]):
                if this != conv:
                    close(out)
                    conv, number = this, 0
                    if isinstance(head, str) and head.strip():
                        now, words = [(turn, f"# {head.strip()}")], len(head.split()) + 1
                n = len(text.split())
                if tokens(words + n) > size:
                    close(out)
                for part in [text] if tokens(n) <= size else sentences(text, size, 0):
                    if tokens(words + len(part.split())) > size:
                        close(out)
                    now, words = [*now, (turn, part)], words + len(part.split())
                if tokens(n) > size:
                    close(out)
            yield pd.DataFrame(out, columns=names)
        out = []
        close(out)
        yield pd.DataFrame(out, columns=names)

    rows = turns.where("conv_id is not null and content is not null and trim(content) <> ''")
    text = F.concat(F.lit("### "), F.upper(F.coalesce(role("role"), F.lit("unknown"))), F.lit("\n\n"), F.trim("content"))
    rows = rows.select("conv_id", F.coalesce("turn_index", F.lit(0)).alias("turn_index"), "turn_id", text.alias("text"))
    if conversations is not None:
        rows = rows.join(conversations.where("conv_id is not null").groupBy("conv_id").agg(F.min("title").alias("title")), "conv_id", "left")
    else:
        rows = rows.withColumn("title", F.lit(None).cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_index", "turn_id").select("conv_id", "turn_index", "title", "text")
    return ordered.mapInPandas(run, "conv_id long, chunk int, first_turn int, last_turn int, n_tokens long, text string")

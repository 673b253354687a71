"""Splitting oversized notes at natural boundaries (problem 1).

A text larger than its limit starts as atomic segments (sentences and lines, cut further only where one
alone is too large). Adjacent pairs wait in a heap; the pair with the weakest boundary between them is
merged first, as long as the merged segment and the overlap fit the limit. What is left are the
pieces; each begins with the last words of the one before.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"([^ \t\r\n]+)([ \t\r\n]*)")
#: Strength of the boundary before a word.
INSIDE, CLAUSE, SENTENCE, LINE, BLANK_LINE, RULE, HEADING = range(7)
SPANS = "array<struct<start:int,core:int,end:int,words:int,pieces:int>>"


def words_of(text: str):
    """Number of words (runs of characters that aren't white space); 0 for null, empty and blank texts."""
    trimmed = F.regexp_replace(F.col(text), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(F.size(F.split(trimmed, r"[ \t\r\n]+")))


def tokens_of(words):
    """Words times 1.3, cut to a whole number."""
    return F.floor(words * 13 / F.lit(10)).cast("long")


def most_words(tokens: int) -> int:
    """The largest number of words that come to at most so many tokens."""
    return (10 * (tokens + 1) - 1) // 13


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Where each word begins, and the strength of the boundary before it; lines of code blocks don't count as such."""
    starts, strength, last, gap, fenced = [], [], "", "", False
    for m in WORD.finditer(text):
        word = m[1]
        lines = gap.count("\n") or gap.count("\r")
        mark = not starts or lines > 0
        fence = mark and word[:3] in ("```", "~~~")
        if not lines:
            s = SENTENCE if last[-1:] in ".!?。！？" else CLAUSE if last[-1:] in ",;:，；：" else INSIDE
        elif fenced:
            s = BLANK_LINE if fence else CLAUSE
        elif word[0] == "#" and not word.strip("#"):
            s = HEADING
        elif word.startswith("---"):
            s = RULE
        else:
            s = BLANK_LINE if lines > 1 else LINE
        if fence:
            fenced = not fenced
        starts.append(m.start())
        strength.append(s if starts[:-1] else INSIDE)
        last, gap = word, m[2]
    return starts, strength


def atoms(strength: list[int], most: int, least: int) -> list[int]:
    """First words of the atomic segments: at sentence ends and stronger, then inside segments of more than most words.

    The first segment has at least least words, so that the second piece finds its overlap.
    """
    firsts = [i for i, s in enumerate(strength) if i == 0 or s >= SENTENCE]
    out = []
    for lo, hi in zip(firsts, [*firsts[1:], len(strength)]):
        out.append(lo)
        if hi - lo > most:
            inner = [i for i in range(lo + 1, hi) if strength[i] == CLAUSE]
            for a, b in zip([lo, *inner], [*inner, hi]):
                if a != lo:
                    out.append(a)
                out.extend(range(a + most, b, most))
    return [x for x in out if x == 0 or x >= least]


def merge(firsts: list[int], strength: list[int], n: int, most: int, most_first: int) -> list[int]:
    """First words of the pieces after merging the weakest boundaries first; the first piece, without overlap, may be larger."""
    end = [*firsts[1:], n]
    size = [b - a for a, b in zip(firsts, end)]
    left, right = list(range(-1, len(firsts) - 1)), [*range(1, len(firsts)), -1]
    alive = [True] * len(firsts)
    heap = [(strength[firsts[i + 1]], size[i] + size[i + 1], i, i + 1) for i in range(len(firsts) - 1)]
    heapq.heapify(heap)
    while heap:
        _, total, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b] and right[a] == b and size[a] + size[b] == total) or total > (most if a else most_first):
            continue
        size[a], alive[b], right[a] = total, False, right[b]
        if right[a] >= 0:
            left[right[a]] = a
            heapq.heappush(heap, (strength[firsts[right[a]]], total + size[right[a]], a, right[a]))
        if left[a] >= 0:
            heapq.heappush(heap, (strength[firsts[a]], total + size[left[a]], left[a], a))
    return [f for f, x in zip(firsts, alive) if x]


def spans(text: str, size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Start, start without overlap, end (in characters) and words of each piece of a text above the limit.

    The parts from start without overlap to end, put together, are the text. An overlap that leaves no
    room is cut to one word less than the limit.
    """
    starts, strength = boundaries(text)
    n, limit = len(starts), max(1, most_words(size))
    shared = min(-(-overlap * 10 // 13), limit - 1) if overlap > 0 else 0
    firsts = merge(atoms(strength, limit - shared, shared), strength, n, limit - shared, limit)
    out = []
    for i, (a, b) in enumerate(zip(firsts, [*firsts[1:], n])):
        first = max(0, a - shared) if i else 0
        out.append((starts[first] if i else 0, starts[a] if i else 0, starts[b] if b < n else len(text), b - first))
    return out


def _spans(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    cut = [spans(*x) for x in zip(text, size, overlap)]
    return pd.Series([[dict(zip(("start", "core", "end", "words"), s), pieces=len(c)) for s in c] for c in cut])


def _large(text: str, size: str):
    return F.col(text).isNotNull() & (F.col(size) > 0) & (tokens_of(words_of(text)) > F.col(size))


def _cut(large: DataFrame, key: str) -> DataFrame:
    """The pieces of key, text, size, overlap."""
    spans_of = F.pandas_udf(_spans, SPANS)("text", F.col("size").cast("int"), F.coalesce("overlap", F.lit(0)).cast("int"))
    # The number of pieces comes with each span, for a filter on it to stay behind the explode.
    each = large.select(key, "text", F.posexplode(spans_of).alias("piece_idx", "s"))
    s = F.col("s")
    return each.select(
        key, "piece_idx", s["pieces"].alias("n_pieces"), s["start"].alias("char_start"), s["core"].alias("core_start"), s["end"].alias("char_end"),
        tokens_of(s["words"]).alias("n_tokens"), F.substring("text", s["start"] + 1, s["end"] - s["start"]).alias("piece"),
    )


def split_oversized(rows: DataFrame, key: str, text: str, size: str, overlap: str) -> DataFrame:
    """key, piece_idx, n_pieces, char_start, core_start, char_end, n_tokens, piece of the rows whose text is above size tokens.

    Tokens are words times 1.3. Null keys, texts and sizes, and texts within the size give no rows; a null
    overlap is 0. Other columns of rows are not read. piece is text[char_start:char_end]; it shares
    overlap tokens with the piece before, up to core_start.
    """
    rows = rows.select(F.col(key), F.col(text).alias("text"), F.col(size).alias("size"), F.col(overlap).alias("overlap"))
    return _cut(rows.where(F.col(key).isNotNull() & _large("text", "size")), key)


def note_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_pieces: the pieces of every note above the chunk_size of its config; repeated rows of a note count once (the first loaded)."""
    notes = spark.read.parquet(f"{sf_dir}/notes.parquet").select("note_id", "content", "config_id", "ingested_at")
    config = spark.read.parquet(f"{sf_dir}/embedding_config.parquet").groupBy("config_id").agg(F.max("chunk_size").alias("chunk_size"), F.max("chunk_overlap").alias("chunk_overlap"))
    large = notes.join(config, "config_id").where(F.col("note_id").isNotNull() & _large("content", "chunk_size"))
    once = large.groupBy("note_id").agg(F.min_by(F.struct("content", "chunk_size", "chunk_overlap"), "ingested_at").alias("n"))
    return _cut(once.select("note_id", F.col("n.content").alias("text"), F.col("n.chunk_size").alias("size"), F.col("n.chunk_overlap").alias("overlap")), "note_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: the notes that come out in pieces."""
    return note_pieces(spark, sf_dir).where("piece_idx = 0 and n_pieces > 1").select("note_id")

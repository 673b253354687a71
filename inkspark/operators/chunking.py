"""Chunkers of single texts, and chunk vectors. The folds are inherently sequential per text and run as Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspark.functions import text as T
from inkspark.operators import vault

LIST_LINE = re.compile(r"(?:[-*] |[1-9]\. )")
SENTENCE = r"(?<=[.!?。！？])\s+"
#: Tokens of a section whose vector late chunking blends into the vectors of its chunks.
SECTION = 8192


def _tokens(words: int) -> int:
    return words * 13 // 10


def _most_words(tokens: int) -> int:
    return max(1, (10 * (tokens + 1) - 1) // 13)


def _fitting(part: str, most: int) -> list[str]:
    """The part, cut between words where it alone has more than most of them."""
    words = part.split()
    return [part] if len(words) <= most else [" ".join(words[i : i + most]) for i in range(0, len(words), most)]


def structure(text: str, size: int) -> list[str]:
    """Lines packed to about size tokens, cut only at blank lines and headings, never within code or a list."""
    out, now, words, fenced = [], [], 0, False
    for line in text.split("\n"):
        bare = line.lstrip()
        if bare.startswith("```"):
            fenced = not fenced
        elif not fenced and not LIST_LINE.match(bare) and _tokens(words) > size and (line.startswith("#") or not line.strip()):
            out.append("\n".join(now))
            now, words = [], 0
            if not line.strip():
                continue
        now.append(line)
        words += len(line.split())
    if "".join(now).strip():
        out.append("\n".join(now))
    return out


def sentences(text: str, size: int, overlap: int) -> list[str]:
    """Sentences packed up to size tokens, longer ones cut between words; each chunk begins with the last sentences of the one before that fit overlap."""
    most = _most_words(size)
    parts = [x for p in text.split("\n\n") for s in re.split(SENTENCE, p) if s.strip() for x in _fitting(s, most)]
    out, now, words, fresh = [], [], 0, 0
    for s in parts:
        n = len(s.split())
        if fresh and words + n > most:
            out.append(" ".join(x for x, _ in now))
            kept, room = [], min(_most_words(overlap) if overlap > 0 else 0, most - n)
            for x, m in reversed(now):
                if m > room:
                    break
                kept.insert(0, (x, m))
                room -= m
            now, words, fresh = kept, sum(m for _, m in kept), 0
        now.append((s, n))
        words, fresh = words + n, fresh + 1
    if fresh:
        out.append(" ".join(x for x, _ in now))
    return out


def paragraphs(text: str, size: int) -> list[str]:
    """Paragraphs packed up to size tokens; a larger paragraph is cut at sentence ends, and a larger sentence between words."""
    out, now, words, most = [], [], 0, _most_words(size)
    for p in (p for p in re.split(r"\n\s*\n", text) if p.strip()):
        for part in [p] if len(p.split()) <= most else [x for s in re.split(SENTENCE, p) if s.strip() for x in _fitting(s, most)]:
            n = len(part.split())
            if now and words + n > most:
                out.append("\n\n".join(now))
                now, words = [], 0
            now.append(part)
            words += n
    if now:
        out.append("\n\n".join(now))
    return out


FOLDS = {
    "structure": lambda text, size, overlap: structure(text, size),
    "sentences": sentences,
    "paragraphs": lambda text, size, overlap: paragraphs(text, size),
}


def chunk(rows: DataFrame, key: str, text: str, strategy: str, size: Column, overlap: Column) -> DataFrame:
    """key, chunk (from 0), text and n_tokens by one of FOLDS; null and empty texts give none."""
    fold = FOLDS[strategy]

    def run(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([fold(*x) for x in zip(text, size, overlap)])

    cut = rows.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.pandas_udf(run, "array<string>")(text, size.cast("int"), overlap.cast("int")).alias("c"))
    return cut.select(key, F.posexplode("c").alias("chunk", "text")).withColumn("n_tokens", T.approx_tokens(F.col("text")))


Embedder = Callable[[Column], Column]


def semantic(rows: DataFrame, key: str, text: str, embed: Embedder, percentile: float = 0.95) -> DataFrame:
    """key, chunk and text: sentences, cut where neighbouring ones are farther apart than that percentile of their text.

    A sentence is embedded together with the one before and the one after.
    """
    cut = rows.where(F.col(text).rlike(r"\S")).select(key, F.posexplode(F.filter(F.split(text, SENTENCE), lambda x: x.rlike(r"\S"))).alias("pos", "sentence"))
    w = W.partitionBy(key).orderBy("pos")
    around = F.concat_ws(" ", F.lag("sentence").over(w), "sentence", F.lead("sentence").over(w))
    vectors = cut.select(key, "pos", "sentence", around.alias("around")).select(key, "pos", "sentence", embed(F.col("around")).alias("vector"))
    segments = semantic_breaks(vectors, key, "pos", "vector", percentile).select(key, "pos", "segment")
    joined = vectors.select(key, "pos", "sentence").join(segments, [key, "pos"]).groupBy(key, F.col("segment").cast("int").alias("chunk"))
    return joined.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


def late_chunks(rows: DataFrame, key: str, text: str, size: Column, overlap: Column, embed: Embedder, alpha: float = 0.7, section: int = SECTION) -> DataFrame:
    """key, section, chunk, text, embedding: sentence chunks whose vectors are blended with that of their section.

    A section has up to section tokens of whole paragraphs. Vectors are null where text has no terms.
    """
    given = rows.select(F.col(key).alias("k"), F.col(text).alias("content"), size.alias("size"), overlap.alias("overlap"))
    sections = chunk(given, "k", "content", "paragraphs", F.lit(section), F.lit(0)).join(given.select("k", "size", "overlap").dropDuplicates(["k"]), "k")
    sections = sections.select(F.struct("k", F.col("chunk").alias("section")).alias("s"), "text", "size", "overlap")
    chunks = chunk(sections, "s", "text", "sentences", F.col("size"), F.col("overlap"))
    whole = sections.select("s", embed(F.col("text")).alias("whole"))
    blended = chunks.withColumn("own", embed(F.col("text"))).join(whole, "s")
    return blended.select(F.col("s.k").alias(key), F.col("s.section").alias("section"), "chunk", "text", "n_tokens", blend(F.col("own"), F.col("whole"), alpha).alias("embedding"))


STRATEGIES = ("obsidian_aware", "markdown_semantic", "semantic", "markdown", "late_chunking", "simple")


def split(rows: DataFrame, key: str, text: str, strategy: str, size: Column, overlap: Column, embed: Embedder, alpha: float = 0.7) -> DataFrame:
    """key, chunk (from 0), text, n_tokens and, for late_chunking, embedding, by one of STRATEGIES; another name counts as simple.

    obsidian_aware cuts at headings, then by structure, and what is still above size by meaning;
    markdown_semantic leaves out the structure, semantic the headings too; markdown cuts at headings only.
    What meaning leaves above size is cut at sentences. simple packs sentences. Give one row per key.
    Null and blank texts give no chunks.
    """
    given = rows.select(F.col(key).alias("k"), F.col(text).alias("content"), size.alias("size"), overlap.alias("overlap")).where(F.col("k").isNotNull() & F.col("content").rlike(r"\S"))
    if strategy == "late_chunking":
        late = late_chunks(given, "k", "content", F.col("size"), F.col("overlap"), embed, alpha)
        return _numbered(late, key, "section", "chunk").select(key, "chunk", "text", "n_tokens", "embedding")
    if strategy not in STRATEGIES or strategy == "simple":
        return chunk(given, "k", "content", "sentences", F.col("size"), F.col("overlap")).withColumnRenamed("k", key)
    limits = given.select("k", "size")
    parts = given.select("k", F.lit(0).alias("section"), F.col("content").alias("text"))
    if strategy != "semantic":
        parts = vault.sections(given.select(F.col("k").alias("note_id"), "content")).select(F.col("note_id").alias("k"), "section", "text").where(F.col("text").rlike(r"\S"))
    parts = parts.join(limits, "k").select(F.struct("k", "section").alias("s"), "text", "size")
    if strategy == "markdown":
        done = parts.select("s.k", "s.section", F.lit(0).alias("part"), F.lit(0).alias("piece"), F.lit(0).alias("cut"), "text")
    else:
        if strategy == "obsidian_aware":
            cut = chunk(parts, "s", "text", "structure", F.col("size"), F.lit(0))
            parts = cut.join(parts.select("s", "size"), "s").select(F.struct("s.k", "s.section", F.col("chunk").alias("part")).alias("s"), "text", "size")
        else:
            parts = parts.select(F.struct("s.k", "s.section", F.lit(0).alias("part")).alias("s"), "text", "size")
        large = T.approx_tokens(F.col("text")) > F.col("size")
        small = parts.where(~large).select("s.*", F.lit(0).alias("piece"), F.lit(0).alias("cut"), "text")
        pieces = semantic(parts.where(large), "s", "text", embed).join(parts.select("s", "size"), "s")
        pieces = pieces.select(F.struct("s.*", F.col("chunk").alias("piece")).alias("s"), "text", "size")
        fine = chunk(pieces, "s", "text", "sentences", F.col("size"), F.lit(0)).select("s.*", F.col("chunk").alias("cut"), "text")
        done = small.unionByName(fine)
    return _numbered(done, key, "section", "part", "piece", "cut").withColumn("n_tokens", T.approx_tokens(F.col("text"))).select(key, "chunk", "text", "n_tokens")


def _numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("chunk", F.row_number().over(W.partitionBy("k").orderBy(*order)) - 1).withColumnRenamed("k", key)


def by_size(rows: DataFrame, text: str, size: Column) -> DataFrame:
    """rows with approx_tokens and is_large (above size)."""
    return rows.withColumn("approx_tokens", T.approx_tokens(F.col(text))).withColumn("is_large", F.col("approx_tokens") > size)


def blend(chunk_vector: Column, document_vector: Column, alpha: float = 0.7) -> Column:
    """alpha of the chunk's and the rest of the document's vector, of length one; null where the sum is all zeros."""
    mixed = F.zip_with(chunk_vector, document_vector, lambda c, d: c.cast("double") * alpha + d.cast("double") * (1 - alpha))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(mixed), lambda v: F.when(length(v) > 0, F.transform(v, lambda x: x / length(v))))[0]


def _distance(vector: str | Column, following: Column) -> Column:
    dot = F.aggregate(F.zip_with(vector, following, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.round(1 - dot, 6)


def semantic_breaks(steps: DataFrame, doc: str, order: str, vector: str, percentile: float = 0.95) -> DataFrame:
    """doc, order, distance, segment: a new segment begins after a step whose distance to the next is above the percentile of its document.

    A document is sorted in one task, as suits the sentences of a text; series_breaks takes any length.
    """
    w = W.partitionBy(doc).orderBy(order)
    far = steps.withColumn("distance", _distance(vector, F.lead(vector).over(w)))
    limits = far.groupBy(doc).agg(F.percentile("distance", F.lit(percentile)).alias("limit"))
    cut = far.join(limits, doc).withColumn("cut", (F.col("distance") > F.col("limit")).cast("int"))
    before = F.coalesce(F.sum(F.coalesce("cut", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.select(doc, order, "distance", before.cast("long").alias("segment"))


def series_breaks(steps: DataFrame, doc: str, order: str, vector: str, percentile: float = 0.95, block: int = 65_536) -> DataFrame:
    """The result of semantic_breaks for documents of any length, with whole numbers for order.

    Steps are sorted in blocks of that many consecutive values of order; one row a block carries over what
    crosses its end. The percentile is taken over distances with their counts. Rows with a null doc or order
    are left out; of rows that repeat an order, the one with the smallest vector counts. A null or missing
    vector gives a null distance, and no break.
    """
    given = steps.select(F.col(doc).alias("k"), F.col(order).alias("o"), F.col(vector).alias("v")).where("k is not null and o is not null")
    given = given.withColumn("block", F.floor(F.col("o") / block))
    inside, blocks = W.partitionBy("k", "block"), W.partitionBy("k").orderBy("block")
    once = given.withColumn("earlier", F.lag("o").over(inside.orderBy("o", "v"))).where("earlier is null or earlier != o").drop("earlier")
    w = inside.orderBy("o")

    heads = once.groupBy("k", "block").agg(F.min_by(F.struct("v"), "o").alias("head")).select("k", "block", F.lead("head").over(blocks).alias("after"))
    far = once.withColumn("next", F.lead(F.struct("v")).over(w)).join(heads, ["k", "block"])
    far = far.select("k", "block", "o", _distance("v", F.coalesce("next", "after")["v"]).alias("distance"))
    counts = far.where("distance is not null").groupBy("k", "distance").agg(F.count("*").alias("n"))
    limits = counts.groupBy("k").agg(F.percentile("distance", F.lit(percentile), F.col("n")).alias("limit"))
    cut = far.join(limits, "k", "left").withColumn("cut", F.coalesce((F.col("distance") > F.col("limit")).cast("long"), F.lit(0)))
    until = lambda w: F.coalesce(F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = cut.groupBy("k", "block").agg(F.sum("cut").alias("cut")).select("k", "block", until(blocks).alias("base"))
    out = cut.withColumn("inner", until(w)).join(base, ["k", "block"])
    return out.select(F.col("k").alias(doc), F.col("o").alias(order), "distance", (F.col("base") + F.col("inner")).alias("segment"))

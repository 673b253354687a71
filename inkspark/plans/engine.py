"""One object over a vault and its chats: index, search, federated search, research."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.config import Settings, check_question
from inkspark.functions import plugs
from inkspark.functions import text as T
from inkspark.operators import chunking, retrieval
from inkspark.operators import conversations as chats
from inkspark.plans import loops
from inkspark.session import materialize
from inkspark.sources import files


class Engine:
    """Chunks of notes and chats with vectors, and searches over them.

    Vectors come from the plugged embedder, replies from the plugged generator, and the order of hits from
    the plugged reranker; all have offline defaults. steps are applied to the hits after that, in order.
    """

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), embed=None, generate: plugs.Generator = plugs.echo, rerank=retrieval.rerank_by_overlap, steps=()) -> None:
        self.rerank, self.steps = rerank, steps
        self.spark, self.settings, self.generate = spark, settings, generate
        self.embed = embed or plugs.hashing_embedder()
        self.chunks: DataFrame | None = None
        self.usage: list[tuple[str, int, int]] = []

    def index(self, notes: DataFrame | None = None, conversations: DataFrame | None = None) -> DataFrame:
        """Chunk and embed notes (path, title, content) and chats (path, title, turns); each distinct text is embedded once.

        Give one row per path. late_chunking brings its own vectors.
        """
        s, parts = self.settings, []
        if notes is not None:
            cut = chunking.split(notes, "path", "content", s.strategy, F.lit(s.chunk_size), F.lit(s.chunk_overlap), self.embed, s.alpha)
            titles = notes.groupBy("path").agg(F.min("title").alias("title"))
            parts.append(cut.join(titles, "path").withColumn("source_type", F.lit("vault")))
        if conversations is not None:
            turns = conversations.select(F.xxhash64("path").alias("conv_id"), F.posexplode("turns").alias("turn_index", "t")).select("conv_id", "turn_index", F.col("turn_index").alias("turn_id"), "t.role", "t.content")
            cut = chats.chunks(turns, s.chunk_size, conversations.select(F.xxhash64("path").alias("conv_id"), "title"))
            paths = conversations.groupBy("path").agg(F.min("title").alias("title")).withColumn("conv_id", F.xxhash64("path"))
            parts.append(cut.select("conv_id", "chunk", "text", "n_tokens").join(paths, "conv_id").drop("conv_id").withColumn("source_type", F.lit("ai_conversation")))
        if not parts:
            raise ValueError("notes or conversations")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("id", F.xxhash64("source_type", "path", "chunk"))
        blended = "embedding" in rows.columns
        own = rows.withColumnRenamed("embedding", "blended") if blended else rows
        none = self.spark.createDataFrame([], "text_key string, embedding array<double>")
        embedded = plugs.embed_missing(own, none, "text", self.embed)
        embedded = embedded.withColumn("embedding", F.coalesce("blended", "embedding")).drop("blended") if blended else embedded
        # The terms of each chunk are stored beside it, so that searches don't cut texts again.
        self.chunks = materialize(embedded.withColumn("terms", T.terms(F.col("text"))).withColumn("dl", F.size("terms")), "index")
        self.record("embedding", embedded)
        return self.chunks

    def record(self, ledger: str, texts: DataFrame) -> None:
        """Add what texts (text) cost to the usage of this engine: one request and its tokens by characters."""
        row = texts.agg(T.batch_tokens(F.coalesce(F.sum(F.length("text")), F.lit(0))).alias("t")).first()
        self.usage.append((ledger, int(row.t), 1))

    def usage_totals(self) -> DataFrame:
        """ledger, tokens_used, requests of what this engine has recorded."""
        rows = self.spark.createDataFrame(self.usage, "ledger string, tokens long, requests long")
        return rows.groupBy("ledger").agg(F.sum("tokens").alias("tokens_used"), F.sum("requests").alias("requests"))

    def load(self, path: str, source_types: list[str] | None = None) -> None:
        self.chunks = files.read_index(self.spark, path, source_types)

    def _legs(self, question: str, chunks: DataFrame) -> DataFrame:
        """Fusion of vector and BM25 lists over the question's wordings."""
        s, lists = self.settings, []
        for text in plugs.transform(question, s.transform, self.generate, s.variations):
            asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
            lists.append(retrieval.vector_top_k(chunks.select("id", "embedding"), asked.select("query_id", self.embed(F.col("text")).alias("embedding")), s.top_k))
            indexed = chunks.select("id", "terms", "dl") if "terms" in chunks.columns else chunks.select("id", "text")
            lists.append(retrieval.bm25(indexed, asked, s.top_k))
        return retrieval.reciprocal_rank_fusion(lists, s.top_k)

    def search(self, question: str, source_type: str | None = None) -> DataFrame:
        """id, score, rank, text, title, path, source_type and excerpt of the best chunks, reranked.

        Beyond the reranking quota (rerank_limit tokens) the fused order is kept.
        """
        question, s = check_question(question), self.settings
        chunks = self.chunks.where(F.col("source_type") == source_type) if source_type else self.chunks
        asked = self.spark.createDataFrame([(0, question)], "query_id long, text string")
        fused = self._legs(question, chunks)
        if sum(t for ledger, t, _ in self.usage if ledger == "rerank") < s.rerank_limit:
            fused = materialize(fused, "fused")
            self.record("rerank", fused.join(chunks.select("id", "text"), "id"))
            best = retrieval.cutoff(self.rerank(fused, asked, chunks.select("id", "text"), s.rerank_n), s.cutoff)
        else:
            best = fused.where(F.col("rank") <= s.rerank_n)
        for step in self.steps:
            best = step(best)
        return best.drop("query_id").join(chunks.select("id", "text", "title", "path", "source_type", T.excerpt(F.col("text")).alias("excerpt")), "id")

    def federated(self, question: str, sources: tuple[str, ...] = ("vault", "conversations")) -> DataFrame:
        """The best chunks of both sources by weighted score."""
        question, s = check_question(question), self.settings
        every = {"vault": (s.vault_weight, "vault"), "conversations": (s.conversations_weight, "ai_conversation")}
        lists = {n: (self._legs(question, self.chunks.where(F.col("source_type") == every[n][1])), *every[n]) for n in sources}
        merged = retrieval.federated_merge(lists, s.rerank_n)
        return merged.drop("query_id").join(self.chunks.select("id", "text", "title", "path"), "id")

    def answer(self, question: str, most_chars: int = 8_000) -> dict:
        """answer, and sources (title, path, score, excerpt) in order of rank: the generator's reply over the packed texts of the best chunks."""
        hits = materialize(self.search(question).select(F.lit(0).alias("query_id"), "rank", "score", "text", "title", "path", "excerpt"), "hits")
        packed = contexts(hits, most_chars).first()
        if packed is None:
            return {"answer": None, "sources": []}
        sources = [r.asDict() for r in hits.orderBy("rank").select("title", "path", "score", "excerpt").collect()]
        return {"answer": self.generate(f"{packed.context}\n\nAnswer from these excerpts.\n{question}"), "sources": sources}

    def self_corrected(self, question: str) -> DataFrame:
        return loops.self_correct(question, self.search, self.generate, self.settings.max_retries)

    def research(self, question: str) -> loops.Research:
        return loops.research(question, self.search, self.generate, self.settings.research_rounds, self.settings.research_confidence, self.settings.rerank_n)


def contexts(hits: DataFrame, most_chars: int = 8_000) -> DataFrame:
    """query_id and context: the hits' texts in order of rank, each under its number, cut to most_chars."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.substring("text", 1, most_chars).alias("text")))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"]))
    return hits.where("text is not null").groupBy("query_id").agg(F.substring(F.array_join(parts, "\n\n"), 1, most_chars).alias("context"))


def contextualize(chunks: DataFrame, generate: plugs.Generator) -> DataFrame:
    """chunks (text, ...) with contextual_prefix from the generator, called in the tasks, and original_text; where it fails, the text stays as it is."""
    def ask(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return generate(f"Say in one sentence what this is about.\n{t}") if t else None
            except Exception:
                return None

        return text.map(one)

    asked = chunks.withColumn("contextual_prefix", F.pandas_udf(ask, "string")("text")).withColumn("original_text", F.col("text"))
    return asked.withColumn("text", F.coalesce(T.contextual(F.col("contextual_prefix"), F.col("original_text")), F.col("original_text")))

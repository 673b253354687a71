"""What users plug in, with offline defaults: an embedder, a text generator, and the query transforms built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as T

#: Takes a prompt, gives the reply. Runs on the driver for a handful of prompts.
Generator = Callable[[str], str]


def echo(prompt: str) -> str:
    """The offline generator: the prompt's last line."""
    return prompt.strip().rsplit("\n", 1)[-1]


def hashing_embedder(dimensions: int = 64) -> Callable[[Column], Column]:
    """Unit vectors of hashed terms with signs; the zero vector for null and empty texts."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            out = []
            for words in series:
                v = np.zeros(dimensions)
                if len(words):
                    h = pd.util.hash_array(np.array(words, object), categorize=False)
                    np.add.at(v, (h % dimensions).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
                out.append((v / (np.linalg.norm(v) or 1)).tolist())
            yield pd.Series(out)

    return lambda text: F.pandas_udf(run, "array<double>")(T.terms(text))


def embed_missing(rows: DataFrame, cache: DataFrame, text: str, embed: Callable[[Column], Column]) -> DataFrame:
    """rows with text_key and embedding; only texts that cache (text_key, embedding) lacks are embedded, each once."""
    keyed = rows.withColumn("text_key", F.sha2(text, 256))
    new = keyed.where("text_key is not null").groupBy("text_key").agg(F.first(text).alias("t")).join(cache.select("text_key"), "text_key", "left_anti")
    known = cache.select("text_key", "embedding").unionByName(new.select("text_key", embed(F.col("t")).alias("embedding")))
    return keyed.join(known, "text_key", "left")


def hypothetical(question: str, generate: Generator) -> str:
    """A made-up passage that answers the question; the question itself where the generator fails or says nothing."""
    try:
        return generate(f"Write a short passage that answers this question.\n{question}").strip() or question
    except Exception:
        return question


def expand(question: str, generate: Generator, n: int = 3) -> list[str]:
    """The question and up to n - 1 other wordings; only the question where the generator fails."""
    try:
        reply = generate(f"Give {n} other wordings, one a line.\n{question}")
    except Exception:
        return [question]
    return T.read(reply, wordings=lambda r: T.variations(F.lit(question), r, n)).wordings


def transform(question: str, mode: str, generate: Generator, n: int = 3) -> list[str]:
    """Search texts of a question by none, hyde, multi_query or both; an unknown mode is none."""
    if mode == "hyde":
        return [hypothetical(question, generate)]
    if mode == "multi_query":
        return expand(question, generate, n)
    if mode == "both":
        return [hypothetical(x, generate) for x in expand(question, generate, n)]
    return [question]

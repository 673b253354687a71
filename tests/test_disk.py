"""Searches with many queries write little to disk beside their input: shuffles, and tables in the shared folder."""

import random
from pathlib import Path

import pytest

from inkspark.plans.queries import QUERIES
from inkspark.session import shared_dir

SEARCHES = (
    "bm25_topk", "graph_expand", "answer_contexts", "federated_search", "rrf_hybrid", "rerank_overlap", "source_summary", "multi_query_merge",
)
N_DOCS, N_QUERIES, N_WORDS = 4_000, 3_000, 20


def written(spark) -> int:
    """Bytes shuffled so far, and those of the shared folder."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    folder = Path(shared_dir(spark).removeprefix("file://"))
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())) + sum(p.stat().st_size for p in folder.rglob("*.parquet"))


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Every query has three words of 20, and every word is in one document of twenty or so."""
    rnd, folder = random.Random(5), tmp_path_factory.mktemp("many")
    words = [f"w{i}" for i in range(N_WORDS)]
    filler = lambda: " ".join(rnd.choice("abcdefghij") * 3 for _ in range(rnd.randint(5, 30)))
    docs = [(i, f"{filler()} {rnd.choice(words)} {filler()}", rnd.choice(("vault", "ai_conversation"))) for i in range(N_DOCS)]
    notes = [(20 * i, f"n{i}.md", f"n{i}", " ".join(rnd.sample(words, 3)), f"{filler()} {rnd.choice(words)} [[n{i + 1}]]", [rnd.choice(words)]) for i in range(N_QUERIES)]
    spark.createDataFrame(docs, "doc_id long, text string, source_type string").write.parquet(f"{folder}/documents.parquet")
    rows = spark.createDataFrame(notes, "note_id long, path string, stem string, title string, content string, tags array<string>")
    rows.selectExpr("*", "timestamp '2025-01-01 00:00:00' as ingested_at").write.parquet(f"{folder}/notes.parquet")
    rnd_vectors = [(i, [rnd.gauss(0, 1) for _ in range(4)], "x") for i in range(200)]
    spark.createDataFrame(rnd_vectors, "vec_id long, embedding array<float>, label string").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_write_little(spark, many, name):
    before = written(spark)
    QUERIES[name](spark, many).write.format("noop").mode("overwrite").save()
    assert written(spark) - before < 9e6


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """30 documents of 100,000 characters (3 MB), each with every word that one of 100 queries has."""
    rnd, folder = random.Random(6), tmp_path_factory.mktemp("long")
    words = [f"w{i}" for i in range(N_WORDS)]
    filler = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=100_000))
    docs = [(i, " ".join([*words, filler()]), "vault") for i in range(30)]
    notes = [(20 * i, f"n{i}.md", f"n{i}", " ".join(rnd.sample(words, 3)), "", []) for i in range(100)]
    spark.createDataFrame(docs, "doc_id long, text string, source_type string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    rows = spark.createDataFrame(notes, "note_id long, path string, stem string, title string, content string, tags array<string>")
    rows.selectExpr("*", "timestamp '2025-01-01 00:00:00' as ingested_at").write.parquet(f"{folder}/notes.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["rerank_overlap", "answer_contexts"])
def test_long_texts_are_not_written_with_each_hit(spark, long_texts, name):
    before, sent = written(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables above it
    try:
        QUERIES[name](spark, long_texts).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    assert written(spark) - before < 12e6

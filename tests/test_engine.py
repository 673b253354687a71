import pytest

from inkspark.config import Settings, check_question, route
from inkspark.plans.engine import Engine, contexts, contextualize
from inkspark.session import ship


def test_settings(tmp_path):
    assert Settings.from_env({"INKSPARK_CHUNK_SIZE": "100", "INKSPARK_ALPHA": "0.5", "INKSPARK_CHUNK_OVERLAP": "10"}).chunk_size == 100
    assert Settings(vault=str(tmp_path)).vault
    for bad in ({"chunk_overlap": 512}, {"alpha": 1.5}, {"temperature": 3.0}, {"strategy": "x"}, {"transform": "x"}, {"vault_weight": 2.5}, {"vault": "/no/such"}, {"top_k": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    for bad in (None, "  ", "x" * 10_001):
        with pytest.raises(ValueError):
            check_question(bad)
    assert route("@conv hi there") == ("conversations", "hi there") and route("hi", ("a", "b")) == ("all", "hi") and route("hi") == ("vault", "hi")


def test_engine(spark):
    ship(spark)
    notes = spark.createDataFrame([("n1", "Foxes", "The red fox runs far."), ("n2", "Bread", "Bake the bread slowly."), ("n3", "None", None)], "path string, title string, content string")
    chats = spark.createDataFrame([("c1", "Chat", [("user", "How do foxes run?"), ("assistant", "Quickly, like a red fox.")])], "path string, title string, turns array<struct<role:string,content:string>>")
    engine = Engine(spark, Settings(rerank_n=2))
    assert engine.index(notes, chats).count() == 3
    hits = engine.search("red fox").orderBy("rank").collect()
    assert len(hits) == 2 and {r.path for r in hits} == {"n1", "c1"} and hits[0].score == 1.0
    assert [r.path for r in engine.search("red fox", "vault").where("rank = 1").collect()] == ["n1"]
    fed = engine.federated("red fox").collect()
    assert {r.source for r in fed} <= {"vault", "conversations"} and len(fed) == 2
    assert engine.research("red fox").hits.count() >= 2 and engine.self_corrected("red fox").count() == 2


def test_contexts(spark):
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "query_id long, rank int, text string")
    assert [tuple(r) for r in contexts(hits).collect()] == [(1, "[1] a\n\n[2] b")]
    rows = contextualize(hits, lambda p: "about " + p[-1]).orderBy("query_id", "rank").collect()
    assert [r.text for r in rows] == ["about a\n\na", "about b\n\nb", None]


def test_answer_usage_and_quota(spark):
    ship(spark)
    notes = spark.createDataFrame([("n1", "Foxes", "The red fox runs far."), ("n2", "Bread", "Bake the bread slowly.")], "path string, title string, content string")
    engine = Engine(spark, Settings(rerank_n=1, strategy="late_chunking"), generate=lambda p: "reply to " + p.rsplit("\n", 1)[-1])
    engine.index(notes)
    got = engine.answer("red fox")
    assert got["answer"] == "reply to red fox" and [s["path"] for s in got["sources"]] == ["n1"]
    used = {r.ledger: (r.tokens_used, r.requests) for r in engine.usage_totals().collect()}
    assert used["embedding"][0] == (21 + 22) * 2 // 7 and used["rerank"][1] == 1
    engine.settings = Settings(rerank_n=1, rerank_limit=used["rerank"][0])
    assert engine.search("red fox").count() == 1 and len(engine.usage) == 2  # the quota is used up: fused order, nothing recorded
    engine.steps = (lambda hits: hits.where("rank > 5"),)
    assert engine.search("red fox").count() == 0 and engine.answer("red fox")["answer"] is None

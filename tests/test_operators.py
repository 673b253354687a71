import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.functions import plugs
from inkspark.functions import text as T
from inkspark.operators import chunking, conversations, ledger, retrieval, vault
from inkspark.plans import loops


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


def test_text_functions(spark):
    assert one(spark, "a b c d e", T.approx_tokens) == 6 and one(spark, " \n", T.approx_tokens) == 0 and one(spark, None, T.approx_tokens) == 0
    assert one(spark, "[[A b|x]] [[ C/d#h ]] [[A b]]", T.wikilinks) == ["A b", "C/d#h", "A b"] and one(spark, None, T.wikilinks) == []
    tags = spark.createDataFrame([("#café/x ## H #z", ["b", None])], "t string, g array<string>")
    assert tags.select(T.tags(F.col("t"), F.col("g")).alias("o")).first().o == ["b", "café/x", "z"]
    assert one(spark, "x" * 300, T.short_excerpt) == "x" * 200 + "..." and one(spark, "x", T.short_excerpt) == "x" and one(spark, "x", T.excerpt) == "x..."
    assert [one(spark, r, T.grade) for r in ("It is INCORRECT", "correct", "ambiguous or correct", "?")] == ["incorrect", "correct", "ambiguous", "ambiguous"]
    assert one(spark, "CONFIDENCE: 0.2\nconfidence: 1.7", T.confidence) == 1.0 and one(spark, "none", T.confidence) == 0.5
    assert one(spark, "GAPS: x\nGAPS: more on y", T.gaps) == "more on y" and one(spark, "GAPS: None", T.gaps) is None
    assert one(spark, "1. a\n\n2) b\nc", lambda c: T.numbered_lines(c, 2)) == ["a", "b"]
    assert one(spark, "# h\n- b\n1. v\nq", lambda c: T.variations(F.lit("q"), c, 3)) == ["q", "v"]
    assert one(spark, "INVALID\nVALID", T.verdict) is False and one(spark, "fine", T.verdict) is True


def notes(spark):
    rows = [(1, "a.md", "A", "A", "[[B]] [[B]] [[A]] [[gone]]"), (2, "b.md", "B", "b", "[[A]]"), (3, "c.md", "B", "c", None), (4, None, None, None, "")]
    return spark.createDataFrame(rows, "note_id long, path string, title string, stem string, content string")


def test_links_and_expansion(spark):
    graph = vault.link_graph(notes(spark))
    assert sorted(map(tuple, graph.collect())) == [(1, 0, 3), (1, 1, 3), (1, 2, 1), (2, 0, 1)]
    hits = spark.createDataFrame([(9, 1, 0.5), (9, 2, 0.05)], "query_id long, note_id long, score double")
    out = {(r.note_id, r.hop): r.score for r in vault.expand(hits, graph).collect()}
    assert out == {(1, 0): 0.5, (2, 0): 0.05, (3, 1): 0.0}


def test_sections_skip_code(spark):
    rows = spark.createDataFrame([(1, "intro\n# A\n```\n# no\n```\n## B\nx"), (2, None), (3, "")], "note_id long, content string")
    got = sorted((r.note_id, r.section, r.text) for r in vault.sections(rows).collect())
    assert got == [(1, 0, "intro"), (1, 1, "# A\n```\n# no\n```"), (1, 2, "## B\nx")]
    parents = vault.parent_context(vault.sections(rows), "note_id", "section", "text").collect()
    assert {r.total_chunks for r in parents} == {3} and parents[0].parent_summary.startswith("intro # A")


def test_vector_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 11)
    v = np.random.default_rng(1).standard_normal((60, 8)).round(3)
    v[7] = v[9]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = corpus.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.vector_top_k(corpus, asked, 4).collect()}
    for q in range(0, 60, 7):
        score = np.round(v @ v[q], 6)
        want = sorted(range(60), key=lambda i: (-score[i], i))[:4]
        assert [got[q, r + 1][0] for r in range(4)] == want
    assert retrieval.vector_top_k(corpus, asked.limit(0), 4).count() == 0


def test_bm25_by_hand(spark):
    docs = {1: "red fox red", 2: "blue fox", 3: "", 4: None, 5: "green"}
    corpus = spark.createDataFrame(list(docs.items()), "id long, text string")
    asked = spark.createDataFrame([(1, "Red fox fox"), (2, "nothing"), (3, None)], "query_id long, text string")
    got = [(r.query_id, r.id, r.score) for r in retrieval.bm25(corpus, asked, 5).orderBy("query_id", "rank").collect()]
    mean = 6 / 5

    def w(tf, dl, df):
        return math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))

    assert got == [(1, 1, pytest.approx(w(2, 3, 1) + w(1, 3, 2), abs=1e-6)), (1, 2, pytest.approx(w(1, 2, 2), abs=1e-6))]


def ranked(spark, *rows):
    return spark.createDataFrame([(1, i, s, r) for i, s, r in rows], "query_id long, id long, score double, rank int")


def test_merging(spark):
    a, b = ranked(spark, (1, 0.9, 1), (2, None, 2)), ranked(spark, (2, 0.95, 1), (3, 0.9, 2))
    fused = {r.id: r.score for r in retrieval.reciprocal_rank_fusion([a, b], 5).collect()}
    assert fused == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62}, abs=1e-9)
    assert [r.id for r in retrieval.max_merge([a, b], 5).orderBy("rank").collect()] == [2, 1, 3]
    fed = retrieval.federated_merge({"x": (a, 1.0, "vault"), "y": (b, 0.5, "ai_conversation")}, 5).orderBy("rank").collect()
    assert [(r.id, r.score, r.source) for r in fed] == [(1, 0.9, "x"), (3, 0.45, "y"), (2, 0.0, "x")]
    assert retrieval.source_summary(retrieval.federated_merge({"x": (a, 1.0, "vault")}, 5)).first().n_vault == 2
    assert retrieval.cutoff(a, 0.1).count() == 1
    m = retrieval.ranking_metrics(a, spark.createDataFrame([(1, 2), (1, 7)], "query_id long, id long"), 2).first()
    assert (m.precision, m.recall, m.mrr) == (0.5, 0.5, 0.5)


def turns(spark):
    rows = [(1, 7, 0, "Human", "hi there", None), (2, 7, 1, "ASSISTANT", "x " * 300, "10:00"), (3, 7, 2, "user", " ", None), (4, 7, 3, "user", "bye", ""), (5, 8, 0, None, None, None)]
    return spark.createDataFrame(rows, "turn_id long, conv_id long, turn_index int, role string, content string, timestamp string")


def test_turns(spark):
    got = {r.turn_id: r for r in conversations.turn_context(turns(spark)).collect()}
    assert set(got) == {1, 2, 4} and got[1].previous is None and got[4].previous.endswith("...") and got[1].role == "user"
    t = conversations.totals(turns(spark)).first()
    assert (t.n_turns, t.n_user) == (3, 2)
    assert conversations.render(turns(spark)).first().text.startswith("### USER\n\nhi there\n\n### ASSISTANT (10:00)\n\nx")
    c = conversations.chunks(turns(spark), 100).orderBy("chunk").collect()
    # The turn above the size is cut, into chunks of its own.
    assert [r.chunk for r in c] == list(range(len(c))) and [(r.first_turn, r.last_turn) for r in c] == [(0, 0), *[(1, 1)] * (len(c) - 2), (3, 3)] and max(r.n_tokens for r in c) <= 100


def test_chunkers():
    text = "\n\n".join(f"Sentence {i} has five words. And another one is here!" for i in range(40))
    for size in (20, 50, 1000):
        parts = chunking.sentences(text, size, size // 4)
        assert all(f"Sentence {i} has" in " ".join(parts) for i in range(40)) and (len(parts) > 1) == (size < 1000)
        assert "".join(chunking.paragraphs(text, size)).count("five") == 40
    fenced = "# A\n```\n" + "code line here\n\n" * 40 + "```\n\n# B\ntext"
    assert chunking.structure(fenced, 10)[0].count("code line") == 40 and len(chunking.structure(fenced, 10)) == 2
    assert chunking.sentences("", 10, 2) == [] and chunking.structure("", 10) == [] and chunking.paragraphs(" \n\n ", 5) == []


def test_chunk_and_blend(spark):
    rows = spark.createDataFrame([(1, "One two. Three four."), (2, None), (3, "")], "k long, t string")
    assert [(r.k, r.chunk) for r in chunking.chunk(rows, "k", "t", "sentences", F.lit(2), F.lit(0)).orderBy("chunk").collect()] == [(1, 0), (1, 1)]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>").select(chunking.blend(F.col("a"), F.col("b")).alias("o")).collect()
    assert v[0].o == pytest.approx([0.7 / math.hypot(0.7, 0.3), 0.3 / math.hypot(0.7, 0.3)]) and v[1].o is None


def test_ledger(spark):
    rows = spark.createDataFrame([("e", "m", 80, 100, 1), ("e", "m", None, 100, 1), ("r", "z", 5, 0, None)], "ledger string, model string, tokens_used long, token_limit long, requests_count long")
    u = {r.ledger: r for r in ledger.quota(ledger.usage_totals(rows, F.col("model")), F.lit(15)).collect()}
    assert (u["e"].remaining, u["e"].percent_used, u["e"].exhausted, u["e"].decision) == (20, 80.0, False, "warn")
    assert (u["r"].percent_used, u["r"].exhausted, u["r"].decision) == (100.0, True, "refuse")
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, None)], "seq int, k string")
    assert [r.k for r in ledger.lru_contents(log, "k", "seq", 2).orderBy("position").collect()] == ["c", "a"]
    old, new = (spark.createDataFrame(r, "k long, c string") for r in ([(1, "x"), (2, "y"), (3, None)], [(1, "x"), (2, "z"), (4, "n")]))
    assert {(r.k, r.change) for r in ledger.changes(old, new, "k", "c").collect()} == {(2, "changed"), (3, "deleted"), (4, "new")}
    s = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (0.0, float("nan"), None, 1.0)], ", ".join(f"{m} double" for m in ledger.METRICS))
    r = ledger.report(s).first()
    assert (r.faithfulness, r.answer_relevancy, r.overall) == (0.5, 1.0, 0.85) and ledger.failed(s, 0.5).count() == 1


def test_embedding_cache(spark):
    embed = plugs.hashing_embedder(16)
    rows = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, None), (4, "")], "id long, t string")
    cache = spark.createDataFrame([], "text_key string, embedding array<double>")
    got = {r.id: r.embedding for r in plugs.embed_missing(rows, cache, "t", embed).collect()}
    assert got[1] == got[2] and np.linalg.norm(got[1]) == pytest.approx(1) and got[3] is None and not any(got[4])


def test_query_transforms():
    fail = lambda p: 1 / 0
    assert plugs.transform("q", "hyde", lambda p: " passage ") == ["passage"] and plugs.transform("q", "hyde", fail) == ["q"]
    assert plugs.transform("q", "multi_query", lambda p: "1. a\n- no\n\nq\nb\nc") == ["q", "a", "b"] and plugs.transform("q", "other", fail) == ["q"]


def replies(*said):
    left, calls = list(said), []

    def generate(prompt):
        calls.append(prompt)
        return left.pop(0)

    generate.calls = calls
    return generate


def search_in(spark, calls):
    def search(question):
        calls.append(question)
        return spark.createDataFrame([(1, 0.5 + 0.1 * len(calls), 1, question), (len(calls) + 1, 0.3, 2, "more")], "id long, score double, rank int, text string")

    return search


def test_self_correction(spark):
    calls, g = [], replies("AMBIGUOUS", "better", "CORRECT")
    out = loops.self_correct("q", search_in(spark, calls), g)
    assert calls == ["q", "better"] and len(g.calls) == 3 and out.where("rank = 1").first().text == "better"
    calls, g = [], replies()
    loops.self_correct("q", search_in(spark, calls), g, enabled=False)
    assert calls == ["q"] and g.calls == []
    calls, g = [], replies("INCORRECT", "r1", "INCORRECT", "r2", "INCORRECT")
    assert loops.self_correct("q", search_in(spark, calls), g).where("rank = 1").first().text == "q" and len(calls) == 3


def test_research(spark):
    calls, g = [], replies("CONFIDENCE: 0.3\nGAPS: dates", "1. when?\n2. where?", "CONFIDENCE: 0.9\nGAPS: more")
    out = loops.research("q", search_in(spark, calls), g)
    assert calls == ["q", "when?"] and [r["confidence"] for r in out.log] == [0.3, 0.9]
    assert {r.id: r.score for r in out.hits.collect()} == pytest.approx({1: 0.7, 2: 0.3, 3: 0.3})


def test_no_chunk_above_its_size():
    """Short parts lose no fractions, and parts that are too large alone are cut."""
    text = "\n\n".join(" ".join(f"One{i}{j} two three." for j in range(9)) for i in range(12)) + "\n\n" + "word " * 300
    for size in (8, 21, 50):
        for parts in (chunking.sentences(text, size, size // 3), chunking.paragraphs(text, size)):
            assert all(len(p.split()) * 13 // 10 <= size for p in parts) and sum(p.count("word") for p in parts) >= 300
    lines = chunking.structure("\n".join(["a b"] * 20 + [""] + ["c d"] * 20), 20)
    assert len(lines) == 2 and all(len(x.split()) == 40 for x in lines)


def test_strategies(spark):
    body = "# A\n\n" + "Cats purr softly. " * 30 + "Stars burn hydrogen. " * 30 + "\n## B\n\nshort one.\n"
    rows = spark.createDataFrame([(1, body, "x"), (2, None, "x"), (3, "  \n", "x"), (4, "one. two.", "x")], "id long, t string, chunk string")
    got = {}
    for name in chunking.STRATEGIES:
        out = chunking.split(rows, "id", "t", name, F.lit(60), F.lit(10), plugs.hashing_embedder()).collect()
        by = got[name] = [r for r in sorted(out, key=lambda r: r.chunk) if r.id == 1]
        assert {r.id for r in out} == {1, 4} and [r.chunk for r in by] == list(range(len(by))), name
        assert name == "markdown" or max(r.n_tokens for r in by) <= 60, name
    assert len(got["markdown"]) == 2 and len(got["obsidian_aware"]) > 4
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in got["late_chunking"])


def test_semantic_cuts_where_meaning_turns(spark):
    text = " ".join(["The cat sat on the mat."] * 12 + ["Stars burn hydrogen quickly."] * 12)
    out = chunking.semantic(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", plugs.hashing_embedder()).orderBy("chunk").collect()
    assert len(out) >= 2 and "Stars" not in out[0].text and "cat" not in out[-1].text and sum(r.text.count(".") for r in out) == 24


def test_series_breaks_in_blocks(spark):
    rng = random.Random(5)
    rows = [(d, o, [rng.random() for _ in range(4)]) for d in ("a", "b") for o in rng.sample(range(-500, 500), 120)] + [("c", 3, [1.0, 0.0, 0.0, 0.0])]
    schema = "doc string, pos long, vec array<double>"
    plain = {(r.doc, r.pos): r[2:] for r in chunking.semantic_breaks(spark.createDataFrame(rows, schema), "doc", "pos", "vec").collect()}
    dirty = spark.createDataFrame([*rows, *rows[:9], (None, 1, [0.0]), ("a", None, [0.0])], schema).selectExpr("*", "1 as block", "2 as k", "3 as cut")
    for block in (1, 7, 65_536):
        got = chunking.series_breaks(dirty, "doc", "pos", "vec", block=block).collect()
        assert len(got) == len(rows) and {(r.doc, r.pos): r[2:] for r in got} == plain
    assert max(v[1] for v in plain.values()) > 3 and chunking.series_breaks(dirty.where("false"), "doc", "pos", "vec").count() == 0
    gap = spark.createDataFrame([("a", 1, None), ("a", 2, [1.0]), ("a", 3, [0.5])], schema)
    assert [(r.distance, r.segment) for r in chunking.series_breaks(gap, "doc", "pos", "vec").orderBy("pos").collect()] == [(None, 0), (0.5, 0), (None, 0)]


def test_conversation_chunks_have_text(spark):
    rows = [(1, 7, 0, "user", "hi there"), (2, 7, 1, "Assistant", "Long answer one. " * 60), (3, 7, 2, "user", "ok"), (4, 8, 0, None, "alone"), (5, 8, 1, "user", None)]
    turns = spark.createDataFrame(rows, "turn_id long, conv_id long, turn_index int, role string, content string")
    titles = spark.createDataFrame([(7, "My title"), (7, "My title"), (8, None)], "conv_id long, title string")
    out = conversations.chunks(turns, 50, titles).orderBy("conv_id", "chunk").collect()
    seven = [r for r in out if r.conv_id == 7]
    assert seven[0].text == "# My title\n\n### USER\n\nhi there" and max(r.n_tokens for r in seven) <= 50 and len(seven) > 4
    assert sum(r.text.count("Long") for r in seven) == 60 and seven[-1].text.endswith("### USER\n\nok") and [r.text for r in out if r.conv_id == 8] == ["### UNKNOWN\n\nalone"]


def test_vector_search_in_blocks_and_sent(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(3)
    vectors = np.round(rnd.normal(size=(300, 8)), 1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None)], "id long, embedding array<double>").repartition(3)
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    score = np.round(vectors[::20] @ vectors.T, 6)
    want = {(int(q) * 20, int(i), r + 1) for q in range(len(score)) for r, i in enumerate(sorted(range(300), key=lambda i: (-score[q, i], i))[:7])}
    for sent in (4_000_000, 16):
        monkeypatch.setattr(retrieval, "SENT", sent)
        assert {(r.query_id, r.id, r["rank"]) for r in retrieval.vector_top_k(rows, asked, 7).collect()} == want


def test_bm25_against_brute_force(spark, monkeypatch):
    import math
    import random

    rnd = random.Random(2)
    words = [f"t{i}" for i in range(40)]
    docs = {i: [rnd.choice(words[: rnd.choice((3, 10, 40))]) for _ in range(rnd.randint(0, 30))] for i in range(200)}
    asks = {i: rnd.sample(words, 4) + words[:2] for i in range(12)}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in d for d in docs.values()) for w in words}
    weigh = lambda w, d: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean))
    want = set()
    for q, terms in asks.items():
        scored = [(-round(sum(weigh(w, d) for w in set(terms) if w in d), 6), i) for i, d in docs.items() if set(terms) & set(d)]
        want |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:5])}
    corpus = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()] + [(900, None)], "id long, text string").where("id < 900")
    queries = spark.createDataFrame([(q, " ".join(t)) for q, t in asks.items()], "query_id long, text string")
    for few in (100_000, 0):
        monkeypatch.setattr(retrieval, "TERMS_SENT", few)
        got = {(r.query_id, r.id, r["rank"]) for r in retrieval.bm25(corpus, queries, 5).collect()}
        assert len(got ^ want) <= 2  # sums in another order may round to another sixth place


def test_bm25_in_blocks(spark, monkeypatch):
    """Many sets, few at once, small blocks of postings: the same lists as in one go; queries with the same terms have the same list."""
    import random

    rnd = random.Random(4)
    words = [f"t{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choice(words[: rnd.choice((3, 10, 30))]) for _ in range(rnd.randint(0, 25)))) for i in range(300)]
    corpus = spark.createDataFrame(docs + [(500 + i, d) for i, d in docs[:50]], "id long, text string").repartition(3)
    asks = [(i, " ".join(rnd.sample(words, rnd.randint(1, 5)) + ["absent"])) for i in range(40)] + [(90, "t1 t0 T1 gone"), (91, "t0 t1"), (92, "absent"), (93, None), (None, "t1")]
    queries = spark.createDataFrame(asks, "query_id long, text string")
    lists = lambda: sorted((r.query_id, r["rank"], r.id, r.score) for r in retrieval.bm25(corpus, queries, 4).collect())
    whole = lists()
    same = [[x[1:] for x in whole if x[0] == q] for q in (90, 91)]
    assert same[0] == same[1] and len(same[0]) == 4 and {x[0] for x in whole} == {*range(40), 90, 91}
    for most, value in (("POSTINGS", 50), ("HITS_HELD", 60), ("PAIRS_SENT", 70), ("TERMS_SENT", 0)):
        monkeypatch.setattr(retrieval, most, value)
    blocked = lists()
    assert [x[:3] for x in blocked] == [x[:3] for x in whole]
    assert [x[3] for x in blocked] == pytest.approx([x[3] for x in whole], abs=2e-6)

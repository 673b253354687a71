import random
import re

import pytest
from pyspark.sql import functions as F

from inkspark.llm import neardup

WORDS = [f"w{i}" for i in range(300)]


def shingles(text, chars=False):
    w = re.findall(r"[^\W_]+", text.lower())
    s = " ".join(w)
    return {s[i : i + 3] for i in range(len(s) - 2)} if chars else set(zip(w, w[1:], w[2:]))


def brute(rows, least, chars):
    sets = {i: shingles(t, chars) for i, t in rows.items() if t is not None and (len(" ".join(re.findall(r"[^\W_]+", t))) >= least if chars else len(re.findall(r"[^\W_]+", t)) >= least)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) * 10 >= 6 * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(3)
    folder = tmp_path_factory.mktemp("near")
    texts: dict = {}
    for i in range(60):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(25, 120))]
        for j in range(5):
            edited = base[:]
            for _ in range(j * 2):
                edited[rnd.randrange(len(edited))] = rnd.choice(WORDS)
            texts[i * 10 + j] = " ".join(edited) if j != 4 else "  ".join(base).upper() + "!"
    texts |= {9001: None, 9002: "", 9003: "short text", 9004: "x" * 90000}
    titles = {i: f"{rnd.choice(['weekly', 'daily'])} report number {rnd.randint(1, 9)} about {rnd.choice(['gardens', 'kitchens'])} and more" for i in range(80)} | {900: None, 901: "tiny"}
    spark.createDataFrame([(k, t, "clash") for k, t in texts.items()] + [(0, texts[0], "again")], "note_id long, content string, cls string").write.parquet(f"{folder}/notes.parquet")
    spark.createDataFrame([], "turn_id long, content string").write.parquet(f"{folder}/turns.parquet")
    spark.createDataFrame(list(titles.items()), "conv_id long, title string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder), texts, titles


def test_all_pairs_against_brute_force(spark, tables):
    folder, texts, titles = tables
    got = [(r.rec_type, r.id_a, r.id_b) for r in neardup.found(spark, folder).collect()]
    want = {("note", *p) for p in brute(texts, 30, False)} | {("title", *p) for p in brute(titles, 20, True)}
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)


def test_large_classes_are_stars(spark, tables, monkeypatch):
    folder, texts, titles = tables
    want = brute(titles, 20, True)
    monkeypatch.setattr(neardup, "SMALL_CLASS", 1)
    got = {(r.id_a, r.id_b) for r in neardup.found(spark, folder).where("rec_type = 'title'").collect()}
    link = {i: i for i in titles}

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for a, b in got:
        link[root(a)] = root(b)
    assert got < want and all(root(a) == root(b) for a, b in want)


def test_classes(spark, tables):
    folder, texts, _ = tables
    rows = {r.rec_id: r for r in neardup.classes(spark, folder).where("rec_type = 'note'").collect()}
    assert rows[4].class_id == 0 and 9001 not in rows and 9003 not in rows and any(r.n_links for r in rows.values())


def test_prefix_depth():
    assert neardup.prefix_depth(20, 0.6) == 3 and neardup.prefix_depth(57, 0.6) == 5 and neardup.prefix_depth(1, 0.1) == 1


def test_dense_nodes_get_longer_prefixes(spark, tmp_path, monkeypatch):
    """One hot group of half-alike texts: nodes hold many times NODE classes, and no link is lost beyond the recall."""
    rnd = random.Random(11)
    base = [rnd.choice(WORDS) for _ in range(100)]
    texts = {}
    for i in range(240):
        cut = rnd.randint(0, 45)
        own = [rnd.choice(WORDS) for _ in range(cut)]
        texts[i] = " ".join(base[: 100 - cut] + own)
    spark.createDataFrame(list(texts.items()), "note_id long, content string").write.parquet(f"{tmp_path}/notes.parquet")
    spark.createDataFrame([], "turn_id long, content string").write.parquet(f"{tmp_path}/turns.parquet")
    spark.createDataFrame([], "conv_id long, title string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(neardup, "NODE", 16)
    labels = []
    real = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, label: labels.append(label) or real(df, label))
    got, want = {(r.id_a, r.id_b) for r in neardup.found(spark, str(tmp_path)).collect()}, brute(texts, 30, False)
    assert {"met", "met-1", "met-2", "blocks"} <= set(labels)
    assert got <= want and len(got) >= 0.985 * len(want) and len(want) > 5000


def test_runs_across_batches():
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    node = np.sort(rnd.integers(0, 400, 3000))
    node[1000:1500] = node[1000]
    node.sort()
    cls = rnd.permutation(3000)
    rows = pa.RecordBatch.from_arrays([pa.array(node), pa.array(cls), *[pa.array(np.zeros(3000, np.int64))] * 2], ["node", "cls", "sketch", "side"])
    for size in (7, 64, 3000):
        out = [b.to_pylist() for b in neardup.meet(0, 40)(iter(rows.slice(i, size) for i in range(0, 3000, size)))]
        flat = [(r["node"], r["a"], r["b"]) for part in out for r in part]
        groups = {int(n): cls[node == n].tolist() for n in np.unique(node)}
        want = {(n, min(a, b), max(a, b)) for n, c in groups.items() if len(c) <= 40 for i, a in enumerate(c) for b in c[i + 1 :]}
        assert {x for x in flat if x[2] is not None} == want
        assert sorted(x[:2] for x in flat if x[2] is None) == sorted((n, x) for n, c in groups.items() if len(c) > 40 for x in c)


def test_a_key_with_several_texts_loses_no_link(spark, tmp_path):
    rnd = random.Random(4)
    one, two = ([rnd.choice(WORDS) for _ in range(n)] for n in (40, 90))
    near = lambda words: " ".join([*words[:-2], "x", "y"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two))]
    spark.createDataFrame(rows, "note_id long, content string").write.parquet(f"{tmp_path}/notes.parquet")
    spark.createDataFrame([], "turn_id long, content string").write.parquet(f"{tmp_path}/turns.parquet")
    spark.createDataFrame([], "conv_id long, title string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {(r.id_a, r.id_b) for r in neardup.found(spark, str(tmp_path)).collect()} == {(1, 2), (1, 3)}


def test_bitmap_keeps_all_marked_rows(spark):
    rows = spark.range(50_000).select(F.xxhash64("id").alias("h"), "id", F.lit(1).alias("clash"))
    marks = neardup.marked(rows.where("id % 7 = 0"), "h")
    kept = neardup.maybe_marked(rows, "h", marks)
    assert kept.columns == ["h", "id", "clash"] and kept.where("id % 7 = 0").count() == 7143 and 7143 <= kept.count() < 7200
    assert neardup.maybe_marked(rows, "h", neardup.marked(rows.where("false"), "h")).count() == 0

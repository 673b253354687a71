import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspark.llm import packing, splitting


def tokens(text):
    return len(text.split()) * 13 // 10


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["word", "end.", "#", "# Head", "```", "- item", "---", "comma,"]), st.sampled_from([" ", "\n", "\n\n", "\r\n"])), min_size=1, max_size=150),
    st.integers(2, 60),
    st.integers(0, 30),
)
def test_pieces(parts, size, overlap):
    text = "".join(a + b for a, b in parts)
    if tokens(text) <= size:
        return
    spans = splitting.spans(text, size, overlap)
    assert "".join(text[c:e] for _, c, e, _ in spans) == text and len(spans) > 1
    limit = max(1, splitting.most_words(size))
    shared = min(-(-overlap * 10 // 13), limit - 1) if overlap else 0
    for i, (s, c, e, n) in enumerate(spans):
        assert n == len(text[s:e].split()) and tokens(text[s:e]) <= max(size, 1)
        if i:
            assert len(text[s:c].split()) == shared and s >= spans[i - 1][0]


def test_cuts_at_the_strongest_boundaries():
    text = "# One\n\n" + "a b c. " * 8 + "\n\n# Two\n\n" + "d e f. " * 8
    assert [text[c:][:5] for _, c, _, _ in splitting.spans(text, 40, 0)] == ["# One", "# Two"]


def test_split_oversized_handles_nulls(spark):
    rows = [(1, "w " * 100, 50, 10, "x"), (2, None, 50, 10, "x"), (3, "", 50, 10, "x"), (4, "few", 50, None, "x"), (5, "w " * 100, None, 0, "x"), (None, "w " * 100, 50, 0, "x"), (6, "w " * 100, 50, None, "x"), (7, "é" * 90000, 50, 1, "x")]
    out = splitting.split_oversized(spark.createDataFrame(rows, "k long, t string, s int, o int, piece string"), "k", "t", "s", "o")
    assert {r.k for r in out.collect()} == {1, 6} and all(r.n_tokens <= 50 for r in out.collect())
    assert out.where("k = 6").agg(F.sum(F.size(F.split(F.trim("piece"), " ")))).first()[0] == 100


def test_hilbert_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = packing.hilbert(grid, 3)
    path = grid[np.argsort(place)]
    assert sorted(place) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 250), max_size=200), st.integers(1, 100))
def test_packer(sizes, capacity):
    packer = packing.Packer(capacity)
    out = packer.pack(list(enumerate(sizes[:100]))) + packer.pack(list(enumerate(sizes[100:], 100)))
    used, by_item = {}, {}
    for item, part, container, size in out:
        used[container] = used.get(container, 0) + size
        by_item.setdefault(item, []).append((part, size))
    assert set(by_item) == set(range(len(sizes))) and all(u <= capacity for u in used.values())
    for item, parts in by_item.items():
        assert sum(s for _, s in parts) == sizes[item] and sorted(p for p, _ in parts) == list(range(len(parts)))
        assert len(parts) == 1 or sizes[item] > capacity


def test_pack(spark):
    rows = spark.createDataFrame([(i, i % 7, i * 37 % 100) for i in range(2000)] + [(5000, 0, None)], "doc_id long, place long, n_tokens long")
    by = packing.pack(rows, 100).groupBy("container_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert max(r.n for r in by) <= 100 and sum(r.n for r in by) / len(by) > 95
    assert packing.pack(rows.limit(0), 100).count() == 0


def test_whole_queries(spark, data):
    large = {r.note_id for r in splitting.found(spark, data).collect()}
    assert large and {r.note_id for r in splitting.note_pieces(spark, data).collect()} == large
    docs = spark.read.parquet(f"{data}/documents.parquet")
    packed = packing.packed(spark, data)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.where("part > 0").count() == 0 or packed.agg(F.max("n_tokens")).first()[0] <= 8192


def test_windows_do_not_hang_on_batches():
    import pyarrow as pa

    rows = [(i, i % 7) for i in range(1000)]
    cut = lambda n: [pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[i : i + n]]), pa.array([y for _, y in rows[i : i + n]])], ["key", "n"]) for i in range(0, 1000, n)]
    a, b = list(packing.windows(iter(cut(10)))), list(packing.windows(iter(cut(777))))
    assert a == b and [len(w) for w in a] == [packing.WINDOW] * (1000 // packing.WINDOW) + [1000 % packing.WINDOW] and sum(a, []) == rows


def test_containers_hold_neighbours(spark):
    """Documents of a container lie near on the curve, and containers are full."""
    rnd = random.Random(8)
    rows = spark.createDataFrame([(i, i * 10, rnd.randint(1, 900)) for i in range(6000)], "doc_id long, place long, n_tokens long")
    by: dict = {}
    for r in packing.pack(rows, 8192).collect():
        by.setdefault(r.container_id, []).append((r.doc_id, r.n_tokens))
    apart = [abs(a - b) for c in by.values() for (a, _), (b, _) in zip(c, c[1:])]
    assert sum(apart) / len(apart) < 400  # 2,000 were they spread at random
    assert sum(n for c in by.values() for _, n in c) / len(by) > 0.97 * 8192

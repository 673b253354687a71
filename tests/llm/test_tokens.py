import os

import numpy as np
import pytest

from inkspark.llm import bpe, tokens

if not os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.json"):
    pytest.skip("vocabulary files aren't here", allow_module_level=True)

TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello world, it's 2024!", "don't DON'T we'll", "aaaa aaaaa banana", "naïve café — ☕ 日本語テキスト", "á b c\x00\x07d", "<|endoftext|> stays text",
    "🙂🙂 🙃", "x" * 5000, "ab" * 3000, "१२३ ४५६ ⅷ ²", "tab\tand\r\nlines\r\n", "words " * 2000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def want(tokenizer):
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, piece string").repartition(3)


def test_merging_pieces_against_the_library(tokenizer):
    merges = bpe.load_merges()
    pieces = [b" the", b"aaaa", b"xyzzyx", "日本語".encode(), b"", b" internationalisation", b"abababab"]
    at = np.append(0, np.cumsum([len(p) for p in pieces]))
    ids, off = bpe.encode(np.frombuffer(b"".join(pieces), np.uint8), at, merges)
    for i, p in enumerate(pieces):
        assert ids[off[i] : off[i + 1]].tolist() == tokenizer.encode(p.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize("share", [65_536, 2])
def test_encoding_counts_and_round_trip(spark, docs, tokenizer, monkeypatch, share):
    """With a share of 2 nearly every piece is rare, so that both ways are taken."""
    monkeypatch.setattr(tokens, "HEAD_SHARE", share)
    encoded = tokens.encode_corpus(docs)
    expected = want(tokenizer)
    assert {r.doc_id: r.ids for r in encoded.collect()} == expected
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()} == {i: len(x) for i, x in expected.items()}
    assert {r.doc_id: r.text for r in tokens.decode_corpus(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_corpus(none).count() == 0 and tokens.count_tokens(none).count() == 0


def test_slices_add_up(spark, data):
    each, by = tokens.document_tokens(spark, data), tokens.slices(spark, data)
    assert each.selectExpr("sum(n_tokens)").first()[0] == by.selectExpr("sum(n_tokens)").first()[0]
    assert {r.source for r in by.select("source").distinct().collect()} <= {"vault", "chatgpt", "claude", "gemini", "unknown"}

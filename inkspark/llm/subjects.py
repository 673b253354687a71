"""Subject areas of documents (problem 8).

Documents are embedded by weighted terms and a truncated singular value decomposition over the whole
corpus. Hand-labelled documents seed one centroid for each subject and language, beside one of plain
words for each language; the centroids are refined over the terms nearest to them. Every sentence goes
to the subject of the nearest centroid, and a document has the subjects that enough of its sentences
are on. What reaches the driver is as large as the vocabulary (at most VOCABULARY_SHARE times the
terms of an average document) times the rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.tokens import clean_label, clean_language, documents
from inkspark.session import materialize

RANK, PASSES, ROUNDS = 80, 3, 5
#: A term is in the vocabulary if at least one in so many documents has it, and LEAST_DOCUMENTS at that.
VOCABULARY_SHARE, LEAST_DOCUMENTS = 2_000, 5
#: Least cosine of a term to its centroid while refining, and when sentences are assigned.
NEAR, ON = 0.4, 0.6
#: A subject counts from this share of the sentences, and from two of them in a text of more than SHORT.
SHARE, SHORT = 0.15, 4
#: Cells of a dense block of documents times terms.
BLOCK = 3_000_000

HAN, LETTER = r"\p{IsHan}", r"[\p{L}&&[^\p{IsHan}]]"
FENCE = r"(?ms)^(```|~~~).*?^\1[^\n]*$"
NO_SENTENCE = r"(?m)^(#{1,6} .*|\|.*|\*\*\w+:\*\*.*|---.*|(?:- )?(?:up: |→ |See )?\[\[[^\n]*)$"
SENTENCE_END = r"(?<=[.!?])[ \t]+|(?<=[。！？])"
#: Words without case, overlapping pairs of Han characters, and line ends, which stand for sentence ends.
TERM = rf"(?=({HAN}{{2}}|{LETTER}+|\n))(?:{HAN}|{LETTER}+|\n)"


def terms_of(text: str):
    """The terms of a text's sentences in order, each sentence followed by a line end; headings, tables and code left out."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), FENCE, "")
    body = F.regexp_replace(F.regexp_replace(body, NO_SENTENCE, ""), SENTENCE_END, "\n")
    return F.regexp_extract_all(F.lower(F.concat(body, F.lit("\n"))), F.lit(TERM), F.lit(1))


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    off = column.offsets.to_numpy().astype(np.int64)
    return column.flatten(), off - off[0]


def _values(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The flat four-byte values packed in binary rows, and where each row begins (with the end)."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    return np.frombuffer(column.buffers()[2] or b"", dtype)[off[0] : off[-1]], off - off[0]


def _rows(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def hashed_terms(docs: DataFrame) -> DataFrame:
    """doc_id, lang and terms of docs (doc_id, lang, text): a 32-bit hash per term, 0 after every sentence that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = _flat(b.column(2))
            codes = flat.dictionary_encode()
            words = codes.dictionary.to_numpy(zero_copy_only=False)
            h = np.maximum(pd.util.hash_array(words, categorize=False) >> np.uint64(32), 1).astype(np.uint32) if len(words) else np.zeros(0, np.uint32)
            h[words == "\n"] = 0
            values = h[codes.indices.to_numpy()]
            end, starts = values == 0, np.zeros(len(values) + 1, bool)
            starts[off] = True
            # A line end counts where a term stands right before it in the same document.
            keep = ~end | (~np.append(True, end[:-1])[: len(end)] & ~starts[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _rows(values[keep], np.append(0, np.cumsum(keep))[off])], ["doc_id", "lang", "terms"])

    return docs.select("doc_id", "lang", terms_of("text").alias("w")).mapInArrow(run, "doc_id long, lang string, terms binary")


def document_frequencies(hashed: DataFrame) -> DataFrame:
    """term (hash) and n_docs, counted within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, off = _values(b.column(0), np.uint32)
            seen = pd.unique(np.repeat(np.arange(len(b), dtype=np.uint64), np.diff(off)) << np.uint64(32) | values)
            codes, term = pd.factorize(seen & np.uint64(0xFFFFFFFF))
            n = np.bincount(codes, minlength=len(term))
            yield pa.RecordBatch.from_arrays([pa.array(term[term > 0].astype(np.int64)), pa.array(n[term > 0].astype(np.int64))], ["term", "n"])

    return hashed.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))


def _add_up(rows: DataFrame) -> DataFrame:
    """Sum the packed vectors (vec: float32 bytes) of equal keys; one row per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for key, vec in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(vec.as_buffer(), np.float32)
                total[key] = total[key] + v if key in total else v.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.astype(np.float32).tobytes() for v in total.values()])], ["key", "vec"])

    return rows.repartition("key").mapInArrow(run, "key string, vec binary")


@dataclass(frozen=True)
class Blocks:
    """Reads batches of packed terms as dense blocks of weighted, normalised documents."""

    idf: np.ndarray

    def __call__(self, terms: pa.Array, weights: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        step = max(1, BLOCK // len(self.idf))
        for lo in range(0, len(terms), step):
            part = [np.frombuffer(t.as_buffer(), np.int32) for t in terms[lo : lo + step]]
            flat = np.concatenate(part)
            row = np.repeat(np.arange(len(part)), [len(p) for p in part])
            known = flat >= 0
            counts = np.bincount(row[known] * len(self.idf) + flat[known], minlength=len(part) * len(self.idf))
            cells = np.flatnonzero(counts)
            doc, term = np.divmod(cells, len(self.idf))
            value = np.log1p(counts[cells]) * self.idf[term]
            norm = np.sqrt(np.bincount(doc, value**2, len(part)))
            x = np.zeros(len(counts), np.float32)
            x[cells] = value * (weights[lo : lo + step] / np.where(norm > 0, norm, 1))[doc]
            yield slice(lo, lo + len(part)), x.reshape(len(part), -1)


@dataclass(frozen=True)
class Model:
    """Score of each vocabulary term for each subject; 0 for terms on none."""

    subjects: list[str]
    scores: np.ndarray


def _packed_corpus(hashed: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, lang and terms: places in the sorted vocabulary as int32 bytes, -1 after every sentence."""
    words = hashed.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, off = _values(b.column(2), np.uint32)
            place = np.minimum(np.searchsorted(words.value, values), len(words.value) - 1)
            keep = (words.value[place] == values) | (values == 0)
            out = np.where(values == 0, -1, place)[keep].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _rows(out, np.append(0, np.cumsum(keep))[off])], ["doc_id", "lang", "terms"])

    return hashed.mapInArrow(run, "doc_id long, lang string, terms binary")


def _times(corpus: DataFrame, blocks: Blocks, weights: dict[str, float], q: np.ndarray) -> np.ndarray:
    """X'XQ over the whole corpus: every task adds up its own part, Spark the parts."""
    shared = corpus.sparkSession.sparkContext.broadcast((blocks, weights, q.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, weights, q = shared.value
        total = np.zeros(q.shape, np.float32)
        for b in batches:
            for _, x in blocks(b.column(2), np.array([weights[x] for x in b.column(1).to_pylist()])):
                total += x.T @ (x @ q)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(str), pa.string()), pa.array([total[i].tobytes() for i in used], pa.binary())], ["key", "vec"])

    out = np.zeros(q.shape)
    for r in _add_up(corpus.mapInArrow(run, "key string, vec binary")).collect():
        out[int(r.key)] = np.frombuffer(r.vec, np.float32)
    return out


def _label_sums(corpus: DataFrame, labels: DataFrame, blocks: Blocks, weights: dict[str, float], q: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of document vectors, with the summed weight last, by what and language.

    all: every document; any: labelled ones; with|s: those labelled s; part|s: those, less the more subjects they have.
    """
    shared = corpus.sparkSession.sparkContext.broadcast((blocks, weights, q.astype(np.float32)))
    given = labels.where("subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, weights, q = shared.value
        total: dict[str, np.ndarray] = {}

        def add(key: str, v: np.ndarray, w: float) -> None:
            total[key] = total.get(key, 0) + np.append(v * w, w)

        for b in batches:
            langs, given = b.column(1).to_pylist(), b.column(3).to_pylist()
            for at, x in blocks(b.column(2), np.array([weights[x] for x in langs])):
                vectors = x @ q
                for lang in set(langs[at]):
                    mine = np.array([x == lang for x in langs[at]])
                    total[f"all|{lang}"] = total.get(f"all|{lang}", 0) + np.append(vectors[mine].sum(0), mine.sum())
                for v, lang, names in zip(vectors, langs[at], given[at]):
                    if names:
                        add(f"any|{lang}", v, 1)
                        for s in names:
                            add(f"with|{s}|{lang}", v, 1)
                            add(f"part|{s}|{lang}", v, 1 / len(names))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.astype(np.float32).tobytes() for v in total.values()])], ["key", "vec"])

    summed = _add_up(corpus.join(given, "doc_id", "left").select("doc_id", "lang", "terms", "given").mapInArrow(run, "key string, vec binary"))
    return {r.key: np.frombuffer(r.vec, np.float32).astype(np.float64) for r in summed.collect()}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def refine(terms: np.ndarray, sums: dict[str, np.ndarray], subjects: list[str]) -> np.ndarray:
    """Scores of terms (unit vectors) for subjects, from seed centroids moved ROUNDS times to the mean of their terms."""
    centroids, owner = [], []
    mean = lambda v: v[:-1] / v[-1] if v[-1] else v[:-1]
    for lang in sorted({k.rpartition("|")[2] for k in sums} - {"unknown"}):
        centroids.append(mean(sums[f"all|{lang}"]))
        owner.append(len(subjects))
        for i, s in enumerate(subjects):
            if (part := sums.get(f"part|{s}|{lang}")) is not None:
                centroids.append(mean(part) - mean(sums[f"any|{lang}"] - sums[f"with|{s}|{lang}"]))
                owner.append(i)
    scores = np.zeros((len(terms), len(subjects)), np.float32)
    if not centroids:
        return scores
    c, owner = _unit(np.array(centroids)), np.array(owner)
    for _ in range(ROUNDS):
        cosine = terms @ c.T
        best, near = cosine.argmax(1), cosine.max(1) > NEAR
        for j in range(len(c)):
            if (mine := (best == j) & near).sum() >= 2:
                c[j] = _unit(terms[mine].sum(0))
    cosine = terms @ c.T
    topical = (owner[cosine.argmax(1)] < len(subjects)) & (cosine.max(1) > ON)
    for i in range(len(subjects)):
        if (owner == i).any():
            scores[:, i] = np.where(topical, np.maximum(cosine[:, owner == i].max(1), 0), 0)
    return scores


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[DataFrame, Model]:
    """The packed corpus of docs (doc_id, lang, text) and the model fitted over all of it."""
    hashed = materialize(hashed_terms(docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())), "hashed")
    n = hashed.count()
    frequent = document_frequencies(hashed).where((F.col("n_docs") >= LEAST_DOCUMENTS) & (F.col("n_docs") * VOCABULARY_SHARE >= n))
    rows = frequent.orderBy("term").collect()
    if not rows:
        return hashed.where("false"), Model(subjects, np.zeros((0, len(subjects)), np.float32))
    corpus = materialize(_packed_corpus(hashed, np.array([r.term for r in rows], np.uint32)), "terms")
    by_lang = {r.lang: r["count"] for r in corpus.groupBy("lang").count().collect()}
    blocks = Blocks(np.log(n / np.array([r.n_docs for r in rows])).astype(np.float32) + 1e-3)
    known = [x for x in by_lang if x != "unknown"]
    # Small languages weigh as much as large ones, else the leading directions are those of the largest.
    weights = {x: (n / len(known) / by_lang[x]) ** 0.5 if x in known else 1.0 for x in by_lang}
    rank = min(RANK, len(rows))
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(rows), rank)))[0]
    for i in range(PASSES):
        product = _times(corpus, blocks, weights, q)
        if i < PASSES - 1:
            q = np.linalg.qr(product)[0]
    values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
    q, values = q @ turn, np.sqrt(np.maximum(values, 0))
    sums = _label_sums(corpus, labels, blocks, weights, q)
    return corpus, Model(subjects, refine(_unit(q * values), sums, subjects))


def subject_counts(corpus: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject, n_on, n_sentences: every subject that some sentence of a document is on."""
    shared = corpus.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names, k = pa.array(model.subjects, pa.string()), len(model.subjects)
        for b in batches:
            flat, off = _values(b.column(1), np.int32)
            end = flat < 0
            doc = np.repeat(np.arange(len(b)), np.diff(off))
            sentence = np.cumsum(end) - end
            last = np.flatnonzero(end)
            known = np.flatnonzero(~end & (model.scores[np.maximum(flat, 0)].max(1, initial=0) > 0)) if len(model.scores) else np.zeros(0, np.int64)
            score, whole = np.zeros((len(last), k)), np.zeros((len(b), k))
            np.add.at(score, sentence[known], model.scores[flat[known]]) if len(known) else None
            np.add.at(whole, doc[last], score)
            # Between subjects that share a sentence's only terms, the rest of the document decides.
            rest = whole / np.maximum(whole.sum(1, keepdims=True), 1e-9)
            best = (score * (1 + 0.5 * rest[doc[last]])).argmax(1)
            on = score.max(1, initial=0) > 0
            counts = np.zeros((len(b), k), np.int64)
            np.add.at(counts, (doc[last][on], best[on]), 1)
            d, s = np.nonzero(counts)
            total = np.bincount(doc[last], minlength=len(b))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), names.take(pa.array(s)), pa.array(counts[d, s]), pa.array(total[d].astype(np.int64))], ["doc_id", "subject", "n_on", "n_sentences"])

    return corpus.select("doc_id", "terms").mapInArrow(run, "doc_id long, subject string, n_on long, n_sentences long")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    subjects = [r.subject for r in read("subjects").where("subject is not null").select("subject").distinct().orderBy("subject").collect()]
    docs = read("documents").select("doc_id", "text", clean_language("lang").alias("lang"))
    corpus, model = fit(docs, read("subject_labels"), subjects)
    return subject_counts(corpus, model)


def counts_enough():
    return (F.col("n_on") >= SHARE * F.col("n_sentences")) & ((F.col("n_on") >= 2) | (F.col("n_sentences") <= SHORT))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_found: the subjects of each document; none for null, empty and blank texts."""
    return _counts(spark, sf_dir).where(counts_enough()).select("doc_id", "subject").distinct()


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_composition: documents with a subject, and sentences on it, by subject and domain."""
    by = _counts(spark, sf_dir).where(counts_enough()).join(documents(spark, sf_dir).select("doc_id", clean_label("domain").alias("domain")), "doc_id")
    return by.groupBy("subject", "domain").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n_on").alias("n_sentences"))

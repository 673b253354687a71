"""Token counts and token ids of a corpus through a table of its distinct pieces (problems 4 and 6).

Spark splits every text into pre-split pieces and counts them; each distinct piece is encoded once.
Pieces that hold at least one in HEAD_SHARE of all occurrences (so at most HEAD_SHARE pieces, whatever
the corpus) are broadcast and looked up where the text is; all others, each too rare to be a hot key,
meet by piece, are encoded there, and return to their document by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.bpe import TOKENIZERS, Merges, encode, load_merges
from inkspark.session import materialize

HEAD_SHARE = 65_536
#: Ids travel as 16-bit values; GAP stands where a rare piece belongs.
GAP = 65_535

# Fixed value: the pre-split pattern of the byte-level vocabularies, in Java's notation.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces_of(text: str):
    """The pieces of a text, which put together give the text again; no pieces for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(SPLIT), F.lit(0)), F.array().cast("array<string>"))


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """piece and n of every distinct piece."""
    return docs.select(F.explode(pieces_of(text)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def _encode(pieces: pa.Array, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of pieces and their offsets."""
    raw = pieces.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    return encode(np.frombuffer(raw.buffers()[2] or b"", np.uint8), offsets, merges)


def _packed(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lists of ids, given flat with offsets, as binary values of two bytes an id."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 2).astype(np.int32)), pa.py_buffer(ids.astype(np.uint16))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat ids of packed values, and their offsets."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2 if len(column) else np.zeros(1, np.int64)
    ids = np.frombuffer(column.buffers()[2] or b"", np.uint16)[off[0] : off[-1]]
    return ids.astype(np.int32), off - off[0]


def piece_table(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """piece, n (occurrences in docs) and ids of every distinct piece, each encoded once, as a written table."""
    merges = docs.sparkSession.sparkContext.broadcast(load_merges(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = _encode(b.column(0), merges.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["piece", "n", "ids"])

    return materialize(_counts(docs, text).mapInArrow(run, "piece string, n long, ids array<int>"), "pieces")


def _head(table: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, flat ids and offsets of the pieces with at least one in HEAD_SHARE of all occurrences."""
    total = table.agg(F.sum("n")).first()[0] or 0
    rows = table.where(F.col("n") * HEAD_SHARE >= total).select("piece", "ids").collect()
    ids = np.array([i for r in rows for i in r.ids], np.int32)
    return [r.piece for r in rows], ids, np.append(0, np.cumsum([len(r.ids) for r in rows])).astype(np.int64)


def _lookup(w: pa.ListArray, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The flat pieces of a batch, their document offsets from 0, and the place of each in words, or -1."""
    flat, offsets = w.flatten(), w.offsets.to_numpy().astype(np.int64)
    place = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, offsets - offsets[0], place


def _filler(keys: pa.Array) -> pa.Array:
    """Join keys that no piece equals (a piece never mixes a control character with digits), spread evenly."""
    return pc.binary_join_element_wise(pa.array(["\x00"] * len(keys), pa.string()), keys.cast(pa.string()), "")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, table: DataFrame | None = None) -> DataFrame:
    """key and n_tokens (long) of each row of docs; 0 for null and empty texts.

    Rows with a null key are left out, rows that repeat a key are added up: give one row per key. Other
    columns of docs are not read.
    """
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    table = piece_table(docs, "text", vocabulary, folder) if table is None else table
    words, _, at = _head(table)
    head = docs.sparkSession.sparkContext.broadcast((words, np.diff(at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes = pa.array(head.value[0], pa.string()), np.append(head.value[1], 0)
        for b in batches:
            flat, off, place = _lookup(b.column(1), words)
            total = np.append(0, np.cumsum(sizes[place]))
            rare = np.flatnonzero(place < 0)
            owner = np.searchsorted(off, rare, "right") - 1
            n = pa.concat_arrays([pa.array(total[off[1:]] - total[off[:-1]], pa.int64()), pa.nulls(len(rare), pa.int64())])
            piece = pa.concat_arrays([_filler(b.column(0)), flat.take(pa.array(rare))])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0), b.column(0).take(pa.array(owner))]), piece, n], ["key", "piece", "n"])

    parts = docs.select("key", pieces_of("text").alias("w")).mapInArrow(run, "key long, piece string, n long")
    sizes = table.select("piece", F.size("ids").cast("long").alias("size"))
    sized = parts.join(sizes, "piece", "left")
    return sized.groupBy(F.col("key").alias(key)).agg(F.sum(F.coalesce("n", "size")).alias("n_tokens"))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key and ids (array<int>) of each row of docs, without special tokens; an empty list for null and empty texts.

    Rows with a null key are left out; give one row per key. Other columns of docs are not read.
    Rare pieces join the table of distinct pieces, and their ids join their document by position. Ids
    travel packed, two bytes each.
    """
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if len(load_merges(vocabulary, folder).pieces) > GAP:
        raise ValueError(f"{vocabulary} has more than {GAP} ids")
    table = piece_table(docs, "text", vocabulary, folder)
    head = docs.sparkSession.sparkContext.broadcast(_head(table))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, head_ids, head_at = head.value
        words, sizes = pa.array(words, pa.string()), np.append(np.diff(head_at), 1)
        # A rare piece leaves one GAP in its document's row.
        head_ids, first = np.append(head_ids, GAP), np.append(head_at[:-1], len(head_ids))
        for b in batches:
            flat, off, place = _lookup(b.column(1), words)
            size = sizes[place]
            at = np.append(0, np.cumsum(size))
            ids = head_ids[np.repeat(first[place] - at[:-1], size) + np.arange(at[-1])]
            rare = np.flatnonzero(place < 0)
            owner = np.searchsorted(off, rare, "right") - 1
            runs = _packed(ids, at[off])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0), b.column(0).take(pa.array(owner))]),
                    pa.array(np.concatenate([np.full(len(b), -1), rare - off[owner]]), pa.int32()),
                    pa.concat_arrays([_filler(b.column(0)), flat.take(pa.array(rare))]),
                    pa.concat_arrays([runs, pa.nulls(len(rare), runs.type)]),
                ],
                ["key", "pos", "piece", "run"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            packed = _packed(ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py())
            yield pa.RecordBatch.from_arrays([b.column(0), packed], ["piece", "packed"])

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (ids, off), pieces = _unpacked(b.column(1)), b.column(2).flatten()
            rare, rare_at = _unpacked(pieces)
            gap, size = ids == GAP, np.ones(len(ids), np.int64)
            size[gap] = np.diff(rare_at)
            at = np.append(0, np.cumsum(size))
            out, free = np.empty(at[-1], np.int32), np.ones(at[-1], bool)
            out[at[:-1][~gap]], free[at[:-1][~gap]] = ids[~gap], False
            out[free] = rare
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at[off], pa.int32()), pa.array(out))], ["key", "ids"])

    parts = docs.select("key", pieces_of("text").alias("w")).mapInArrow(split, "key long, pos int, piece string, run binary")
    filled = parts.join(table.select("piece", "ids").mapInArrow(pack, "piece string, packed binary"), "piece", "left")
    filled = filled.select("key", "pos", F.coalesce("run", "packed").alias("ids"))
    whole = filled.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    whole = whole.select("key", F.col("p")[0]["ids"].alias("run"), F.transform(F.slice("p", 2, F.size("p")), lambda x: x["ids"]).alias("rare"))
    return whole.mapInArrow(splice, "key long, ids array<int>").withColumnRenamed("key", key)


def decode_corpus(encoded: DataFrame, key: str = "doc_id", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key and text of encoded (key, ids): ids join the pieces of the vocabulary, whose bytes are put together by position.

    An empty list gives an empty text. The vocabulary's size bounds the joined side.
    """
    spark = encoded.sparkSession
    pieces = load_merges(vocabulary, folder).pieces
    vocab = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(pieces)], "id int, bytes binary")
    each = encoded.select(key, F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(vocab), "id", "left")
    hexed = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    return hexed.select(key, F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.coalesce(x["h"], F.lit(""))), "")), "UTF-8").alias("text"))


# Names of the languages in use, by the spelling in the tables.
LANGUAGES = {
    "en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de", "ger": "de", "deutsch": "de", "german": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "es": "es", "spa": "es", "spanish": "es", "español": "es",
    "zh": "zh", "zho": "zh", "chi": "zh", "chinese": "zh", "中文": "zh",
}


def clean_label(column: str):
    """A label without case, outer blanks, an export prefix or suffix; null and blank become unknown."""
    s = F.trim(F.regexp_replace(F.lower(F.trim(F.col(column))), r"^export:| export$", ""))
    return F.when(s.isNull() | (s == ""), "unknown").otherwise(s)


def clean_language(column: str):
    """The two-letter code of a language tag or name; und, null and unknown names become unknown."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(names[F.regexp_extract(F.lower(F.trim(F.col(column))), r"^([^-_]*)", 1)], F.lit("unknown"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_doc_tokens: n_tokens of each document, with its cleaned source, lang and domain."""
    docs = documents(spark, sf_dir)
    labels = docs.select("doc_id", clean_label("source").alias("source"), clean_language("lang").alias("lang"), clean_label("domain").alias("domain"))
    return labels.join(count_tokens(docs), "doc_id").select("doc_id", "source", "lang", "domain", "n_tokens")


def ledger_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, ledger_tokens, ledger_requests: the usage ledger by source of its conversation.

    Repeated ledger rows count once (by usage_id), null tokens as 0; a missing conversation or source
    goes to unknown. Where a conversation has no source, its path may name one.
    """
    ledger = spark.read.parquet(f"{sf_dir}/usage_ledger.parquet")
    once = ledger.groupBy("usage_id").agg(*[F.max(c).alias(c) for c in ("conv_id", "tokens_used", "requests_count")])
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    named = F.regexp_extract(F.lower("path"), "(chatgpt|claude|gemini)", 1)
    source = F.when(F.col("clean") != "unknown", F.col("clean")).when(named != "", named).otherwise("unknown")
    sources = conversations.withColumn("clean", clean_label("source")).groupBy("conv_id").agg(F.min(source).alias("source"))
    joined = once.join(sources, "conv_id", "left").groupBy(F.coalesce("source", F.lit("unknown")).alias("source"))
    return joined.agg(F.sum(F.coalesce("tokens_used", F.lit(0))).alias("ledger_tokens"), F.sum(F.coalesce("requests_count", F.lit(0))).alias("ledger_requests"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_slices: documents and tokens by source, lang and domain, beside the ledger's tokens of that source."""
    by = document_tokens(spark, sf_dir).groupBy("source", "lang", "domain").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return by.join(ledger_by_source(spark, sf_dir), "source", "left")


def corpus_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_ids: doc_id and token ids of every document."""
    return encode_corpus(documents(spark, sf_dir))


def decoded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_decoded: doc_id, length and SHA-256 of the text that decoding the ids gives."""
    return decode_corpus(corpus_ids(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))

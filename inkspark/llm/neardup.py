"""Near-duplicate records by a MinHash LSH forest with exact verification (problem 3).

Texts with the same sequence of units (words, or characters of a title) form a class and are searched
once. In each tree, a class has a label of min-hashes; classes that share a prefix of it meet in a node.
Labels are sorted by node, and runs of one node give the candidates. The prefix is as short as the target
recall demands at the threshold (a longer one would lose pairs), and is made longer only where a node
holds more than NODE classes: its members get a forest of their own inside the node, with further
min-hashes and more trees, which keeps the recall. What is still dense after LEVELS such forests is alike
in truth, and is compared in blocks. A sketch of 32 two-bit values beside the label drops chance meetings; exact
Jaccard similarity over shingle sets decides the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.session import materialize

WORD = r"[\p{L}\p{N}]+"
SKETCH = 32
#: Classes of a node that are compared directly; more get longer prefixes, up to LEVELS forests in all.
NODE, LEVELS = 256, 3
#: Classes of up to this many copies are written out as all pairs, larger ones as pairs with their first record.
SMALL_CLASS = 64
#: Bits of the bitmap that keeps texts nobody wants out of a shuffle: 2,048 rows of 4 kB, 8 MB, at most.
BITS = 2**26


@dataclass(frozen=True)
class Kind:
    """One kind of records: where they are, what their units are, and which count."""

    name: str
    table: str
    key: str
    text: str
    units: str  # words or characters
    least: int  # fewest words, or characters, that count
    trees: int
    shingle: int = 3


KINDS = (
    Kind("note", "notes", "note_id", "content", "words", 30, 20),
    Kind("turn", "turns", "turn_id", "content", "words", 30, 20),
    Kind("title", "conversations", "conv_id", "title", "characters", 20, 57),
)


def prefix_depth(trees: int, threshold: float, recall: float = 0.99, longest: int = 10) -> int:
    """The longest prefix at which records of that similarity meet in some tree with that chance."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def units_of(text: str, kind: Kind) -> Column:
    """Lower-cased words, or for characters the words joined by single blanks."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    return words if kind.units == "words" else F.array_join(words, " ")


def records(spark: SparkSession, sf_dir: str, kind: Kind) -> DataFrame:
    """id, units and text_hash of the records that count; nulls and short texts don't."""
    rows = spark.read.parquet(f"{sf_dir}/{kind.table}.parquet").select(F.col(kind.key).alias("id"), units_of(kind.text, kind).alias("units"), F.xxhash64(kind.text).alias("text_hash"))
    return rows.where(F.col("id").isNotNull() & ((F.size if kind.units == "words" else F.length)("units") >= max(kind.least, kind.shingle)))


def shingle_set(units: str, kind: Kind) -> Column:
    """The distinct hashes of all runs of kind.shingle units."""
    k, words = kind.shingle, kind.units == "words"
    size = F.size(units) if words else F.length(units)
    cut = (lambda i: F.xxhash64(F.slice(units, i, k))) if words else (lambda i: F.xxhash64(F.substring(F.col(units), i, F.lit(k))))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), size - (k - 1)), cut))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_hashes(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all units of a batch, and where each record's begin (with the end)."""
    if words:
        codes = column.flatten().dictionary_encode()
        hashed = pd.util.hash_array(codes.dictionary.to_numpy(zero_copy_only=False), categorize=False)
        offsets = column.offsets.to_numpy().astype(np.int64)
        return hashed[codes.indices.to_numpy()], offsets - offsets[0]
    texts = column.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return mix(points.astype(np.uint64)), np.append(0, np.cumsum([len(t) for t in texts]))


def shingle_hashes(units: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k units within records, and where each record's begin (without the end)."""
    h = np.zeros(max(len(units) - k + 1, 0), np.uint64)
    for i in range(k):
        h = mix(h + units[i : len(units) - k + 1 + i] + np.uint64(i + 1))
    inside = np.ones(len(h), bool)
    for i in range(1, k):
        last = at[1:] - i
        inside[last[(last >= 0) & (last < len(h))]] = False
    return h[inside], np.append(0, np.cumsum(np.diff(at) - k + 1))[:-1]


def signer(words: bool, k: int, trees: int, depth: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of id, units, text_hash: id, text_hash, class key, sketch, and the label prefix of each tree as one key."""
    rng = np.random.default_rng(seed)
    xor = rng.integers(0, 2**63, trees * depth + SKETCH, np.uint64)
    odd = rng.integers(0, 2**63, trees * depth + SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
    salt = np.uint64(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            units, at = unit_hashes(b.column(1), words)
            place = np.arange(len(units), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
            cls = mix(np.add.reduceat(mix(units + place * np.uint64(0x9E3779B97F4A7C15)), at[:-1]) + salt)
            shingles, first = shingle_hashes(units, at, k)
            low = lambda i: np.minimum.reduceat((shingles ^ xor[i]) * odd[i], first)
            keys = np.empty((len(b), trees), np.uint64)
            for t in range(trees):
                label = np.full(len(b), t, np.uint64) + salt
                for j in range(depth):
                    label = mix(label ^ low(t * depth + j))
                keys[:, t] = label
            sketch = np.zeros(len(b), np.uint64)
            for i in range(SKETCH):
                sketch |= (mix(low(trees * depth + i)) & np.uint64(3)) << np.uint64(2 * i)
            at_keys = pa.array(np.arange(len(b) + 1, dtype=np.int32) * trees)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *(pa.array(x.view(np.int64)) for x in (cls, sketch)), pa.ListArray.from_arrays(at_keys, pa.array(keys.ravel().view(np.int64)))],
                ["id", "text_hash", "cls", "sketch", "keys"],
            )

    return run


SIGNED = "id long, text_hash long, cls long, sketch long, keys array<long>"


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the 32 two-bit values of two sketches are equal."""
    x = (a ^ b).view(np.uint64)
    x = x | (x >> np.uint64(1))
    return SKETCH - np.bitwise_count(x & np.uint64(0x5555555555555555)).astype(int)


def least_agreeing(threshold: float) -> int:
    """Sketch values that records at the threshold share, less three standard deviations."""
    p = threshold + (1 - threshold) / 4
    return int(SKETCH * p - 3 * (SKETCH * p * (1 - p)) ** 0.5)


@dataclass
class Found:
    """members: rec_type, cls, id of every record that counts. links: rec_type, cls_a, cls_b, similarity of different classes."""

    members: DataFrame
    links: DataFrame


def meet(least: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of node, cls, sketch, side, sorted by node: node and pairs a < b that share one.

    Pairs need at least so many sketch values in common, and different sides unless side is 0. Nodes with
    more than most rows give their members instead, each with a null b; no more rows than that are held.
    """

    def out(node: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.maximum(a, b))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(a if b is None else np.minimum(a, b)), second], ["node", "a", "b"])

    def pairs(node: np.ndarray, cls: np.ndarray, sketch: np.ndarray, side: np.ndarray, first: np.ndarray, n: int) -> pa.RecordBatch:
        i, j = np.triu_indices(n, 1)
        x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
        near = (_agreeing(sketch[x], sketch[y]) >= least) & (cls[x] != cls[y]) & ((side[x] == 0) | (side[x] != side[y]))
        return out(node[x[near]], cls[x[near]], cls[y[near]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dense = [np.empty(0, np.int64) for _ in range(4)], None
        for b in _and_end(batches):
            if b is not None:
                held = [np.append(h, c.to_numpy(zero_copy_only=False)) for h, c in zip(held, b.columns)]
            node = held[0]
            if not len(node):
                continue
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            sizes = np.diff(np.append(first, len(node)))
            open_run = b is not None and sizes[-1] <= most and node[-1] != dense
            full = len(first) - open_run
            big = (sizes > most) | (node[first] == dense) if dense is not None else sizes > most
            for at in np.flatnonzero(big[:full]):
                part = slice(first[at], first[at] + sizes[at])
                yield out(node[part], held[1][part], None)
            rest = np.flatnonzero(~big[:full])
            for n in np.unique(sizes[rest]):
                if n > 1:
                    # A node of n rows gives n * (n - 1) / 2 pairs; as many nodes at once as stay below four million.
                    starts, step = first[rest[sizes[rest] == n]], max(1, 8_000_000 // int(n * (n - 1)))
                    for k in range(0, len(starts), step):
                        yield pairs(*held, starts[k : k + step], int(n))
            dense = node[-1] if big[-1] else None
            held = [h[first[-1] :] if open_run else h[:0] for h in held]

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _met(rows: DataFrame, threshold: float, most: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), and members (node, cls) of nodes with more than most rows, of node, cls, sketch, side."""
    ordered = rows.select("node", "cls", "sketch", "side").repartition("node").sortWithinPartitions("node")
    all_met = materialize(ordered.mapInArrow(meet(least_agreeing(threshold), most), "node long, a long, b long"), label)
    return all_met.where("b is not null").select("a", "b"), all_met.where("b is null").select("node", F.col("a").alias("cls"))


def marked(hashes: DataFrame, column: str) -> DataFrame:
    """bucket and bits: a bitmap of BITS bits with one set for each hash, in at most BITS / 32,768 rows."""
    place = F.pmod(F.col(column), F.lit(BITS))
    return hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def maybe_marked(rows: DataFrame, column: str, marks: DataFrame) -> DataFrame:
    """The rows whose hash has its bit set in marks: all that were marked, and few others while fewer than BITS hashes are."""
    place = F.pmod(F.col(column), F.lit(BITS))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "bucket")
    return near.where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("bucket", "bits")


def texts_of(spark: SparkSession, sf_dir: str, kinds: tuple[Kind, ...], signed: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """By kind: cls and units of one record of each wanted class, the one with the smallest id.

    Texts are sorted to their classes whatever their number, but only those whose hash may be a wanted one.
    """
    ids = materialize(signed.join(wanted, "cls", "left_semi").groupBy("rec_type", "cls").agg(F.min(F.struct("id", "text_hash")).alias("r")).select("rec_type", "cls", "r.*"), "wanted")
    marks = materialize(marked(ids, "text_hash"), "marks")
    out = {}
    for kind in kinds:
        want = ids.where(F.col("rec_type") == kind.name).select("id", "text_hash", "cls")
        rows = spark.read.parquet(f"{sf_dir}/{kind.table}.parquet").select(F.col(kind.key).alias("id"), F.col(kind.text).alias("text"))
        rows = maybe_marked(rows.withColumn("text_hash", F.xxhash64("text")), "text_hash", marks)
        # Sorted on both sides whatever the size; repeated rows of a key then lie together.
        rows = rows.join(want.hint("merge"), ["id", "text_hash"])
        out[kind.name] = rows.groupBy("id", "text_hash").agg(F.first("cls").alias("cls"), F.first("text").alias("text")).select("cls", units_of("text", kind).alias("units"))
    return out


def near_duplicates(spark: SparkSession, sf_dir: str, kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.6, recall: float = 0.99) -> Found:
    """Classes of equal unit sequences, and all pairs of classes with at least that Jaccard similarity, found with that recall.

    Repeated rows of a key with the same text count once; a key with several texts is in a class for each.
    Null keys and texts, and texts too short, are in none. Copies cost one row each, whatever their number.
    """

    def sign(rows: DataFrame, kind: Kind, seed: int, trees: int) -> DataFrame:
        run = signer(kind.units == "words", kind.shingle, trees, prefix_depth(kind.trees, threshold, recall), seed)
        return rows.mapInArrow(run, SIGNED).select(F.lit(kind.name).alias("rec_type"), "*")

    signed = [sign(records(spark, sf_dir, kind), kind, 7919 * (i + 1), kind.trees) for i, kind in enumerate(kinds)]
    signed = materialize(reduce(DataFrame.unionByName, signed), "signatures")
    members = signed.select("rec_type", "cls", "id").distinct()

    classes = signed.groupBy("cls").agg(F.min_by("keys", "id").alias("keys"), F.min("sketch").alias("sketch"))
    labels = classes.select("cls", "sketch", F.explode("keys").alias("node"), F.lit(0).cast("long").alias("side"))
    pairs, dense = _met(labels, threshold, NODE, "met")
    met = [pairs]
    for level in range(1, LEVELS):
        if dense.isEmpty():
            break
        units = texts_of(spark, sf_dir, kinds, signed, dense.select("cls").distinct())
        # Half as many trees again, for what meets in the node is to meet again inside it.
        again = [
            sign(units[kind.name].select(F.col("cls").alias("id"), "units", F.lit(0).cast("long").alias("text_hash")), kind, 7919 * (i + 1) + 104_729 * level, kind.trees * 3 // 2).drop("cls").withColumnRenamed("id", "cls")
            for i, kind in enumerate(kinds)
        ]
        again = materialize(reduce(DataFrame.unionByName, again).select("cls", "sketch", "keys"), f"signatures-{level}")
        inner = dense.join(again, "cls").select("node", "cls", "sketch", F.explode("keys").alias("key"))
        inner = inner.select(F.xxhash64("node", "key").alias("node"), "cls", "sketch", F.lit(0).cast("long").alias("side"))
        pairs, dense = _met(inner, threshold, NODE, f"met-{level}")
        met.append(pairs)
    if not dense.isEmpty():
        met.append(_blocks(dense, classes, threshold))
    met = materialize(reduce(DataFrame.unionByName, met).distinct().select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b")), "candidates")

    involved = met.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    units = texts_of(spark, sf_dir, kinds, signed, involved)
    sets = [units[kind.name].select("cls", F.lit(kind.name).alias("rec_type"), shingle_set("units", kind).alias("set")) for kind in kinds]
    sets = reduce(DataFrame.unionByName, sets)
    left = sets.select(F.col("cls").alias("cls_a"), "rec_type", F.col("set").alias("set_a"))
    right = sets.select(F.col("cls").alias("cls_b"), F.col("set").alias("set_b"))
    pairs = met.join(left, "cls_a").join(right, "cls_b").withColumn("both", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    # Whole numbers decide, so that a similarity of exactly the threshold counts.
    union = F.size("set_a") + F.size("set_b") - F.col("both")
    exact = pairs.where(F.col("both") * 1_000_000 >= F.round(F.lit(threshold * 1_000_000)).cast("long") * union)
    links = exact.select("rec_type", "cls_a", "cls_b", (F.col("both") / union).alias("similarity"))
    return Found(members, links)


def _blocks(dense: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """All pairs of the members of each node, in pairs of blocks of about NODE members, so that no task holds a node."""
    sized = dense.groupBy("node").agg(F.ceil(F.count("*") / F.lit(NODE)).cast("int").alias("n_blocks"))
    rows = dense.join(sized, "node").join(classes.select("cls", "sketch"), "cls").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    place = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    # Blocks vary in size by chance only; four times the mean doesn't occur.
    pairs, rest = _met(rows.select(place.alias("node"), "cls", "sketch", side.cast("long").alias("side")), threshold, 8 * NODE + 64, "blocks")
    if not rest.isEmpty():
        raise RuntimeError("a block of more than eight times NODE members")
    return pairs


def pairs_of(found: Found) -> DataFrame:
    """rec_type, id_a, id_b of all linked records, id_a < id_b.

    A class of more than SMALL_CLASS copies is written as pairs of its first record with each copy, and
    its links to other classes as those of its first record; all other pairs are written out.
    """
    sized = found.members.groupBy("rec_type", "cls").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    members = found.members.join(sized.where("n > 1"), ["rec_type", "cls"])
    first = members.where((F.col("n") > SMALL_CLASS) & (F.col("id") > F.col("first"))).select("rec_type", F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    few = members.where(F.col("n") <= SMALL_CLASS).select("rec_type", "cls", "id")
    within = few.withColumnRenamed("id", "id_a").join(few.withColumnRenamed("id", "id_b"), ["rec_type", "cls"]).where("id_a < id_b").select("rec_type", "id_a", "id_b")

    shown = found.members.join(sized, ["rec_type", "cls"]).where((F.col("n") <= SMALL_CLASS) | (F.col("id") == F.col("first"))).select("cls", "id")
    across = found.links.join(shown.select(F.col("cls").alias("cls_a"), F.col("id").alias("x")), "cls_a")
    across = across.join(shown.select(F.col("cls").alias("cls_b"), F.col("id").alias("y")), "cls_b").where("x != y")
    across = across.select("rec_type", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return first.unionByName(within).unionByName(across).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found: pairs of records with a similarity of at least 0.6, within each kind."""
    return pairs_of(near_duplicates(spark, sf_dir))


def components(links: DataFrame) -> DataFrame:
    """member, group (the smallest connected member) of all that links (a, b) connect.

    Large stars and small stars in turn: each node's larger neighbours, then its smaller ones, are linked
    to its smallest, until nothing changes. Every round is written, so lineage stays short.
    """
    edges, before = links.select("a", "b").where("a != b"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b").distinct()
        large = materialize(large, "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "small-stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("member"), F.col("b").alias("group")).unionByName(edges.select(F.col("b").alias("member"), F.col("b").alias("group")).distinct())
        before = now


def classes_at(spark: SparkSession, sf_dir: str, kinds: tuple[Kind, ...], threshold: float) -> DataFrame:
    """rec_type, rec_id, class_id, n_links and group_id of every record that counts.

    A class has the records with one sequence of units, and class_id is its smallest id. n_links is the
    number of other classes that are similar, and group_id the smallest id of all records that links
    connect, directly or through others.
    """
    result = near_duplicates(spark, sf_dir, kinds, threshold)
    links = materialize(result.links.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    named = result.members.groupBy("rec_type", "cls").agg(F.min("id").alias("class_id"))
    named = named.join(ends, "cls", "left").join(components(links).withColumnRenamed("member", "cls"), "cls", "left")
    named = named.withColumn("group", F.coalesce("group", "cls"))
    groups = named.groupBy("rec_type", "group").agg(F.min("class_id").alias("group_id"))
    out = result.members.join(named.join(groups, ["rec_type", "group"]), ["rec_type", "cls"])
    return out.select("rec_type", F.col("id").alias("rec_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_classes: classes_at for shingles of five words (titles: five characters) and a similarity of at least 0.8."""
    return classes_at(spark, sf_dir, tuple(Kind(k.name, k.table, k.key, k.text, k.units, k.least, 20, 5) for k in KINDS), 0.8)


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_similar: classes_at for the shingles and the similarity of p3_found, which it completes for classes of many copies."""
    return classes_at(spark, sf_dir, KINDS, 0.6)

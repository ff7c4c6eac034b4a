"""Near-duplicates by SimHash fingerprints that are joined through the Golay code.

A 64-bit fingerprint is cut into segments a, b, c of 22, 21 and 21 bits, each padded to a word of 23. The perfect
(23, 12) Golay code has one codeword within 3 bits of any word, so if two words differ in one bit, the codeword nearest
to either is within 4 bits of the other. Keys of a fingerprint pair one segment, as it is, with each codeword within 4
bits of another: c with a, a with b, b with c. Two fingerprints with 2 differing bits or fewer have by the pigeonhole
principle an equal segment beside one with at most one error in one of these pairs, and so share a key.

Keys with many fingerprints (a large group of near copies) aren't paired out: their fingerprints meet in the words that
are one bit away or none, of which two fingerprints share one exactly if they differ in at most 2 bits. Such a word has
65 neighbours at most, so this is linear, and exact too.

one_of_each keeps one text of each component of near copies: fingerprints of five-word shingles that are joined so are
verified by the similarity of the whole sets. Since texts that are 4/5 alike differ in up to a dozen bits, which no number
of keys could cover, a join of the sets by their rarest shingles adds exactly the links that fingerprints miss.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import discard, map_batches, materialize, release, rows_of, small_batches, texts_of, tidy
from .components import components

#: Fixed value: the generator of the cyclic (23, 12) Golay code.
GENERATOR = 0b101011100011
WORDS = 3
#: Fingerprints of a key that are still paired.
CROWD = 48
#: Rows of a digest in a task that still go to one partition.
TOGETHER = 64
#: First bit and width of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))


def fingerprint(text: bytes, width: int = WORDS, seed: int = 42) -> int:
    """SimHash over the XXH64 of word shingles, repeats included; of the whole sequence if there are fewer words; 0 of none."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        starts, ends = [0], [sum(map(len, words)) + len(words) - 1]
    else:
        sizes = np.fromiter(map(len, words), "i8", len(words)) + 1
        stops = np.cumsum(sizes) - 1
        starts, ends = np.concatenate([[0], stops[:-width] + 1]).tolist(), stops[width - 1 :].tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return majority((np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)], strict=True)], "<u8") for lo in range(0, len(starts), 1 << 16)))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that are set in more than half of all hashes, given in parts."""
    votes, n = np.zeros(64, "i8"), 0
    for h in hashes:
        votes += np.unpackbits(h.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
        n += len(h)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


@lru_cache(1)
def code() -> tuple[np.ndarray, np.ndarray]:
    """The 4096 codewords, and for each syndrome of 11 bits all words of weight 4 or less with it (rows filled up by the first)."""
    shifts = np.array([GENERATOR << k for k in range(12)])
    book = np.zeros(4096, "i8")
    for k, s in enumerate(shifts):
        book ^= np.where(np.arange(4096) >> k & 1, s, 0)
    bits = np.zeros(1, "i8")
    near = [bits]
    singles = 1 << np.arange(23)
    for _ in range(4):
        bits = np.unique((bits[:, None] | singles[None]).ravel())
        near.append(bits)
    bits = np.unique(np.concatenate(near))
    by = syndrome(bits)
    order = np.argsort(by, kind="stable")
    counts = np.bincount(by, minlength=2048)
    first = np.cumsum(counts) - counts
    table = bits[order][np.minimum(first[:, None] + np.arange(counts.max()), (first + counts - 1)[:, None])]
    return book, table


def syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder of words by the generator, as polynomials over two elements."""
    x = np.array(x, "i8")
    for k in range(22, 10, -1):
        x ^= np.where(x >> k & 1, GENERATOR << (k - 11), 0)
    return x


def near_codewords(x: np.ndarray) -> np.ndarray:
    """Indices (by their upper 12 bits, which tell codewords apart) of the codewords within 4 bits; a row a word, some repeated."""
    _, table = code()
    x = np.asarray(x, "i8")
    return (x[:, None] ^ table[syndrome(x)]) >> 11


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) without repeats. Keys have 2 bits for the pair, 22 for the segment, 12 for the codeword."""
    f = np.asarray(fingerprints, "u8")
    seg = [(f >> np.uint64(lo)).astype("i8") & ((1 << n) - 1) for lo, n in SEGMENTS]
    at, out = [], []
    for pair, (exact, coded) in enumerate(((2, 0), (0, 1), (1, 2))):
        words = near_codewords(seg[coded])
        k = (pair << 34 | seg[exact] << 12)[:, None] | words
        k.sort(1)
        fresh = np.ones(k.shape, bool)
        fresh[:, 1:] = k[:, 1:] != k[:, :-1]
        at.append(np.nonzero(fresh)[0])
        out.append(k[fresh])
    return np.concatenate(at), np.concatenate(out)


def fingerprints(df: DataFrame, width: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a signed long. A null text has no words, like an empty one."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([fingerprint(t or b"", width) for t in texts_of(b.column(1))], "u8").view("i8"))], names=[key, "fp"])

    return map_batches(df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")), fn, f"`{key}` long, fp long")


def links(fps: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, list[str]]:
    """Edges (u, v) over distinct fingerprints (fp) that connect exactly what links of 2 bits or fewer connect: each link
    through a key of at most crowd fingerprints, and for larger keys a star around each word that is within one bit."""
    spark = fps.sparkSession

    def keyed(batches):
        for b in batches:
            f = b.column(0).to_numpy()
            for lo in range(0, len(f), 20_000):
                at, k = keys(f[lo : lo + 20_000].view("u8"))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f[lo : lo + 20_000][at])], names=["key", "fp"])

    every, every_at = materialize(fps.mapInArrow(keyed, "key long, fp long"), "keys")
    many = every.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    shared, shared_at = materialize(every.join(many, "key"), "shared")
    discard(spark, every_at)
    few = shared.filter(F.col("times") <= crowd)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2))
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowded = shared.filter(F.col("times") > crowd).select("fp").distinct()

    def flips(batches):
        masks = np.concatenate([[0], 1 << np.arange(64, dtype="u8")]).astype("u8")
        for b in batches:
            f = b.column(0).to_numpy()
            for lo in range(0, len(f), 20_000):
                x = f[lo : lo + 20_000].view("u8")
                yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ masks).ravel().view("i8")), pa.array(np.repeat(x, 65).view("i8"))], names=["word", "fp"])

    met = crowded.mapInArrow(flips, "word long, fp long").groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # at most 65 of them
    stars = met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u != v")
    return pairs.union(stars), [shared_at]


def near_duplicates(df: DataFrame, width: int = WORDS, crowd: int = CROWD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) of every row: component_id is the smallest key reachable over fingerprints that differ in 2
    bits or fewer, the row's own included. Rows with a null key get their group's smallest key (null if it has none); a
    repeated row gives a repeated result; an empty table gives an empty one."""
    spark = df.sparkSession
    docs, _ = materialize(fingerprints(df, width, text, key), "fingerprints")
    classes, classes_at = materialize(docs.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    edges, edges_at = links(classes.select("fp"), crowd)
    edges, linked_at = materialize(edges, "links")
    discard(spark, *edges_at)
    nodes, nodes_at = components(edges)
    discard(spark, linked_at)
    rooted = classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids, _ = materialize(rooted.join(smallest, "root").select("fp", "component_id"), "members")
    discard(spark, classes_at, *nodes_at)
    return docs.join(ids, "fp", "left").select(key, "fp", "component_id")


def _shingled(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns (text among them) and, of each row: its number, the digest, the size and the SimHash of its set of shingles. Rows
    of a digest lie together, by their numbers; of one that a task has very often, as many together as every task may have."""
    at = columns.index("text")

    def fn(batches):
        times: Counter[bytes] = Counter()
        for b in rows_of(batches):
            made = []
            for t in texts_of(b.column(at)):
                h = shingles.shingles(t or b"")
                digest = xxhash.xxh3_128_digest(h.tobytes())
                made.append((digest, len(h), majority(h[lo : lo + (1 << 16)] for lo in range(0, len(h), 1 << 16)), times[digest] // TOGETHER))
                times[digest] += 1
            digest, size, fp, part = zip(*made, strict=True)
            own = [pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(np.array(fp, "u8").view("i8")), pa.array(part, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*columns, "near_row", "digest", "size", "fp", "part"])
        tidy()

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), "near_row long, digest binary, size long, fp long, part long"])
    made = small_batches(df.select(*columns, F.monotonically_increasing_id().alias("near_row"))).mapInArrow(fn, schema)
    return made.repartition("digest", "part").sortWithinPartitions("digest", "near_row").drop("part")


def one_of_each(df: DataFrame, columns: tuple[str, ...], crowd: int = CROWD) -> DataFrame:
    """One row of each component of near copies, whose sets of five-word shingles have a similarity of 4/5 or more: one with
    the smallest doc_id, or with none where all have none. Rows are told apart by themselves, never by doc_id. Null texts
    and others without words are copies of each other. The columns include doc_id and text; an empty table gives an empty one.

    Candidates are fingerprints within 2 bits (by Golay keys), and for each key of the rarest shingles its most common set with
    all others; then, of those sets of a key that aren't connected with that one, all with whatever else the key has.
    Pairs whose MARKS rule the similarity out never leave the join; each other candidate is verified by the whole sets. A set
    (node) goes by the smallest number of its rows."""
    spark = df.sparkSession
    docs, _ = materialize(_shingled(df, columns), "shingled")
    release(spark)
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "near_row")).alias("best")
    classes, classes_at = materialize(docs.groupBy("digest").agg(F.first("fp").alias("fp"), own, F.min("near_row").alias("node")).drop("digest"), "classes")
    sets, sets_at = materialize(shingles.shared_sets(docs), "sets")
    release(spark)

    nodes = sets.join(classes.select(F.col("node").alias("near_row")), "near_row", "left_semi").withColumnRenamed("near_row", "node")
    keys = nodes.select("node", F.explode(F.slice("h", F.lit(1), F.col("first").cast("int"))).alias("key"))
    twice = keys.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key")
    shared, shared_at = materialize(keys.join(twice, "key").join(nodes.select("node", *shingles.MARKS), "node"), "shared")

    release(spark)
    alike = classes.groupBy("fp").agg(F.min("node").alias("first"))
    edges, linked_at = links(classes.select("fp").distinct(), crowd)
    met = edges.join(alike.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(alike.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select("a", "b")
    met = met.union(classes.join(alike, "fp").select(F.col("first").alias("a"), F.col("node").alias("b")))
    hubs = shared.groupBy("key").agg(F.min(F.struct(F.col("alone") / F.col("size"), "node", *shingles.MARKS)).alias("hub")).select("key", "hub.*")
    met = met.union(hubs.alias("a").join(shared.alias("b"), (F.col("a.key") == F.col("b.key")) & shingles.may_be_alike("a", "b")).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    first, first_at = shingles.verified(met.filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), sets)
    discard(spark, *linked_at)
    release(spark)
    joined, joined_at = components(first)
    rooted, rooted_at = materialize(shared.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    main = rooted.groupBy("key").agg(F.min(F.struct(F.col("alone") / F.col("size"), "node", "root")).alias("hub")).select("key", F.col("hub.root").alias("main"))
    apart = rooted.join(main, "key").filter("root != main")
    rest = apart.alias("a").join(rooted.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & shingles.may_be_alike("a", "b"))
    second, second_at = shingles.verified(rest.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")), sets)
    discard(spark, shared_at, sets_at, rooted_at, *joined_at)
    release(spark)
    roots, roots_at = components(first.union(second))
    discard(spark, first_at, second_at)
    chosen = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    chosen, _ = materialize(chosen.select(F.col("best.near_row").alias("near_row")), "chosen")
    discard(spark, classes_at, *roots_at)
    release(spark)
    return docs.join(chosen, "near_row", "left_semi").select(*columns)

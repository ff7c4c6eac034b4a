"""Sets of word shingles: hashes, the order of shingles from rare to frequent ones, and an exact join of similar sets.

Two sets with a similarity of 4/5 or more share at least 4/5 of the larger one, so in any order of all shingles they share
one among the first fifth (and one more) of each. The order here goes from rare to frequent by counts over all texts, and then
by hash. A shingle that was counted once is in no other text and need not be a key at all; a text of which more than a fifth
is so is like no other.

Counts are made where the shingles of a stretch of hashes meet, and only those of more than one text go back to the block of
texts that they came from. So no task holds more than a stretch or a block, however many texts there are, and what moves is
about 5 bytes a shingle and 6 more for one that texts share.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, rows_of, small_batches, squeeze, texts_of, tidy, unsqueeze

#: Words of a shingle, and the least similarity (a fraction) of near copies.
WIDTH, ALIKE = 5, (4, 5)
#: Shingles of a stretch of hashes (about), stretches at least, shingles that a task sorts at once, and texts of a block at most.
STRETCH, STRETCHES, SORTED, BLOCK = 1 << 20, 64, 1 << 21, 1 << 16
#: Words hashed at once; longer words than MOST_BYTES stand for themselves by a digest.
STEP, MOST_BYTES = 1 << 14, 1 << 10


@lru_cache(1)
def _bytes_and_base() -> tuple[np.ndarray, np.uint64, np.uint64]:
    """A random number for each byte, an odd base, and its inverse modulo 2^64."""
    rng = np.random.default_rng(20)
    base = int(rng.integers(0, 1 << 62)) * 2 + 1
    return rng.integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _, base, inverse = _bytes_and_base()
        size = max(1 << 16, 1 << n.bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, "u8")]), dtype="u8") for x in (base, inverse)]
    return _POWERS[0], _POWERS[1]


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles (A-Z in lower case), rising; of the whole sequence if there are
    fewer words; none of none. A hash is a polynomial over the bytes, taken from running sums, and mixed."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "u8")
    if len(text) > MOST_BYTES:
        words = [w if len(w) <= MOST_BYTES else xxhash.xxh3_128_digest(w) for w in words]
    values, _, _ = _bytes_and_base()
    width, out = min(width, len(words)), []
    for lo in range(0, len(words) - width + 1, STEP):
        part = words[lo : lo + STEP + width - 1]
        b = np.frombuffer(b" ".join(part), "u1")
        sizes = np.fromiter(map(len, part), "i8", len(part)) + 1
        stops = np.cumsum(sizes)
        starts = (stops - sizes)[: len(part) - width + 1]
        up, down = _powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, "u8")
        np.cumsum(values[b] * up[: len(b)], out=sums[1:])
        x = (sums[stops[width - 1 :] - 1] - sums[starts]) * down[starts]
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        out.append(x ^ x >> np.uint64(33))
    x = np.sort(out[0] if len(out) == 1 else np.concatenate(out))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _packed(x: np.ndarray) -> bytes:
    """Rising numbers as their differences, byte by byte of all."""
    return squeeze(np.diff(x, prepend=np.uint64(0)).astype("<u8").view("u1").reshape(-1, 8).T.tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(unsqueeze(x), "u1").reshape(8, -1).T).view("<u8").ravel(), dtype="u8")


#: What tells of two sets whether they can be alike.
MARKS = ("size", "alone", "odd0", "odd1", "odd2", "odd3")


def may_be_alike(a: str, b: str):
    """Whether the marks of two sets leave room for the similarity: shingles that one set alone has, and each hash value that
    one has an odd and the other an even number of, are differences, which are to be at most a ninth of both sizes."""
    own = lambda x, c: F.col(f"{x}.{c}")
    apart = own(a, "alone") + own(b, "alone") + sum((F.bit_count(own(a, c).bitwiseXOR(own(b, c))) for c in MARKS[2:]), F.lit(0))
    return apart * (ALIKE[1] + ALIKE[0]) <= (own(a, "size") + own(b, "size")) * (ALIKE[1] - ALIKE[0])


def shared_sets(texts: DataFrame) -> DataFrame:
    """Of rows (near_row, digest, size, text) those of whose set 4/5 or more are in other sets too, with their MARKS: the parities of
    how many of the shared shingles have each of 256 hash values are bits of the four odd ones. h has the shared shingles (the first
    48 bits of their hashes) from rare to frequent, and the set meets others by the first of them. A row that follows one of the same
    digest and a smaller near_row is left out, so of each digest the row with the smallest near_row is there."""
    total = texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shift, most_sorted, most_texts = np.uint64(64 - (max(total // STRETCH, STRETCHES) - 1).bit_length()), SORTED, BLOCK
    low = np.uint64(16)

    def stretches(batches):
        """(stretch, block, body): rising numbers of 48 bits of a hash and 16 of the text's place in its block; and of each block, under
        a negative number of its own, near_row and size of its texts."""
        block, held, rows, n, last = TaskContext.get().partitionId() << 32, [], [], 0, (None, 0)

        def sent():
            x = np.sort(np.concatenate(held))
            of = (x >> shift).astype("i8")
            at = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(x)]
            bodies = [_packed(x[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
            names = [*of[at[:-1]].tolist(), -1 - block]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([block] * len(names), pa.int64()), pa.array([*bodies, squeeze(np.array(rows, "<i8").T.tobytes())], pa.binary())], names=["stretch", "block", "body"])

        for b in rows_of(batches, "text"):
            for row, digest, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                if digest == last[0] and row > last[1]:
                    continue
                last = (digest, row)
                h = shingles(t or b"")
                if not len(h):
                    continue
                held.append(h >> low << low | np.uint64(len(rows)))
                rows.append((row, len(h)))
                n += len(h)
                if n >= most_sorted or len(rows) == most_texts:
                    yield sent()
                    block, n = block + 1, 0
                    held.clear()
                    rows.clear()
        if rows:
            yield sent()
        held.clear()
        tidy()

    def counted(batches):
        """(block, body, times): the numbers whose hash others have too, and how many; without times, a block's texts."""
        now, blocks, bodies = None, [], []

        def met():
            xs = [_unpacked(x) for x in bodies]
            key = np.sort(np.concatenate(xs) >> low)
            again, times = np.unique(key[1:][key[1:] == key[:-1]], return_counts=True)
            out = []
            for block, x in zip(blocks, xs, strict=True) if len(again) else ():
                at = np.minimum(np.searchsorted(again, x >> low), len(again) - 1)
                hit = again[at] == x >> low
                if hit.any():
                    out.append((block, _packed(x[hit]), squeeze(np.minimum(times[at[hit]], 65535).astype("<u2").tobytes())))
            return rows(out)

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "body", "times"])

        for b in batches:
            for k, block, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if k < 0:
                    yield rows([(block, x.as_py(), None)])
                    continue
                if now is not None and k != now:
                    yield met()
                    blocks.clear()
                    bodies.clear()
                now = k
                blocks.append(block)
                bodies.append(x.as_py())
        if now is not None:
            yield met()
        tidy()

    def gathered(batches):
        now, texts, bodies, counts = None, None, [], []

        def sets():
            x = np.concatenate([_unpacked(b) for b in bodies])
            times = np.concatenate([np.frombuffer(unsqueeze(b), "<u2") for b in counts])
            row, size = np.frombuffer(unsqueeze(texts), "<i8").reshape(2, -1)
            of, key = (x & np.uint64(65535)).astype("i8"), (x >> low).astype("i8")
            n = np.bincount(of, minlength=len(row))
            alone = size - n
            most = size - -(-size * ALIKE[0] // ALIKE[1]) + 1 - alone
            kept = most[of] > 0
            of, key, times = of[kept], key[kept], times[kept]
            key = key[np.lexsort((key, times, of))]
            own = np.flatnonzero(most > 0)
            ends = np.cumsum(n[own])
            for lo in range(0, len(own), 2048):
                m = own[lo : lo + 2048]
                h = key[ends[lo] - n[m[0]] : ends[lo + len(m) - 1]]
                odd = np.bincount(np.repeat(np.arange(len(m)), n[m]) << 8 | h & 255, minlength=len(m) << 8) & 1
                odd = np.packbits(odd.astype("u1").reshape(-1, 256), axis=1, bitorder="little").view("<i8")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[m])]).astype("i4")), pa.array(h))
                numbers = [row[m], size[m], alone[m], *odd.T, np.minimum(most[m], n[m])]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in numbers), lists], names=["near_row", *MARKS, "first", "h"])

        for b in batches:
            for block, x, times in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if now is not None and block != now:
                    if bodies:
                        yield from sets()
                    bodies.clear()
                    counts.clear()
                now = block
                if times.is_valid:
                    bodies.append(x.as_py())
                    counts.append(times.as_py())
                else:
                    texts = x.as_py()
        if bodies:
            yield from sets()
        tidy()

    spread = small_batches(texts.select("near_row", "digest", "text")).mapInArrow(stretches, "stretch long, block long, body binary").repartition("stretch").sortWithinPartitions("stretch")
    back = spread.mapInArrow(counted, "block long, body binary, times binary").repartition("block").sortWithinPartitions("block")
    return back.mapInArrow(gathered, ", ".join(["near_row long", *(f"{c} long" for c in MARKS), "first long, h array<long>"]))


def verified(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, str]:
    """The pairs (u, v) of rows of sets (shared_sets) that are alike, and the table's place. A pair without both sets isn't. What both
    have is among what either shares, so their sizes and the shared shingles tell."""
    pairs, at = materialize(pairs.distinct(), "met")
    both = F.size(F.array_intersect("a.h", "b.h"))
    met = pairs.join(sets.alias("a"), F.col("u") == F.col("a.near_row")).join(sets.alias("b"), F.col("v") == F.col("b.near_row"))
    out = materialize(met.filter(both * (ALIKE[0] + ALIKE[1]) >= (F.col("a.size") + F.col("b.size")) * ALIKE[0]).select("u", "v"), "alike")
    discard(pairs.sparkSession, at)
    return out

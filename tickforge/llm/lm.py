"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words (A-Z in lower case) and one end. A word is spelled in bytes with a closing space, an end by the space
alone, and a byte in eight binary decisions. For each decision several contexts (the last one, two and three bytes, the
word so far, and the place in the word or, in a word's first two bytes, the class of the word before) give counts of both
outcomes from hashed tables. The counts' log odds are combined by weights that the amount of evidence selects, and
the sum is refined by an adaptive map of probability; weights and map are learned online, by steps over batches of words,
each with its own occurrence taken out of the counts. Counts come from all training texts; the tables have a fixed size.

The text itself is then followed token by token. Four binary predictions come before the literal word: that it is the one that
followed the last two words at their last place in the text, that it is the one that followed the last word there, that
it is the one that training texts have most often after the last word, and that it is any word of the text so far. Each
bit has several contexts, whose counts are updated along the text (the last outcomes, the word before, the text as a whole)
or come from training (how often candidate and successor were met). Their log odds are combined by weights that the
evidence for the word before selects, learned from all training texts (each without what it adds to the counts itself),
and the result is refined by the text's own outcomes at like probabilities. A text begins afresh, so texts are parallel.

Texts are handled in blocks of bounded size with a dictionary each, so that a word's count is looked up and its spelling is
scored once a block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import count, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release, rows_of, squeeze, tidy, unsqueeze

#: Text bytes of a block, and classes of a preceding word (the last is for none).
BLOCK, CLASSES = 12 << 20, 64
#: Slots by context: last byte, last two, last three, word so far, place or class.
SLOTS = (1 << 16, 1 << 20, 1 << 20, 1 << 22, 1 << 19)
STARTS = np.cumsum([0, *SLOTS])
CHUNK = 1 << 14
#: Words whose bytes are handled together, and text words likewise: their arrays stay in a core's cache.
WORDS_AT_ONCE, SPAN = 4096, 1 << 15
#: Distinct words of one partial table, and rows of blocks' dictionaries in a bucket of words.
PARTIAL, BUCKET = 1_000_000, 400_000
#: Rows of buckets in one batch.
SENT = 32
K = len(SLOTS)
PRIOR, LEAST = 0.4, 1e-5
#: Sets of weights: by evidence for the word so far and for the last three bytes (in heads: the class), apart for heads.
GATES = 8 * 4 * 2
BUCKETS = 33


def pack_counts(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact to 31, then in steps of a ninth of an octave."""
    n = np.asarray(n, "f8")
    return np.where(n < 31.5, np.rint(n), np.clip(np.rint(32 + 9 * np.log2(np.maximum(n, 32) / 32)), 32, 255)).astype("u1")


UNPACKED = np.concatenate([np.arange(32.0), 32 * 2.0 ** ((np.arange(32, 256) - 32) / 9)])
_LOG = np.log(UNPACKED + PRIOR).astype("f4")
#: Evidence in few steps: 0, 1, 2, 3-4, 5-8, 9-31, to 1000, more.
_STEP = np.searchsorted([0.5, 1.5, 2.5, 4.5, 8.5, 31.5, 1000], UNPACKED).astype("u1")


def _by_pair() -> tuple[np.ndarray, np.ndarray]:
    """Log odds, and steps of the larger count, of all pairs of counts: with an outcome 0 taken out, with a 1, and as they are."""
    packed = np.arange(256)
    less = np.where((packed > 0) & (packed < 32), packed - 1, packed)
    b, a = np.meshgrid(packed, packed, indexing="ij")
    every = ((less[a], b), (a, less[b]), (a, b))
    return np.concatenate([(_LOG[y] - _LOG[x]).ravel() for x, y in every]), np.concatenate([_STEP[np.maximum(x, y)].ravel() for x, y in every])


_ODDS, _WEIGHT = _by_pair()


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' bytes with a closing space each, and where each begins (one more for the end)."""
    buf = np.frombuffer(b" ".join(words) + b" " if words else b"", np.uint8)
    sizes = np.fromiter(map(len, words), "i8", len(words)) + 1
    return buf, np.concatenate([[0], np.cumsum(sizes)])


def spelled(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What spell() gives, from its bytes alone: no word holds a space."""
    buf = np.frombuffer(data, np.uint8)
    return buf, np.concatenate([[0], np.flatnonzero(buf == 32) + 1])


def respelled(buf: np.ndarray, starts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the given numbers, in that order."""
    sizes = np.diff(starts)[order]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return buf[np.repeat(starts[:-1][order] - begins[:-1], sizes) + np.arange(begins[-1])], begins


def as_arrow(buf: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words, each with its closing space."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype("<i4")), pa.py_buffer(np.ascontiguousarray(buf))])


def arrow_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An array's bytes and offsets."""
    offsets = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1].astype("i8")
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def head_codes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first two bytes of each word (of one byte: with its space) as a number; 0x2000 of the end."""
    sizes = np.diff(starts)
    return buf[starts[:-1]].astype("i8") << 8 | np.where(sizes > 1, buf[np.minimum(starts[:-1] + 1, len(buf) - 1)], 0)


def code_of(head: bytes) -> int:
    return (head[0] << 8 | (head + b" ")[1]) if head.strip(b" ") else 0x2000


def head_of(code: int) -> bytes:
    return b" " if code == 0x2000 else bytes([code >> 8, code & 255])


def contexts(buf: np.ndarray, starts: np.ndarray, classes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each context at each byte (K x bytes, unsigned), and each byte's place in its word. classes: of the word
    before, by word, for heads; None for whole words, whose first two places aren't used then."""
    n = len(buf)
    sizes = np.diff(starts)
    place = np.arange(n) - np.repeat(starts[:-1], sizes)
    b = buf.astype("u4")
    back = []
    for k in (1, 2, 3):
        x = np.zeros(n, "u4")
        x[k:] = b[:-k]
        back.append(np.where(place >= k, x, 0))
    # Prefix hashes by place: the longest word takes one step for each of its bytes, over the words that reach it.
    pre = np.zeros(n, "u4")
    order = np.argsort(-sizes, kind="stable")
    ranked, at = sizes[order], starts[:-1][order]
    m = np.searchsorted(-ranked, -np.arange(1, (int(ranked[0]) if len(ranked) else 0) + 1), side="right")  # words with at least so many bytes
    h = np.full(len(order), 0x811C9DC5, "u4")
    for k in range(len(m)):
        h = h[: m[k]]
        pre[at[: m[k]] + k] = h
        h = (h ^ b[at[: m[k]] + k]) * np.uint32(0x01000193) ^ (h >> np.uint32(15))
    one, two, three = back
    place_or_class = (np.minimum(place, 31).astype("u4") << np.uint32(8) | one) if classes is None else (np.repeat(classes.astype("u4"), sizes) * np.uint32(0x9E3779B1) ^ pre) | np.uint32(1 << 31)
    return np.stack([one, two << np.uint32(8) | one, three << np.uint32(16) | two << np.uint32(8) | one, pre, place_or_class]), place


def slots(h: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """The places in the joined table of each context's counts at a node (1 to 255) of the byte's binary tree."""
    out = []
    for k in range(K):
        x = (h[k] * np.uint32(0x85EBCA6B) + node * np.uint32(0xC2B2AE35 + 2 * k)) if k else (h[k] << np.uint32(8) | node)
        if k:
            x = x ^ (x >> np.uint32(15))
            x = x * np.uint32(0x2C1B3C6D)
            x = x ^ (x >> np.uint32(13))
        out.append((x & np.uint32(SLOTS[k] - 1)).astype("i8") + STARTS[k])
    return out


def tally(words: list[bytes], weights: np.ndarray, tables: np.ndarray, classes: np.ndarray | None = None) -> None:
    """Add words' decisions to the counts (2 x slots): of heads (given classes) the first two bytes, of words the rest."""
    flat, width = tables.reshape(-1), tables.shape[1]
    for lo in range(0, len(words), WORDS_AT_ONCE):
        part = words[lo : lo + WORDS_AT_ONCE]
        buf, starts = spell(part)
        h, place = contexts(buf, starts, None if classes is None else classes[lo : lo + WORDS_AT_ONCE])
        use = np.flatnonzero(place >= 2 if classes is None else place < 2)
        h, b, w = h[:, use], buf[use].astype("u4"), np.repeat(weights[lo : lo + WORDS_AT_ONCE], np.diff(starts))[use].astype("f4")
        node = np.ones(len(use), "u4")
        for bit in range(7, -1, -1):
            y = b >> np.uint32(bit) & np.uint32(1)
            for s in slots(h, node):
                np.add.at(flat, s + y * np.int64(width), w)
            node = node << np.uint32(1) | y


@dataclass
class Mixer:
    """Counts (2 x slots, packed), weights by gate, and the map of refined probability by node and bucket of log odds."""

    counts: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pairs"}

    @cached_property
    def pairs(self) -> np.ndarray:
        """Both counts of a slot in one number."""
        return np.ascontiguousarray(self.counts.T).view("<u2").ravel()

    def inputs(self, where: list[np.ndarray], heads: bool, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each context (K x n) and the gate; with y, one occurrence of that outcome is taken out first."""
        st, gate = np.empty((K, len(where[0])), "f4"), np.full(len(where[0]), 32 * heads, "u1")
        odds, weight = (_ODDS, _WEIGHT) if y is not None else (_ODDS[2 << 16 :], _WEIGHT[2 << 16 :])
        out = y.astype("i8") << 16 if y is not None else 0
        for k, s in enumerate(where):
            v = self.pairs[s].astype("i8")
            v += out
            st[k] = odds[v]
            if k == 3:
                gate += weight[v]
            elif k == (4 if heads else 2):
                gate += (weight[v] >> 1) << 3
        return st, gate

    def mixed(self, st: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w, gate = np.ascontiguousarray(self.weights.T, "f4"), gate.astype("i8")
        z = w[K][gate]
        for k in range(K):
            z += w[k][gate] * st[k]
        return np.clip(z, -11, 11)

    @staticmethod
    def places(z: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower of the two buckets that log odds lie between, and how far they are from it."""
        x = (z + np.float32(11)) * np.float32((BUCKETS - 1) / 22)
        lo = np.minimum(x.astype("i8"), BUCKETS - 2)
        return node * np.int64(BUCKETS) + lo, x - lo.astype("f4")

    def bits(self, z: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a one after the refinement, and the lower bucket's place and the upper's share that it came from."""
        at, part = self.places(z, node)
        r = self.refined.reshape(-1).astype("f4")
        p = np.float32(0.5) / (1 + np.exp(-z)) + np.float32(0.5) * (r[at] * (1 - part) + r[at + 1] * part)
        return np.clip(p, LEAST, 1 - LEAST).astype("f8"), at, part  # in f8, so that it and its rest share one exactly

    def log2(self, buf: np.ndarray, starts: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
        """Base-2 logarithm of each spelled word's probability: of its first two bytes (given classes), or of the rest."""
        out = np.zeros(len(starts) - 1)
        for lo in range(0, len(out), WORDS_AT_ONCE):
            own = starts[lo : lo + WORDS_AT_ONCE + 1]
            part, own = buf[own[0] : own[-1]], own - own[0]
            h, place = contexts(part, own, None if classes is None else classes[lo : lo + WORDS_AT_ONCE])
            use = np.flatnonzero(place >= 2 if classes is None else place < 2)
            h, b = h[:, use], part[use].astype("u4")
            node, chance = np.ones(len(use), "u4"), np.ones(len(use))  # of a byte at least LEAST to the eighth power
            for bit in range(7, -1, -1):
                y = b >> np.uint32(bit) & np.uint32(1)
                p, _, _ = self.bits(self.mixed(*self.inputs(slots(h, node), classes is not None)), node)
                chance *= np.where(y == 1, p, 1 - p)
                node = node << np.uint32(1) | y
            word = np.repeat(np.arange(len(own) - 1), np.diff(own))[use]
            out[lo : lo + WORDS_AT_ONCE] = np.bincount(word, np.log2(chance), len(own) - 1)
        return out

    def learn(self, words: list[bytes], weights: np.ndarray, classes: np.ndarray | None, batch: int = 512, fade: float = 0.995) -> None:
        """Online Newton steps over batches of words in the given order, each word in proportion to its weight, by all bytes after its first two
        (given classes, by those two). The curvature of each gate's weights is summed up with a slow fading."""
        curve = np.tile(np.eye(K + 1) * 20.0, (GATES, 1, 1))
        for lo in range(0, len(words), batch):
            part = words[lo : lo + batch]
            buf, starts = spell(part)
            h, place = contexts(buf, starts, None if classes is None else classes[lo : lo + batch])
            use = np.flatnonzero(place >= 2 if classes is None else place < 2)
            if not len(use):
                continue
            h, b = h[:, use], buf[use].astype("u4")
            w = (np.repeat(weights[lo : lo + batch], np.diff(starts))[use] / weights.mean()).astype("f4")
            node = np.ones(len(use), "u4")
            x = np.ones((K + 1, len(use)), "f4")
            for bit in range(7, -1, -1):
                y = b >> np.uint32(bit) & np.uint32(1)
                st, gate = self.inputs(slots(h, node), classes is not None, y)
                order = np.argsort(gate, kind="stable")  # by gate, so that each gate's sums are products
                cuts = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=GATES))])
                gates = [(g, slice(cuts[g], cuts[g + 1])) for g in np.flatnonzero(np.diff(cuts)).tolist()]
                for k in range(K):
                    x[k] = st[k][order]
                yes, weight = y[order].astype("f4"), w[order]
                z, at_gate = np.empty(len(use), "f4"), self.weights.astype("f4")
                for g, own in gates:
                    z[own] = at_gate[g] @ x[:, own]
                z = np.clip(z, -11, 11)
                p = 1 / (1 + np.exp(-z))
                miss, bent = (yes - p) * weight, x * (p * (1 - p) * weight)
                slope = np.zeros((GATES, K + 1))
                for g, own in gates:
                    slope[g] = x[:, own] @ miss[own]
                    curve[g] += bent[:, own] @ x[:, own].T
                self.weights += np.clip(np.linalg.solve(curve, slope[:, :, None])[:, :, 0], -0.5, 0.5)
                at, share = self.places(z, node[order])
                near = at + (share > 0.5)
                size = self.refined.size
                n = np.bincount(near, weight, size)
                ones = np.bincount(near, weight * yes, size)
                step = 1 - 0.99 ** np.minimum(n, 64)
                flat = self.refined.reshape(-1)
                flat += step * (np.divide(ones, n, out=flat.copy(), where=n > 0) - flat)
                node = node << np.uint32(1) | y
            curve = fade * curve + (1 - fade) * 20.0 * np.eye(K + 1)


def new_mixer(counts: np.ndarray) -> Mixer:
    z = np.linspace(-11, 11, BUCKETS)
    return Mixer(counts, np.concatenate([np.full((GATES, K), 0.3), np.zeros((GATES, 1))], 1), np.tile(1 / (1 + np.exp(-z)), (256, 1)))


def class_of(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A class by the end of each word, which tells much of its language; the end of a text has one of its own."""
    out, sizes = np.zeros(len(starts) - 1, "u8"), np.diff(starts) - 1
    for k in (3, 2, 1):
        at = np.maximum(starts[1:] - 1 - k, 0)
        out = out << np.uint64(8) | np.where(sizes >= k, buf[at], 0).astype("u8")
    out = ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype("i8") % (CLASSES - 1)
    return np.where(sizes > 0, out, CLASSES - 1)


#: The bits before a literal word, and how many states each of a bit's contexts has: the last three outcomes, the word before
#: in this text, training or distance, the text so far.
BITS, STATES = ("pair", "after", "next", "again"), (8, 10, 16, 16)
CELLS, EVIDENCE = 8 * 10 * 16 * 16, 4
#: Log odds that part the refinement's buckets, and how many outcomes the mixed probability counts for there.
EDGES, KEEP = (-2.5, -0.5, 1.0), 24.0


@dataclass
class Known:
    """By word number of a block: hash, training count, hash of the most frequent successor and how often it followed."""

    hashes: np.ndarray
    counts: np.ndarray
    best: np.ndarray
    often: np.ndarray

    @cached_property
    def levels(self) -> np.ndarray:
        """0 to 4 by the training count."""
        return np.minimum(4, np.log2(self.counts + 1.0).astype("i8") // 4)


def spans(ends: np.ndarray, most: int = SPAN) -> list[tuple[int, int]]:
    """Ranges of texts with about `most` words each."""
    if not len(ends):
        return []
    cut = np.unique((np.searchsorted(ends, np.arange(most, int(ends[-1]) + most, most)) + 1).clip(max=len(ends)))
    return list(zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True))


class Trail:
    """Whole texts side by side: word numbers (flat) and where texts begin. For each bit, where it is asked, its outcome and the
    states of its contexts, which only look back within the text. own: the texts are part of what `known` counts."""

    def __init__(self, flat: np.ndarray, begins: np.ndarray, known: Known, own: bool = False):
        n, flat = len(flat), flat.astype("i8")
        sizes = np.diff(np.append(begins, n))
        self.n, self.begins, self.first = n, begins, np.repeat(begins, sizes)
        self.place = np.arange(n) - self.first
        width = np.uint64(int(flat.max(initial=0)) + 1)
        key = np.repeat(np.arange(len(begins), dtype="u8"), sizes) * width + flat.astype("u8")
        self.order, self.run = self._grouped(key)  # by word within a text
        earlier = self._before(self.order, self.run)
        self.times = np.empty(n, "i8")
        self.times[self.order] = np.arange(n) - self.run
        inner, second = self.place >= 1, self.place >= 2
        self.far = [inner, second, self.place >= 3]
        # Where the same word, or the same two words, came before: the place of what followed.
        after = np.full(n, -1)
        after[1:] = np.where(inner[1:] & (earlier[:-1] >= 0), earlier[:-1] + 1, -1)
        self.rank, self.group = np.empty(n, "i8"), np.empty(n, "i8")
        self.rank[self.order], self.group[self.order] = np.arange(n), self.run  # the word within its text
        two = np.zeros(n, "u8")
        two[2:] = self.group[1:-1].astype("u8") * width + flat[:-2].astype("u8")
        at = np.flatnonzero(second)
        pair = np.full(n, -1)
        pair[at] = self._before(*self._grouped(two[at]), at)
        before = np.zeros(n, "i8")
        before[1:] = flat[:-1]
        # asked and hit, in turn: a bit is asked where its candidate is there, new, and no bit before it was right
        a = np.where(pair >= 0, flat[pair], -1)
        hit_a = a == flat
        b = np.where(after >= 0, flat[after], -1)
        hit_b = b == flat
        best = known.best[before]
        right = inner & (best == known.hashes[flat])
        often = np.where(inner, known.often[before], 0)
        if own:
            often = often - self._totals(right)
        told = (often > 0) & ~((a >= 0) & (known.hashes[a] == best)) & ~((b >= 0) & (known.hashes[b] == best))
        hit_c = told & right
        asked = [pair >= 0, (after >= 0) & (b != a) & ~hit_a, told & ~hit_a & ~hit_b, inner & ~hit_a & ~hit_b & ~hit_c]
        self.asked, self.hit = asked, [x & y for x, y in zip(asked, (hit_a, hit_b, hit_c, self.times > 0), strict=True)]
        self.known, self.before, self.often, self.candidates = known, before, often, ((a, pair), (b, after))

    def told(self, j: int, at: np.ndarray) -> np.ndarray:
        """What training, or the distance, says of bit j's candidate at some places where it is asked."""
        if j < 2:
            word, where = (x[at] for x in self.candidates[j])
            return self.known.levels[word] * 3 + np.searchsorted([8, 64], at - where, side="right")
        if j == 2:
            often = self.often[at]
            spread = np.minimum(4, np.log2(np.maximum(1, self.known.counts[self.before[at]]) / often).astype("i8").clip(0))
            return (np.minimum(often, 3) - 1) * 5 + spread
        return np.minimum(15, np.frexp(self.place[at])[1] - 1).astype("i8")

    @staticmethod
    def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stable order of equal keys, and in that order where each one's group begins."""
        shift = np.uint64(len(key).bit_length())
        if int(key.max(initial=0)).bit_length() + int(shift) <= 64:  # sorted with their places in the low bits
            packed = np.sort(key << shift | np.arange(len(key), dtype="u8"))
            order, ranked = (packed & ((np.uint64(1) << shift) - np.uint64(1))).astype("i8"), packed >> shift
        else:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        return order, np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0)) if len(key) else np.zeros(0, "i8")

    @staticmethod
    def _before(order: np.ndarray, run: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """For each one the place of the last of its group before it, or -1."""
        out = np.full(len(order), -1)
        again = np.flatnonzero(run < np.arange(len(order)))
        places = order if at is None else at[order]
        out[order[again]] = places[again - 1]
        return out

    def _totals(self, x: np.ndarray) -> np.ndarray:
        """By place, how often x holds after the same word in the whole text."""
        follows = np.zeros(self.n, bool)
        follows[:-1] = x[1:] & (self.place[1:] >= 1)
        ids = np.cumsum(np.concatenate([[True], self.run[1:] != self.run[:-1]])) - 1 if self.n else np.zeros(0, "i8")
        sums = np.bincount(ids, follows[self.order])[ids] if self.n else np.zeros(0)
        by = np.empty(self.n, "i8")
        by[self.order] = sums
        out = np.zeros(self.n, "i8")
        out[1:] = np.where(self.place[1:] >= 1, by[:-1], 0)
        return out

    @staticmethod
    def _both(asked: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each was so before each place, in the low and the high half of a number, and what each place adds."""
        x = hit.astype("i8") << 32
        x += asked
        return np.cumsum(x) - x, x

    def states(self, j: int) -> tuple[np.ndarray, ...]:
        """The four contexts' states of bit j where it is asked, the evidence for the word before, 0 to 3, and those places. No bit is
        asked of a text's first word."""
        asked, hit = self.asked[j], self.hit[j]
        at = np.flatnonzero(asked)
        last = np.zeros(self.n, "u1")
        for k in (1, 2, 3):
            last[k:] |= (hit[:-k] & self.far[k - 1][k:]).view("u1") << np.uint8(k - 1)
        so_far, x = self._both(asked, hit)
        follows = np.zeros(self.n, "i8")
        follows[:-1] = x[1:]
        after = np.cumsum(follows := follows[self.order]) - follows
        both = after[self.rank[at - 1]] - after[self.group[at - 1]]
        n, yes = both & 0xFFFFFFFF, both >> 32
        some = np.minimum(n, 3)
        word = np.where(n == 0, 0, 1 + (some - 1) * 3 + np.where(yes == 0, 0, np.where(yes == n, 2, 1)))
        both = so_far[at] - so_far[self.first[at]]
        n, yes = both & 0xFFFFFFFF, both >> 32
        whole = np.where(n == 0, 0, 1 + 7 * (n >= 8) + (6 * yes / np.maximum(1, n)).astype("i8"))
        return last[at].astype("i8"), word, self.told(j, at), whole, some, at

    def cells(self, j: int) -> np.ndarray:
        """(2 x CELLS) how often bit j was asked, and was right, by the states of its contexts."""
        last, word, told, whole, _, at = self.states(j)
        cell = ((last * 10 + word) * 16 + told) * 16 + whole
        return np.stack([np.bincount(cell, minlength=CELLS), np.bincount(cell[self.hit[j][at]], minlength=CELLS)])

    def chances(self, j: int, model: Chances) -> np.ndarray:
        """The probability that bit j is right, 0 where it isn't asked."""
        *states, evidence, at = self.states(j)
        z = model.weights[j, :, 4][evidence]
        for k, x in enumerate(states):
            z += (model.weights[j, :, k, None] * model.odds[j][k]).ravel()[evidence * STATES[k] + x]
        p, bucket = 1 / (1 + np.exp(-np.clip(z, -9, 9))), sum((z > e).view("u1") for e in EDGES)
        hit, begin = self.hit[j][at], (np.cumsum(self.asked[j]) - self.asked[j])[self.first[at]]
        both = np.empty(len(at), "i8")
        for k in range(len(EDGES) + 1):
            own = bucket == k
            c, _ = self._both(own, own & hit)
            own = np.flatnonzero(own)
            both[own] = c[own] - c[begin[own]]
        out = np.zeros(self.n)
        out[at] = (KEEP * p + (both >> 32)) / (KEEP + (both & 0xFFFFFFFF))
        return out

    def log2(self, literal: np.ndarray, model: Chances) -> np.ndarray:
        """log2 of each token's probability; literal: of the word by itself. A candidate that is right takes its bit's chance, and
        all others share the rest; at the end the words so far are mixed with the literal word."""
        pair, after, following, again = (self.chances(j, model) for j in range(4))
        deep = np.maximum(literal, -900)
        x = again * self.times / np.maximum(1, self.place) + (1 - again) * np.exp2(deep)
        for chance, hit in ((following, self.hit[2]), (after, self.hit[1]), (pair, self.hit[0])):
            x = np.where(hit, chance, (1 - chance) * x)
        found = self.hit[0] | self.hit[1] | self.hit[2]
        return np.log2(x) + np.where((literal < -900) & ~found, literal + 900, 0)


@dataclass
class Chances:
    """Log odds by bit, context and state, and weights (bit x evidence x contexts and one)."""

    odds: list[list[np.ndarray]]
    weights: np.ndarray


def learn_chances(total: np.ndarray) -> Chances:
    """From counts (2 x bits x CELLS) of all training texts: each state's log odds, and the weights of the least logistic loss, by
    Newton steps over the cells."""
    odds, weights = [], np.full((len(BITS), EVIDENCE, 5), 0.3)
    weights[:, :, 4] = 0
    cells = np.stack(np.unravel_index(np.arange(CELLS), STATES))
    for j in range(len(BITS)):
        n, yes = (x[j].astype("f8") for x in total)
        own = [np.log((np.bincount(c, yes, s) + 0.4) / (np.bincount(c, n - yes, s) + 1.2)) for c, s in zip(cells, STATES, strict=True)]
        odds.append(own)
        evidence = np.where(cells[1] == 0, 0, 1 + (cells[1] - 1) // 3)
        for e in range(EVIDENCE):
            use = np.flatnonzero((n > 0) & (evidence == e))
            if not len(use):
                continue
            x = np.stack([*(own[k][cells[k][use]] for k in range(4)), np.ones(len(use))], 1)
            w = weights[j, e].copy()
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -9, 9)))
                slope = x.T @ (yes[use] - n[use] * p) - (w - weights[j, e])
                bend = (x * (n[use] * p * (1 - p))[:, None]).T @ x + np.eye(5)
                step = np.clip(np.linalg.solve(bend, slope), -1, 1)
                w = w + step
                if np.abs(step).max() < 1e-6:
                    break
            weights[j, e] = w
    return Chances(odds, weights)


def known_words(log2: np.ndarray, buf: np.ndarray, starts: np.ndarray, n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log2 of the rest of each word after its first two bytes, mixed of its spelling and its share (n) of the training words
    that begin alike; new words are expected as often as distinct words were met among those (Witten and Bell). whole: both, by code."""
    places, kinds = whole[:, head_codes(buf, starts)]
    trust = places / (places + kinds)
    mixed = np.log2(trust * n / np.maximum(1, places) + (1 - trust) * np.exp2(np.maximum(log2, -900))) + np.where(log2 < -900, log2 + 900, 0)
    return np.where(np.diff(starts) > 2, mixed, log2)


def listed(buf: np.ndarray) -> list[bytes]:
    """The words of spelled bytes."""
    return buf[:-1].tobytes().split(b" ") if len(buf) else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words, repeat(7)), "u4", len(words))


def long_hashes(words: list[bytes]) -> np.ndarray:
    """40 bits of a hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), "u8", len(words)) >> np.uint64(24)


def successors(flat: np.ndarray, begins: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of neighbours, the second in the places `use`, and how often each pair occurs."""
    inner = use.copy()
    inner[begins] = False
    at = np.flatnonzero(inner)
    pair, n = np.unique(flat[at - 1].astype("u8") << np.uint64(32) | flat[at], return_counts=True)
    return (pair >> np.uint64(32)).astype("i8"), (pair & np.uint64(0xFFFFFFFF)).astype("i8"), n


def together(words: np.ndarray, after: np.ndarray) -> np.ndarray:
    """An order by word (of 40 bits) in which equal pairs are neighbours: by one key, whose few ties between pairs are put right."""
    key = words << np.uint64(24) | (after & np.uint32(0xFFFFFF)).astype("u8")
    order = np.argsort(key)
    key = key[order]
    tie = np.flatnonzero((key[1:] == key[:-1]) & (after[order[1:]] != after[order[:-1]]))
    if len(tie):
        at = np.flatnonzero(np.isin(key, key[tie]))
        order[at] = order[at][np.lexsort((after[order[at]], key[at]))]
    return order


def most_frequent(words: np.ndarray, after: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word once, with the successor of the largest n (of equal ones the smallest) and that n."""
    if not len(words):
        return words, after, n
    order = np.argsort(words)
    words, after, n = words[order], after[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    most = np.maximum.reduceat(n, first)
    least = np.where(n == np.repeat(most, np.diff(np.append(first, len(n)))), after, np.iinfo(after.dtype).max)
    return words[first], np.minimum.reduceat(least, first), most


def pack_ids(x: np.ndarray) -> bytes:
    """Word numbers by halves, the low ones first: numbers of frequent words are small."""
    x = x.astype("<u4").view("<u2").reshape(-1, 2)
    return squeeze(x[:, 0].tobytes() + x[:, 1].tobytes())


def unpack_ids(data: bytes) -> np.ndarray:
    x = np.frombuffer(unsqueeze(data), "<u2").reshape(2, -1)
    return x[0].astype("u4") | x[1].astype("u4") << np.uint32(16)


def pack_rising(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=0).astype("<i4").tobytes())


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unsqueeze(data), "<i4"))


def pack_planes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of rising numbers' differences, all lowest bytes first."""
    return squeeze(np.diff(x.astype("<u8"), prepend=np.uint64(0)).view("u1").reshape(-1, 8)[:, :size].T.tobytes())


def unpack_planes(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), "u1").reshape(size, -1)
    x = np.zeros((planes.shape[1], 8), "u1")
    x[:, :size] = planes.T
    return np.cumsum(x.view("<u8").ravel(), dtype="u8")


BLOCKS = "block string, size int, docs array<long>, held array<boolean>, ends array<long>, ids binary, words binary, seen binary, heads array<binary>, head_classes array<int>, head_counts array<long>"


def blocks_of(df: DataFrame, learns: Column, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, text) in blocks: documents, where their words end, word numbers (0 is the end of a text), the spelled dictionary,
    training counts by word, and training counts by class and first two bytes."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), count()
        docs, held, texts, size = [], [], [], 0

        def flush():
            words = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.concat_arrays(texts)))
            found = words.flatten().dictionary_encode()
            number, none = found.indices.to_numpy(), pa.compute.index(found.dictionary, "").as_py()
            real = number != none  # space at either end of a text splits off an empty string
            sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[words.offsets.to_numpy()]) + 1
            ends = np.cumsum(sizes)
            flat, word = np.zeros(ends[-1], "u4"), np.ones(ends[-1], bool)
            word[ends - 1] = False
            flat[word] = number[real] + 1
            order = np.argsort(-np.bincount(flat, minlength=len(found.dictionary) + 1)[1:], kind="stable")  # frequent words get small numbers
            order = order[order != none]
            rank = np.zeros(len(found.dictionary) + 1, "u4")
            rank[1 + order] = np.arange(1, len(order) + 1, dtype="u4")
            flat = rank[flat]
            letters, offsets = arrow_bytes(found.dictionary.take(pa.array(order)))
            starts = np.concatenate([[0], offsets + np.arange(1, len(offsets) + 1)])
            buf, letter = np.full(starts[-1], 32, "u1"), np.ones(starts[-1], bool)
            letter[starts[1:] - 1] = False
            buf[letter] = letters
            learned = np.repeat(~np.array(held, bool), sizes)
            seen = np.bincount(flat[learned], minlength=len(starts) - 1).astype("<i4")
            names, head = np.unique(head_codes(buf, starts), return_inverse=True)
            before = np.concatenate([[0], flat[:-1]])  # the end of the last text stands for none
            pair = class_of(buf, starts)[before] * len(names) + head[flat]
            at = np.flatnonzero(np.bincount(pair, minlength=1))
            n = np.bincount(pair[learned], minlength=int(at[-1]) + 1)[at]
            del pair
            return pa.RecordBatch.from_pylist([{
                "block": f"{part:06d}-{next(made):04d}", "docs": docs, "size": len(starts) - 1, "held": held, "ends": ends.tolist(), "ids": pack_ids(flat),
                "words": squeeze(buf.tobytes()), "seen": seen.tobytes(), "heads": [head_of(x) for x in names[at % len(names)].tolist()], "head_classes": (at // len(names)).tolist(), "head_counts": n.tolist(),
            }], schema=schema)

        for b in rows_of(batches, "text"):
            text = pa.compute.fill_null(b.column(2).cast(pa.string()), "")
            lo = 0
            for hi, n in enumerate(pa.compute.binary_length(text).to_pylist(), 1):
                size += n + 64
                if size >= block_bytes or hi == b.num_rows:
                    docs, held = docs + b.column(0)[lo:hi].to_pylist(), held + b.column(1)[lo:hi].to_pylist()
                    texts.append(text[lo:hi])
                    lo = hi
                if size >= block_bytes:
                    yield flush()
                    docs, held, texts, size = [], [], [], 0
                    tidy()
                    pa.default_memory_pool().release_unused()
        if docs:
            yield flush()
        texts.clear()
        tidy()
        pa.default_memory_pool().release_unused()

    lists = {"docs": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "size": pa.int32(), "ends": pa.list_(pa.int64()), "heads": pa.list_(pa.binary()), "head_classes": pa.list_(pa.int32()), "head_counts": pa.list_(pa.int64())}
    schema = pa.schema([(n, lists.get(n, pa.string() if n == "block" else pa.binary())) for n in (c.split()[0] for c in BLOCKS.split(", "))])
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), (~learns).alias("held"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def count_tables(vocabulary: DataFrame, parts: int) -> np.ndarray:
    """Packed counts (2 x slots) over the training words of buckets (words, n), without the heads: summed in chunks."""

    def partial(batches):
        total = None
        for b in batches:
            for words, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total = np.zeros((2, STARTS[-1]), "f4") if total is None else total
                words, n = words.split(b" "), np.frombuffer(n, "<i8")
                use = [i for i in np.flatnonzero(n).tolist() if len(words[i]) > 1]
                tally([words[i] for i in use], n[use], total)
        if total is not None:
            for k, lo in enumerate(range(0, total.shape[1], CHUNK)):
                part = total[:, lo : lo + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "n"])

    def whole(key, t):
        total = sum(np.frombuffer(x.as_py(), "f4") for x in t["n"])
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([pack_counts(total).tobytes()], pa.binary())})

    got = vocabulary.repartition(parts).mapInArrow(partial, "chunk int, n binary").groupBy("chunk").applyInArrow(whole, "chunk int, n binary").toArrow()
    out = np.zeros((2, STARTS[-1]), "u1")
    for k, n in zip(got["chunk"].to_pylist(), got["n"].to_pylist(), strict=True):
        part = np.frombuffer(n, "u1").reshape(2, -1)
        out[:, k * CHUNK : k * CHUNK + part.shape[1]] = part
    return out


ROUTED = "bucket int, block string, words binary, no binary, seen binary, next binary, next_n binary"
#: Pairs of neighbours by bucket of the pair: 40 bits of the first word's long hash, the second's short one, and their count.
PAIRS = "bucket int, words binary, next binary, next_n binary"
WORDS = "bucket int, words binary, n binary, next binary, next_n binary, blocks array<string>, at_word binary, at_block binary, at_no binary"
_KINDS = {"bucket": pa.int32(), "block": pa.string(), "blocks": pa.list_(pa.string()), "chunk": pa.int32(), "docs": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "ends": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS.get(n, pa.binary())) for n in (c.split()[0] for c in schema.split(", "))])


def best_successors(blocks: DataFrame, buckets: int) -> DataFrame:
    """Rows of ROUTED without a block: words' long hashes and most frequent successors, by bucket of words. Counts of pairs
    are summed over all blocks by bucket of the pair, so that a frequent word's pairs are spread; of those sums each pair
    bucket sends a word's largest, the largest of which is the word's."""
    spread = 4 * buckets

    def route(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                words, flat, ends = listed(spelled(unsqueeze(r["words"]))[0]), unpack_ids(r["ids"]), np.array(r["ends"], "i8")
                begins = np.concatenate([[0], ends[:-1]])
                before, after, n = successors(flat, begins, np.repeat(~np.array(r["held"], bool), ends - begins))
                word, after = long_hashes(words)[before], word_hashes(words)[after]
                bucket = ((word ^ after * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)) % np.uint64(spread)
                order = np.argsort(bucket << np.uint64(40) | word)
                word, after, n = word[order], after[order], n[order].astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket.astype("i8"), minlength=spread))]).tolist()
                rows = [{"bucket": k, "words": pack_planes(word[x:z], 5), "next": squeeze(after[x:z].view("u1").reshape(-1, 4).T.tobytes()), "next_n": squeeze(n[x:z].view("u1").reshape(-1, 4).T.tobytes())} for k, (x, z) in enumerate(pairwise(cuts)) if x < z]
                del flat, before, word, after, n, bucket, order
                for k in range(0, len(rows), SENT):
                    yield pa.RecordBatch.from_pylist(rows[k : k + SENT], schema=_arrow(PAIRS))
        tidy()

    def total(key, t):
        word = np.concatenate([unpack_planes(x.as_py(), 5) for x in t["words"]])
        after, n = (np.concatenate([np.frombuffer(unsqueeze(x.as_py()), "u1").reshape(4, -1).T.copy().view("<u4").ravel() for x in t[c]]) for c in ("next", "next_n"))
        n = n.astype("<i8")
        order = together(word, after)
        word, after, n = word[order], after[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (after[1:] != after[:-1])]))
        word, after, n = most_frequent(word[first], after[first], np.add.reduceat(n, first))
        bucket = word % np.uint64(buckets)  # as in count_words
        rows = [{"bucket": k, "block": None, "words": squeeze(word[at].tobytes()), "next": squeeze(after[at].tobytes()), "next_n": squeeze(n[at].tobytes())} for k in range(buckets) if len(at := np.flatnonzero(bucket == k))]
        return pa.Table.from_pylist(rows, schema=_arrow(ROUTED))

    return blocks.select("words", "ids", "ends", "held").mapInArrow(route, PAIRS).groupBy("bucket").applyInArrow(total, ROUTED)


def count_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks' dictionaries merged, a row for each bucket of words: the words, their training counts, most frequent
    successors, and where each stands in the blocks' dictionaries. Words travel packed by block and bucket."""

    def route(batches):
        schema = _arrow(ROUTED)
        for b in batches:
            for block, words, seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                buf, starts = spelled(unsqueeze(words))
                bucket = (long_hashes(listed(buf)) % np.uint64(buckets)).astype("i8")
                order = np.argsort(bucket, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))]).tolist()
                (buf, starts), seen = respelled(buf, starts, order), np.frombuffer(seen, "<i4")[order]
                rows = [{"bucket": k, "block": block, "words": squeeze(buf[starts[x] : starts[z]].tobytes()), "no": pack_rising(order[x:z]), "seen": squeeze(seen[x:z].tobytes())} for k, (x, z) in enumerate(pairwise(cuts)) if x < z]
                for k in range(0, len(rows), SENT):
                    yield pa.RecordBatch.from_pylist(rows[k : k + SENT], schema=schema)
        tidy()

    def merge(key, t):
        words, blocks, no, seen, winners = [], [], [], [], []
        for r in t.to_pylist():
            if r["block"] is None:
                winners.append([np.frombuffer(unsqueeze(r[c]), kind) for c, kind in (("words", "<u8"), ("next", "<u4"), ("next_n", "<i8"))])
                continue
            words.append(unsqueeze(r["words"]))
            blocks.append(r["block"])
            no.append(unpack_rising(r["no"]))
            seen.append(np.frombuffer(unsqueeze(r["seen"]), "<i4"))
        found = as_arrow(*spelled(b"".join(words))).dictionary_encode()
        at, which = found.indices.to_numpy(), np.repeat(np.arange(len(blocks), dtype="<i4"), [len(x) for x in no])
        no, seen = map(np.concatenate, (no, seen))
        buf, starts = arrow_bytes(found.dictionary)
        n = np.bincount(at, seen, len(starts) - 1).astype("<i8")
        best, often = np.zeros(len(n), "<u4"), np.zeros(len(n), "<i8")
        if winners:
            word, after, times = most_frequent(*map(np.concatenate, zip(*winners, strict=True)))
            own = long_hashes(listed(buf))
            found = np.minimum(np.searchsorted(word, own), len(word) - 1)
            met = word[found] == own
            best[met], often[met] = after[found[met]], times[found[met]]
        row = {"bucket": key[0].as_py(), "words": buf[:-1].tobytes(), "n": n.tobytes(), "next": best.tobytes(), "next_n": often.tobytes(), "blocks": blocks, "at_word": squeeze(at.tobytes()), "at_block": squeeze(which.tobytes()), "at_no": pack_rising(no)}
        return pa.Table.from_pylist([row], schema=_arrow(WORDS))

    return blocks.select("block", "words", "seen").mapInArrow(route, ROUTED).union(best_successors(blocks, buckets)).groupBy("bucket").applyInArrow(merge, WORDS)


#: A block with what is known of its words; and, without documents, what a bucket of words knows of the block's.
READY = "block string, docs array<long>, held array<boolean>, ends array<long>, ids binary, words binary, no binary, counts binary, best binary, often binary, rest binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def learn_mixer(words: DataFrame, counts: np.ndarray) -> Mixer:
    """Weights and refinement from all training words of the buckets: each bucket takes online steps over its words from one
    start, and what they come to is averaged by the numbers of words, in Spark."""
    sent = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for b in batches:
            for text, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, n = text.split(b" "), np.frombuffer(n, "<i8")
                at = [i for i in np.flatnonzero(n).tolist() if len(own[i]) > 1]
                m = new_mixer(sent.value)
                for lo in range(0, len(at), 20_000):
                    part = at[lo : lo + 20_000]
                    m.learn([own[i] for i in part], n[part].astype("f8"), None, 8192)
                flat = np.concatenate([m.weights.ravel(), m.refined.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype="i4")), pa.array(flat * len(at)), pa.array(np.full(len(flat), len(at), "i8"))], names=["at", "x", "n"])

    m = new_mixer(counts)
    got = words.select("words", "n").mapInArrow(run, "at int, x double, n long").groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).filter("n > 0").toArrow()  # a row a weight
    flat = np.concatenate([m.weights.ravel(), m.refined.ravel()])
    flat[got["at"].to_numpy()] = got["x"].to_numpy() / got["n"].to_numpy()
    m.weights, m.refined = flat[: m.weights.size].reshape(m.weights.shape), flat[m.weights.size :].reshape(m.refined.shape)
    return m


def score_documents(df: DataFrame, learns: Column, block_bytes: int = BLOCK) -> DataFrame:
    """Learns from the documents (doc_id, text) that `learns` (never null) accepts, and scores all: doc_id, held_out, n_tokens (words and
    one end), n_known (tokens that training texts have), train_tokens, base_score (log10 by smoothed token counts), score
    (log10 by the mixed bit predictors) and bits_per_byte (of the words with a space after each, and the end).

    A null text counts as empty: it has the end alone. Rows may repeat; an empty table gives an empty result."""
    spark = df.sparkSession
    blocks, blocks_at = materialize(blocks_of(df, learns, block_bytes), "blocks")

    size = blocks.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]
    words, words_at = materialize(count_words(blocks, max(1, -(-size // BUCKET))), "words")
    release(spark)

    def summed(batches):
        for b in batches:
            for text, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = np.frombuffer(n, "<i8")
                codes = head_codes(*spelled(text + b" "))
                words, kinds = np.bincount(codes, n, 1 << 16).astype("i8"), np.bincount(codes[n > 0], minlength=1 << 16)
                at = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays([pa.array([head_of(x) for x in at.tolist()], pa.binary()), pa.array(words[at]), pa.array(kinds[at])], names=["word", "n", "words"])

    # Training words by first two bytes: at most 65536 rows, and one for each single byte and the end.
    starts = words.select("words", "n").mapInArrow(summed, "word binary, n long, words long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
    whole = {bytes(r["word"]): (r["n"], r["words"]) for r in starts}
    by_code = np.zeros((2, 1 << 16))
    by_code[1] = 1
    for w, x in whole.items():
        by_code[:, code_of(w)] = x
    tokens, distinct = sum(x[0] for x in whole.values()), sum(x[1] for x in whole.values())

    counts = count_tables(words.select("words", "n"), max(2, -(-distinct // PARTIAL)))
    heads = blocks.select(F.explode(F.arrays_zip("heads", "head_classes", "head_counts")).alias("h")).select("h.*").groupBy("heads", "head_classes").agg(F.sum("head_counts").alias("n")).orderBy("heads", "head_classes").toArrow()  # at most CLASSES x 65536 rows
    head_words, head_classes, head_n = heads["heads"].to_pylist(), heads["head_classes"].to_numpy(), heads["n"].to_numpy()
    head_words = [w.rstrip(b" ") for w in head_words]
    own = np.zeros((2, STARTS[-1]), "f4")
    met = np.flatnonzero(head_n)
    tally([head_words[i] for i in met.tolist()], head_n[met], own, head_classes[met])
    touched = own > 0
    counts[touched] = pack_counts(own[touched] + UNPACKED[counts[touched]])
    del own, touched

    mixer = learn_mixer(words, counts)
    if len(met):
        met = met[np.random.default_rng(5).permutation(len(met))]
        mixer.learn([head_words[i] for i in met], head_n[met].astype("f8"), head_classes[met], 2048)
    codes = np.array([code_of(w) for w in head_words], "i8")
    found, at = np.unique(codes, return_inverse=True)
    prefixes = np.full(1 << 16, -1)
    prefixes[found] = np.arange(len(found))
    first = np.zeros((CLASSES, max(1, len(found))), "f4")
    first[head_classes, at] = mixer.log2(*spell(head_words), head_classes)
    sent_words = spark.sparkContext.broadcast((mixer, by_code))  # two bytes a slot, whatever the input

    def scored(batches):
        m, whole = sent_words.value
        schema = _arrow(READY)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                own, n, best, often = spelled(r["words"] + b" "), np.frombuffer(r["n"], "<i8"), np.frombuffer(r["next"], "<u4"), np.frombuffer(r["next_n"], "<i8")
                rest = known_words(m.log2(*own), *own, n, whole).astype("<f4")
                word, block = (np.frombuffer(unsqueeze(r[c]), "<i4") for c in ("at_word", "at_block"))
                no = unpack_rising(r["at_no"])
                cuts = np.flatnonzero(np.diff(block)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                    w = word[lo:hi]
                    yield pa.RecordBatch.from_pylist([{"block": r["blocks"][block[lo]], "no": pack_rising(no[lo:hi]), "counts": squeeze(n[w].tobytes()), "best": best[w].tobytes(), "often": squeeze(often[w].tobytes()), "rest": rest[w].tobytes()}], schema=schema)

    def gather(key, t):
        row = t.filter(pa.compute.is_valid(t["ids"])).to_pylist()[0]
        rows = t.filter(pa.compute.is_null(t["ids"])).drop_columns(["docs", "held", "ends", "ids", "words"]).to_pylist()
        no = np.concatenate([unpack_rising(r["no"]) for r in rows])
        for c, kind in (("counts", "<i8"), ("best", "<u4"), ("often", "<i8"), ("rest", "<f4")):
            x = np.zeros(len(no), kind)
            x[no] = np.concatenate([np.frombuffer(unsqueeze(r[c]) if c in ("counts", "often") else r[c], kind) for r in rows])
            row[c] = squeeze(x.tobytes()) if c in ("counts", "often") else x.tobytes()
        return pa.Table.from_pylist([row], schema=_arrow(READY))

    empty = {c.split()[0]: c.split()[1] for c in READY.split(", ") if c.split()[0] in ("no", "counts", "best", "often", "rest")}
    bare = blocks.select("block", "docs", "held", "ends", "ids", "words", *(F.lit(None).cast(k).alias(c) for c, k in empty.items()))
    ready, _ = materialize(bare.unionByName(words.mapInArrow(scored, READY)).groupBy("block").applyInArrow(gather, READY), "ready")
    discard(spark, words_at, blocks_at)
    release(spark)

    def followed(r: dict):
        words = spelled(unsqueeze(r["words"]))
        flat, ends = unpack_ids(r["ids"]), np.array(r["ends"], "i8")
        return words, flat, ends, np.concatenate([[0], ends[:-1]]), Known(word_hashes(listed(words[0])), np.frombuffer(unsqueeze(r["counts"]), "<i8"), np.frombuffer(r["best"], "<u4"), np.frombuffer(unsqueeze(r["often"]), "<i8"))

    def counted(batches):
        total = np.zeros((2, len(BITS), CELLS), "i8")
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                _, flat, ends, begins, known = followed(r)
                learned = ~np.array(r["held"], bool)
                flat, sizes = flat[np.repeat(learned, ends - begins)], (ends - begins)[learned]
                ends = np.cumsum(sizes)
                for lo, hi in spans(ends):
                    a, z = int(ends[lo - 1]) if lo else 0, int(ends[hi - 1])
                    trail = Trail(flat[a:z], np.concatenate([[0], ends[lo : hi - 1] - a]), known, True)
                    for j in range(len(BITS)):
                        total[:, j] += trail.cells(j)
        at = np.flatnonzero(total[0].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[0].ravel()[at]), pa.array(total[1].ravel()[at])], names=["cell", "n", "yes"])

    total = np.zeros((2, len(BITS) * CELLS), "i8")
    got = ready.select("held", "ends", "ids", "words", "counts", "best", "often").mapInArrow(counted, "cell int, n long, yes long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")).toArrow()  # a row a cell
    total[:, got["cell"].to_numpy()] = got["n"].to_numpy(), got["yes"].to_numpy()
    sent = spark.sparkContext.broadcast((first, prefixes, learn_chances(total.reshape(2, len(BITS), CELLS))))  # CLASSES x 65536 floats at most

    def run(batches):
        first, prefixes, chances = sent.value
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                words, flat, ends, begins, known = followed(r)
                rest, n = np.frombuffer(r["rest"], "<f4"), known.counts
                base = np.log10((n + 0.1) / (tokens + 0.1 * (distinct + 1)))
                head, cls, length = prefixes[head_codes(*words)], class_of(*words), np.diff(words[1])
                bits = np.empty(len(ends))
                for lo, hi in spans(ends):
                    a, z = begins[lo], ends[hi - 1]
                    part = flat[a:z]
                    before = np.concatenate([[0], part[:-1]])
                    literal = first[cls[before], head[part]].astype("f8") + rest[part]
                    bits[lo:hi] = np.add.reduceat(Trail(part, begins[lo:hi] - a, known).log2(literal, chances), begins[lo:hi] - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["docs"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(ends - begins), pa.array(np.add.reduceat((n > 0)[flat].astype("i8"), begins)), pa.array(np.full(len(ends), tokens, "i8")),
                     pa.array(np.add.reduceat(base[flat], begins)), pa.array(bits * np.log10(2)), pa.array(-bits / np.add.reduceat(length[flat], begins))],
                    names=[c.split()[0] for c in SCORES.split(", ")],
                )

    release(spark)
    return ready.mapInArrow(run, SCORES)

"""op9's steps at size: what they cost beside plain numpy work on as many words, and that their shortcuts are exact."""

import collections
import itertools
import time

import numpy as np
from pyspark.sql import functions as F

from tickforge.llm import lm
from tickforge.llm.common import unsqueeze


def least(f):
    """The least CPU seconds of five calls."""
    out = []
    for _ in range(5):
        t = time.thread_time()
        f()
        out.append(time.thread_time() - t)
    return min(out)


def test_following_texts_costs_few_sorts():
    # 600,000 words of 1,200 texts; a stable argsort of their numbers is the unit: 19 units before, 7 since.
    rng = np.random.default_rng(1)
    kinds, n = 50_000, 600_000
    flat = np.minimum(rng.zipf(1.3, n), kinds - 1).astype("u4")
    ends = np.arange(500, n + 1, 500)
    hashes = rng.integers(0, 1 << 32, kinds, dtype="u8").astype("u4")
    known = lm.Known(hashes, rng.integers(0, 3000, kinds), hashes[rng.integers(0, 50, kinds)], rng.integers(0, 9, kinds))
    model = lm.Chances([[rng.normal(0, 1, s) for s in lm.STATES] for _ in lm.BITS], rng.normal(0.3, 0.2, (4, lm.EVIDENCE, 5)))
    literal = rng.uniform(-12, -2, n)

    def follow():
        for lo, hi in lm.spans(ends):
            a, z = int(ends[lo - 1]) if lo else 0, int(ends[hi - 1])
            lm.Trail(flat[a:z], np.concatenate([[0], ends[lo : hi - 1] - a]), known).log2(literal[a:z], model)

    key = flat.astype("u8")
    unit = least(lambda: np.argsort(key, kind="stable"))
    assert least(follow) < 12 * unit


def test_blocks_split_texts_as_python_does(spark):
    texts = [" Lead and TAIL \r\n", "", None, "\x1cone\x1f two\xa0three four\x85", "a\tb\x0bc\x0cd\re\nf  a", "Ä ä Z z \x00 \x00\x00 x\x00", " ", "x" * 3000 + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (100, 1 << 20):
        got = {}
        for r in lm.blocks_of(docs.repartition(1), F.lit(True), size).collect():
            buf, starts = lm.spelled(unsqueeze(bytes(r["words"])))
            words, flat = lm.listed(buf), lm.unpack_ids(bytes(r["ids"])).tolist()
            assert len(words) == r["size"] == len(set(words)) == len(starts) - 1 and words[0] == b""
            assert np.frombuffer(r["seen"], "<i4").tolist() == np.bincount(flat, minlength=len(words)).tolist()
            heads = collections.Counter()
            for lo, hi, i in zip([0, *r["ends"]], r["ends"], r["docs"]):
                got[i] = [words[k] for k in flat[lo:hi]]
            for k in flat:
                heads[(words[k] + b" ")[:2]] += 1
            told = collections.Counter()
            for w, n in zip(r["heads"], r["head_counts"], strict=True):
                told[bytes(w)] += n
            assert told == heads
        assert got == {i: [*(t or "").encode().lower().split(), b""] for i, t in enumerate(texts)}


def test_equal_pairs_are_neighbours_and_ties_go_to_the_smallest():
    rng = np.random.default_rng(4)
    word = rng.choice(np.array([0, 5, 1 << 39, (1 << 40) - 1], "u8"), 4000)
    after = (rng.integers(0, 6, 4000) << 24 | rng.integers(0, 8, 4000)).astype("u4")  # many alike in their low 24 bits
    order = lm.together(word, after)
    pairs = list(zip(word[order].tolist(), after[order].tolist()))
    assert sorted(order.tolist()) == list(range(4000)) and word[order].tolist() == sorted(word.tolist())
    assert len([k for k, _ in itertools.groupby(pairs)]) == len(set(pairs))
    n = rng.integers(1, 4, 4000)
    best = {}
    for w, a, k in zip(word.tolist(), after.tolist(), n.tolist()):
        best[w] = min(best.get(w, (0, 0)), (-k, a))
    got = lm.most_frequent(word, after, n)
    assert [(w, (-k, a)) for w, a, k in zip(*(x.tolist() for x in got))] == sorted(best.items())
    assert [len(x) for x in lm.most_frequent(word[:0], after[:0], n[:0])] == [0, 0, 0]


def test_known_words_and_classes_read_spelled_bytes():
    words = [b"", b"x", b"ab", b"abc", "été".encode(), b"x\x00", b"z" * 70]
    buf, starts = lm.spell(words)
    assert lm.listed(buf) == words and (lm.spelled(buf.tobytes())[1] == starts).all()
    assert [lm.head_of(c) for c in lm.head_codes(buf, starts).tolist()] == [(w + b" ")[:2] for w in words]
    assert [lm.code_of(w[:2]) for w in words] == [lm.code_of(lm.head_of(c)) for c in lm.head_codes(buf, starts).tolist()] == lm.head_codes(buf, starts).tolist()
    want = [((int.from_bytes(w[-3:], "big") * 0x9E3779B97F4A7C15) % (1 << 64) >> 40) % (lm.CLASSES - 1) for w in words]
    assert lm.class_of(buf, starts).tolist() == [lm.CLASSES - 1, *want[1:]]
    order = np.array([4, 0, 2, 2])
    assert lm.listed(lm.respelled(buf, starts, order)[0]) == [words[k] for k in order]

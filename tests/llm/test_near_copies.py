"""The pipeline's near_dedup stage against all pairs' similarity of five-word shingles, and rows without an own doc_id."""

import collections
import itertools
import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_roots(texts):
    sets, p = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice((3, 9, 60, 120, 300)))]
        out.append(base)
        for _ in range(rnd.randrange(5)):  # chains, so that components reach further than one link
            near = list(out[-1])
            for _ in range(max(1, rnd.randrange(len(near) // 50 + 2))):
                near[rnd.randrange(len(near))] = word()
            out.append(near)
    license_words = [word() for _ in range(60)]
    out += [[*license_words, *(word() for _ in range(k))] for k in (2, 5, 8, 14, 16, 30, 80)]
    return [" ".join(t) for t in out] + ["", " \n", " ".join(out[0]).upper()]


def test_keeps_one_of_each_component_of_similar_texts(spark, texts):
    roots = plain_roots(texts)
    assert 30 < len(set(roots)) < len(texts) - 20
    got = kept(spark, list(enumerate(texts)))
    assert sorted(i for i, _ in got) == sorted(set(roots))


def test_rows_are_told_apart_by_text_not_by_id(spark, texts):
    roots = plain_roots(texts)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    got = kept(spark, rows + rows[:20])
    place = collections.defaultdict(set)
    for r, t in zip(roots, texts, strict=True):
        place[t].add(r)
    assert sorted(r for _, t in got for r in place[t]) == sorted(set(roots))
    best = {}
    for r, (i, _) in zip(roots, rows, strict=True):
        best[r] = min(best.get(r, 1 << 62), 1 << 62 if i is None else i)
    for i, t in got:
        assert (1 << 62 if i is None else i) == best[min(place[t])]

"""Which shingles texts share, and how little of the rest takes part in near_dedup, however many texts there are."""

import random

import pytest
from pyspark.sql import functions as F

from tickforge.llm import shingles, simhash

from .test_near_copies import kept, plain_roots
from .test_near_copies import texts as texts  # noqa: PLC0414


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Many stretches and blocks of few shingles."""
    for name, x in (("STRETCH", 50), ("SORTED", 700), ("BLOCK", 9)):
        monkeypatch.setattr(shingles, name, x)
    monkeypatch.setattr(simhash, "TOGETHER", 2)


def test_texts_with_few_shingles_in_common_never_meet(spark, monkeypatch):
    """Long texts of their own with some passages of others. Counts by a table of fixed size, which many shingles fill up, took nearly
    all for shared, so the passages became keys and nearly all texts were compared as whole sets."""
    for name in ("LEAST", "MOST"):
        monkeypatch.setattr(shingles, name, 16, raising=False)  # such a table, as full as 6 GB of texts fill one of the usual size
    met, write = [], shingles.materialize

    def told(df, name):
        out = write(df, name)
        met.extend(out[0].collect() if name == "met" else [])
        return out

    monkeypatch.setattr(shingles, "materialize", told)
    rnd = random.Random(5)
    passages = [words(rnd, 8) for _ in range(100)]
    rows = [(k, " ".join(w for _ in range(20) for w in (*words(rnd, 67), *rnd.choice(passages)))) for k in range(150)]
    copy = (150, rows[0][1] + " and more")
    assert [i for i, _ in sorted(kept(spark, [*rows, copy]))] == list(range(150))
    assert {(r["u"], r["v"]) for r in met} and len(set(map(tuple, met))) == 1


def test_shared_sets_are_whole(spark, small):
    rnd = random.Random(6)
    passages = [words(rnd, 40) for _ in range(9)]
    texts = [" ".join(w for _ in range(rnd.randrange(1, 4)) for w in rnd.choice(passages)) + " " + " ".join(words(rnd, rnd.choice((0, 3, 40)))) for _ in range(60)] + ["", "one", "one two", "ONE", "\n"]
    docs = spark.createDataFrame([(10 * k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    made = simhash._shingled(docs, ("doc_id", "text"))
    rows = {r["near_row"]: r for r in made.collect()}
    assert sorted(r["text"] for r in rows.values()) == sorted(texts)
    sets, times = {}, {}
    for r in rows.values():
        sets.setdefault(r["digest"], (r["near_row"], {int(x) >> 16 for x in shingles.shingles(r["text"].encode())}))
        assert r["size"] == len(sets[r["digest"]][1])
    least = {d: min(r["near_row"] for r in rows.values() if r["digest"] == d) for d in sets}
    got = {r["near_row"]: r for r in shingles.shared_sets(made.repartition(1).sortWithinPartitions("digest", "near_row")).collect()}
    for _, s in sets.values():
        for x in s:
            times[x] = times.get(x, 0) + 1
    want = {}
    for d, (_, s) in sets.items():
        shared = sorted((x for x in s if times[x] > 1), key=lambda x: (times[x], x))
        most = len(s) // 5 + 1 - (len(s) - len(shared))
        if s and most > 0:
            want[least[d]] = (len(s), len(s) - len(shared), min(most, len(shared)), shared)
    assert 10 < len(want) < len(sets)
    assert {k: (r["size"], r["alone"], r["first"], r["h"]) for k, r in got.items()} == want
    for r in got.values():
        odd = [sum(x & 255 == k for x in r["h"]) & 1 for k in range(256)]
        assert odd == [r[f"odd{k // 64}"] >> k % 64 & 1 for k in range(256)]


def test_one_of_each_over_many_blocks(spark, small, texts):
    roots = plain_roots(texts)
    rows = list(enumerate(texts))
    again = [(1000 + k, t) for k, t in rows[:10] for _ in range(9)]  # more than lie together
    got = kept(spark, again + rows)
    assert sorted(i for i, _ in got) == sorted(set(roots))


def test_rows_of_a_digest_lie_together(spark):
    rows = [(k, f"text number {k % 50} of these") for k in range(400)]
    made = simhash._shingled(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ("doc_id", "text"))
    at = made.select("digest", F.spark_partition_id().alias("at")).distinct()
    assert made.count() == 400 and at.count() == 50

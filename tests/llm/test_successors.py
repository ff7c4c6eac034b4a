"""The successors that op9 predicts by are arg maxima of counts over all blocks."""

import collections

import numpy as np
from pyspark.sql import functions as F

from tickforge.llm import lm


def test_successors_are_counted_over_all_blocks(spark):
    # In each block one own word follows most often, over all blocks it is "second"; "often" follows 900 times, "zebra" 600.
    rows = [(k, f"first own{k} " * 3 + "first second " * 2 + "many often " * 300 + "many zebra " * (600 if k == 1 else 0)) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    blocks = lm.blocks_of(docs, F.lit(True), 400).cache()
    assert blocks.count() == 3
    pairs = collections.defaultdict(collections.Counter)
    for _, t in rows:
        w = [*t.encode().split(), b""]
        for a, b in zip(w, w[1:]):
            pairs[a][b] += 1
    met = set()
    for r in lm.count_words(blocks, 2).collect():
        best, often = np.frombuffer(r["next"], "<u4"), np.frombuffer(r["next_n"], "<i8")
        for w, h, n in zip(bytes(r["words"]).split(b" "), best.tolist(), often.tolist(), strict=True):
            met.add(w)
            top = max(pairs[w].values(), default=0)
            assert n == top
            assert not top or h in {int(lm.word_hashes([x])[0]) for x, k in pairs[w].items() if k == top}
    assert {b"first", b"many", b""} <= met
    assert max(pairs[b"first"], key=pairs[b"first"].get) == b"second"
    blocks.unpersist()

"""Source divergence, whitening and retrieval packing against plain versions."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickforge.llm import divergence, queries, retrieval, whitening

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_audit(rows, least, ranks):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = collections.Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        sources = sorted({d[1] for d in own})
        counts = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= least) for s in sources}
        whole = sum(counts.values(), collections.Counter())
        p = lambda c: [1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept]
        q = p(whole)
        for s in sources:
            mine = p(counts[s])
            pairs = [(-sum(abs(a - b) for a, b in zip(mine, p(counts[o]), strict=True)), o.encode()) for o in sources if o != s]
            terms = [(b - a, t.encode()) for t, a, b in zip(kept, mine, q, strict=True) if counts[s][t] and a > b]
            for part, got in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out.update((lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(got))
    return out


@pytest.mark.parametrize("stretch,salted,memory", [(12 << 20, 4096, 64 << 20), (40, 1, 100)])
def test_audit(spark, stretch, salted, memory):
    rnd = random.Random(5)
    vocabulary = ["the", "The", "año", "ano", "ß", "ẞ", "日本", "x1y", "a", "b", "Ünï", "zz\x7fz", "q\x00r"]
    rows = [(" ".join(rnd.choices(vocabulary, k=rnd.randrange(12))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "é", "~", None])) for _ in range(150)]
    rows += [(None, "en", "quiet"), ("", "fr", "only"), ("lonely words", "xx", "a"), (None, "xx", "b"), ("long " * 30_000, "en", "s1"), *[("the same", "de", "s2")] * 40]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    got = divergence.audit(df, 6, 4, stretch, salted, memory).collect()
    assert collections.Counter(map(tuple, got)) == plain_audit(rows, 6, 4)
    assert divergence.audit(df.filter("false")).count() == 0


def test_audit_of_many_sources(spark):
    """Sums leave a task early when its memory is full, and large counts are divided exactly."""
    rows = [(f"w{chr(97 + k % 7)} w{chr(97 + j % 5)}", "en", f"s{k:02d}") for k in range(40) for j in range(k % 4 + 1)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert collections.Counter(map(tuple, divergence.audit(df, 3, 2, pair_bytes=2000).collect())) == plain_audit(rows, 3, 2)
    big = [3, (1 << 63) // 10**9, 10**15]
    assert divergence.shares(big, 10**16, 9).tolist() == [1 + 10**9 * (c + 5) // (10**16 + 45) for c in big]


def test_audit_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.SQL["op11_divergence"])
    names = [c[0] for c in want.description]
    got = queries.op11_divergence(spark, DATA)
    assert set(got.columns) == set(names)
    assert collections.Counter(map(tuple, got.select(*names).collect())) == collections.Counter(want.fetchall())


def plain_whitening(vectors, k=32):
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(sum(c * c for c in row)) for row in n * x - s]
    z = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-e)[:k]
    return deviation, z @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def whitened(df):
    out = collections.defaultdict(dict)
    for r in df.collect():
        out[r["vec_id"]][r["component"]] = r
    return out


def same_but_sign(got, want):
    got, want = np.array(got), np.array(want)
    sign = np.sign((got * want).sum(0))
    return np.abs(got * sign - want).max() < 1e-6


def test_whitening_of_the_table(spark):
    t = [r for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    deviation, white, explained = plain_whitening([r["embedding"] for r in t])
    got = whitened(queries.op12_whitening(spark, DATA))
    assert len(got) == len(t) and all(sorted(g) == list(range(1, 33)) for g in got.values())
    assert [got[r["vec_id"]][1]["deviation"] for r in t] == deviation
    assert same_but_sign([[got[r["vec_id"]][c]["whitened"] for c in range(1, 33)] for r in t], white)
    assert np.allclose([got[t[0]["vec_id"]][c]["explained"] for c in range(1, 33)], explained, rtol=1e-9)
    assert {r["identity_error"] for g in got.values() for r in g.values()} == {got[t[0]["vec_id"]][1]["identity_error"]} and got[t[0]["vec_id"]][1]["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k, (rng.normal(0, 1, 5) * [1e-2, 30, 1, 1e4, 3]).tolist()) for k in range(700)] + [(3, [1.0] * 5), (3, [1.0] * 5)]
    other = [(1000 + k, [float(k % 3), 2.0]) for k in range(9)]
    large = [(2000 + k, [x, 1.0, 0.5, 0.25]) for k, x in enumerate((1e30, -1e300, 5.0))]
    rows = [*good, *other, *large, (None, [0.5] * 5), (5007, None), (5008, [None] * 5), (5009, [float("nan")] * 5), (5010, [float("inf")] * 5), (5011, []), (4000, [2.5] * 3), (4001, [2.5] * 3)]
    df = spark.createDataFrame([(i, v, 9, "clash") for i, v in rows], "vec_id long, embedding array<double>, n int, component string").repartition(6)
    got = collections.defaultdict(list)
    for r in whitening.whiten(df, components=3).collect():
        got[r["vec_id"]].append(r)
    deviation, white, explained = plain_whitening([*(v for _, v in good), [0.5] * 5], 3)
    of = {k: {r["component"]: r for r in got[k]} for k in range(700) if k != 3}
    assert all(of[k][c]["deviation"] == deviation[k] and of[k][c]["n"] == len(good) + 1 for k in of for c in (1, 2, 3))
    assert same_but_sign([[of[k][c]["whitened"] for c in (1, 2, 3)] for k in of], [white[k] for k in of])
    assert np.allclose([of[5][c]["explained"] for c in (1, 2, 3)], explained, rtol=1e-9)
    assert len(got[3]) == 9 and len(got[None]) == 3 and set(range(5007, 5012)).isdisjoint(got)
    assert {(r["component"], r["n"], r["whitened"] is None) for r in got[1004]} == {(1, 9, False), (2, 9, True)}
    assert {(r["explained"], r["whitened"], r["deviation"], r["identity_error"]) for r in got[4000]} == {(0.0, None, 0, 0.0)}
    assert all(r["n"] == 3 and r["deviation"] is None for k in (2000, 2001) for r in got[k])
    assert whitening.whiten(df.filter("false")).count() == 0 and whitening.whiten(df.filter("vec_id = 5011")).count() == 0


def test_rotations_keep_small_deviations():
    """Columns whose lengths differ by twelve orders come out with as many right digits as the large ones."""
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(200, 6)))
    want = np.array([1e6, 3e3, 3e3, 1.0, 1e-3, 1e-6])
    a = q * want
    v, s = whitening.jacobi(whitening.triangle(a))
    assert np.allclose(s, want, rtol=1e-12) and np.allclose(v.T @ v, np.eye(6), atol=1e-14)
    for d in (1, 2, 7, 40):
        a = rng.normal(size=(90, d))
        v, s = whitening.jacobi(whitening.triangle(a))
        assert np.allclose(s, np.linalg.svd(a, compute_uv=False), rtol=1e-12) and np.allclose((a @ v).T @ (a @ v), np.diag(s**2), atol=1e-10)


def check_packing(got, rows, window, end_id):
    """Every id once, checksums, places without gaps, and no padding."""
    t = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for i, text in rows:
        want[i, tuple([*t.encode(text or "", add_special_tokens=False).ids, end_id])] += 1
    ids = {}
    for (i, x), n in want.items():
        ids.setdefault(i, []).extend([x] * n)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        covered = collections.Counter((r["doc_tokens"], r["start"] + k) for r in pieces for k in range(r["length"]))
        assert covered == collections.Counter((len(x), k) for x in ids[i] for k in range(len(x)))
        for r in pieces:
            assert r["length"] > 0 and r["ids_crc32"] in {zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in ids[i] if len(x) == r["doc_tokens"]}
    for places in by_sequence.values():
        total = 0
        for offset, length in sorted(places):
            assert offset == total
            total += length
        assert total == window or total < window and total & (total - 1) == 0


def test_packing_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(queries.op13_retrieval(spark, DATA).collect(), rows, 4096, 2)


def test_words_are_the_librarys():
    """Parts that go to the merges directly have the library's ids, for any mixture of letters, marks, digits and white space."""
    rnd, t = random.Random(9), Tokenizer.from_file(WORDS)
    w = retrieval.Words(WORDS)
    assert w.direct
    pieces = ["'s", "'S", "''", "don't", "IT'LL", "é", "É", "Ñandú", "ß", "ẞ", "İ", "ΟΔΟΣ", "×", "÷", "ª", "²", "12", "_", "-", "...", "<|endoftext|>", "<|", "\u0301", "\u00a0", "\x1c", "\t", "\n", "  ", "日本", "🙂", "ÿ", "straße", "e\u0301", "word", "The", "\u2028", "\x7f", "\x00"]
    for _ in range(3000):
        text = "".join(rnd.choices(pieces, k=rnd.randrange(9)) + [rnd.choice(["", " "])] + rnd.choices(pieces, k=rnd.randrange(5)))
        assert w.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    for text in [r["text"] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").df().to_dict("records")]:
        assert w.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_plain_texts_are_merged_many_at_once(monkeypatch):
    """Runs of signs, digits, short forms and Latin letters in any mixture, between texts that aren't plain; no table grows with new words."""
    rnd, t = random.Random(4), Tokenizer.from_file(WORDS)
    signs = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 60)
    letters = "abstmdrelvBSTRÀÞßéþ 07\n"
    texts = ["".join(rnd.choice(signs if rnd.random() < share else letters) for _ in range(rnd.randrange(40))) for share in (0.1, 0.4, 0.7) for _ in range(2000)]
    monkeypatch.setattr(retrieval.Words, "AT_ONCE", 500)
    w = retrieval.Words(WORDS)
    assert [x.tolist() for x in w.encode_all(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert w.known == {"": b""}
    mixed = [*texts[:50], "日本 word", *texts[50:60], "ÿ", "<b>", "", "x"]
    assert [x.tolist() for x in w.encode_all(mixed)] == [x.ids for x in t.encode_batch(mixed, add_special_tokens=False)]
    assert w.encode_all([]) == [] and w.encode_all(["", ""])[1].tolist() == []


@pytest.mark.parametrize("shard", [1_000_000, 400])
def test_packing_of_odd_rows(spark, shard):
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (None, None), (3, "word " * 900), (4, "same text"), (4, "same text"), (4, "other text"), (5, "a\nb\tc d\x1ce  f\r\n"), (6, "<|endoftext|> It's <|startoftext|>x DON'T 12345 é É ẞ ΟΔΟΣ İ"), (7, "\ń mark"), (8, "w " * 63), (9, "日本語テキスト" * 40)]
    rows += [(100 + k, " ".join(f"topic{k % 5} word{j % (k + 2)}" for j in range(k))) for k in range(60)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, length int, ids string").repartition(3)
    check_packing(retrieval.pack_related(df, WORDS, 64, 2, shard, 3).collect(), rows, 64, 2)
    assert retrieval.pack_related(df.filter("false"), WORDS).count() == 0


def plain_bm25(query, docs, all_docs):
    n, mean = len(all_docs), sum(map(len, all_docs)) / len(all_docs)
    df = collections.Counter(t for d in all_docs for t in set(d))
    out = []
    for d in docs:
        tf = collections.Counter(d)
        out.append(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(query) if tf[t]))
    return out


def test_index_scores_and_windows():
    """Scores are BM25's, and a window takes the unused documents by falling score."""
    rnd = random.Random(1)
    docs = [[rnd.randrange(6 * (k % 4), 6 * (k % 4) + 9) for _ in range(rnd.randrange(3, 12))] for k in range(80)]
    lengths = [len(d) for d in docs]
    terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
    frequency = np.bincount(np.concatenate(terms), minlength=40)
    index = retrieval.Index(list(terms), list(counts), np.array(lengths, float), retrieval.Weights(frequency, len(docs), sum(lengths)))
    for k in (0, 17, 33):
        assert np.allclose(index.scores(terms[k]), plain_bm25(docs[k], docs, docs))
    used, full = set(), 0
    for sequence in retrieval.fill(lengths, list(terms), index, 32):
        if sum(p[2] for p in sequence) < 32:
            break
        used.add(sequence[0][0])
        score = plain_bm25(docs[sequence[0][0]], docs, docs)
        for k, start, _ in sequence[1:]:
            assert start == 0 and score[k] >= max(s for j, s in enumerate(score) if j not in used) - 1e-9
            used.add(k)
        full += 1
    assert full > 10


def test_related_documents_meet(spark):
    """Of documents on one of 20 subjects, which come in no order, neighbours in a sequence share the subject."""
    rnd = random.Random(3)
    subjects = [[f"{a}{b}{k}" for a in "bdfg" for b in ("ak", "or", "il")] for k in "bcdfghjklmnpqrstvwxz"]
    rows = [(k, " ".join(rnd.choices(subjects[k % 20], k=8) + rnd.choices(["the", "of", "and"], k=8))) for k in range(1200)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    by = collections.defaultdict(list)
    for r in retrieval.pack_related(df, WORDS, 256, shard=6000).collect():
        by[r["sequence_id"]].append(r["doc_id"])
    pairs = [(a % 20 == b % 20) for x in by.values() for a in x for b in x if a != b]
    assert sum(pairs) / len(pairs) > 0.6


def test_df_is_over_all_documents(spark):
    df = spark.createDataFrame([(k, "cat dog" if k % 2 else "cat cat") for k in range(10)], "doc_id long, text string").repartition(3)
    made = retrieval.tokens(df, WORDS, 64, 2)
    docs, n, ids = retrieval.frequencies(made, WORDS)
    t = Tokenizer.from_file(WORDS)
    cat, dog = t.encode("cat dog", add_special_tokens=False).ids
    assert (docs[cat], docs[dog], docs[2], n, ids) == (10, 5, 10, 10, 30)
    assert made.agg(F.countDistinct("uid")).first()[0] == 10

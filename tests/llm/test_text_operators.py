"""The operators on documents against plain versions, and on nulls, empty texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tickforge.llm import bpe, langid, lm, matroska, packing, quality, simhash
from tickforge.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, score string, row long"


def documents(spark, rows):
    """Rows of (doc_id, text) with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    return [*out, "", None, " \n\t ", "one", "x" * 30_000, "A  b\nC<|endoftext|>d", out[0], out[0] + " more"]


@pytest.fixture(scope="module")
def rows(texts):
    return [*enumerate(texts), (3, texts[3]), (None, texts[4])]


def test_tokens_are_the_librarys(texts):
    from tokenizers import Tokenizer

    lib, a = Tokenizer.from_file(PATH), bpe.automaton(PATH)
    rnd = random.Random(5)
    pool = [chr(c) for c in (*range(0x3000), 0x4E00, 0x1F600, 0x1D7D8, 0x10400)]
    more = ["".join(rnd.choice(pool) if rnd.random() < 0.3 else rnd.choice("  \n\n\t'sdtmabc 01.,!-é\x85\x1c") for _ in range(rnd.randrange(30))) for _ in range(400)]
    for t in (*(t or "" for t in texts), *more):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(a.encode(t), "<u4").tolist() == ids
        assert a.decode(a.encode(t)).decode() == lib.decode(ids, skip_special_tokens=False)


def test_gadgets_allow_what_merges_leave_apart():
    from tokenizers import Tokenizer

    lib, a = Tokenizer.from_file(PATH), bpe.automaton(PATH)
    rnd = random.Random(1)
    plain = [t for t in a.ids if t.isalpha() and t.isascii()]
    for _ in range(3000):
        x, y = rnd.choice(plain), rnd.choice(plain)
        apart = lib.encode((x + y).decode(), add_special_tokens=False).ids == [a.ids[x], a.ids[y]]
        assert a.allowed(a.ids[x], a.ids[y]) == apart


def test_round_trip_query(spark, rows):
    got = bpe.round_trip(documents(spark, rows), PATH).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    from tokenizers import Tokenizer

    lib, by = Tokenizer.from_file(PATH), {i: t or "" for i, t in rows}
    for r in got:
        ids = lib.encode(by[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest() == hashlib.sha256(by[r["doc_id"]].encode()).hexdigest()
    ids = bpe.encode_documents(documents(spark, rows), PATH)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(ids, PATH).collect()}
    assert back == by
    assert bpe.round_trip(documents(spark, []), PATH).count() == 0


def test_packing(spark, rows):
    long = [(1000 + k, "word " * n) for k, n in enumerate((0, 2046, 2047, 2048, 2049, 5000))]
    docs = documents(spark, rows + long)
    got = packing.pack_documents(docs, PATH, block=64).collect()
    a = bpe.automaton(PATH)
    cut = collections.Counter()
    for i, t in rows + long:
        ids = a.encode(t or "") + bytes(4)
        n = len(ids) // 4
        at, k = 0, 0
        while at < n:
            size = (n - 1) % 2048 + 1 if at == 0 else 2048
            cut[i, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])] += 1
            at, k = at + size, k + 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == cut
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0


def test_crossover_keeps_every_piece_and_never_loses_to_best_fit():
    lengths = np.sort(np.random.default_rng(2).integers(1, 1500, 400))[::-1]
    island = packing.Island(lengths, 2048, 1)
    first = island.start(4)
    grown = island.breed(first, 20)
    for p in grown:
        assert sorted(i for b in p for i in b) == list(range(400))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in p)
    assert len(grown[0]) <= len(first[0])
    assert [sorted(map(sorted, p)) for p in packing._unflat(packing._flat(grown, 400), 400)] == [sorted(map(sorted, p)) for p in grown]


def test_crossover_closes_half_the_gap_that_best_fit_leaves(spark):
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(400, 1400, 4096))[::-1]
    island = packing.Island(lengths, 2048, 1)
    plain = len(island.plain())
    grown = island.breed(island.start(4), 60)
    assert len(grown[0]) <= plain - (plain - island.least()) / 2 and island.crossed > 20
    rows = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(400, 1400, 1500))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(rows, block=800, generations=8).collect()
    assert len(got) == 1500 and all(r["crossovers"] > 0 for r in got)
    best = {}
    for r in got:
        best.setdefault(r["sequence_id"] >> 24, []).append(r["length"])
    for block, sizes in best.items():
        assert len({r["sequence_id"] for r in got if r["sequence_id"] >> 24 == block}) <= len(packing.Island(np.sort(sizes)[::-1], 2048, 0).plain())


def plain_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def roots(n, links):
    p = list(range(n))

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(texts):
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_golay_code_is_perfect_and_keys_meet():
    book, _ = simhash.code()
    rng = np.random.default_rng(0)
    for w in rng.integers(0, 1 << 23, 100):
        d = [bin(int(w) ^ int(c)).count("1") for c in book]
        assert sum(x <= 3 for x in d) == 1
        near = {int(c) >> 11 for c, x in zip(book, d, strict=True) if x <= 4}
        assert set(simhash.near_codewords(np.array([w]))[0].tolist()) == near
    f = rng.integers(0, 1 << 63, 2000, dtype="u8")
    masks = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in f], "u8")
    sets = []
    for x in (f, f ^ masks):
        out = [set() for _ in f]
        for i, k in zip(*simhash.keys(x), strict=True):
            out[i].add(int(k))
        sets.append(out)
    assert all(a & b for a, b in zip(*sets, strict=True))


@pytest.mark.parametrize("crowd", [48, 2])
def test_links_connect_what_two_bits_connect(spark, crowd):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 6, dtype="u8")
    f = np.unique(np.concatenate([rng.integers(0, 1 << 63, 60, dtype="u8"), *(c ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(40)], "u8") for c in centre)]))
    want = roots(len(f), [(i, j) for i, j in itertools.combinations(range(len(f)), 2) if int(f[i] ^ f[j]).bit_count() <= 2])
    edges, _ = simhash.links(spark.createDataFrame([(int(x),) for x in f.view("i8")], "fp long"), crowd)
    place = {int(x): i for i, x in enumerate(f.view("i8"))}
    got = roots(len(f), [(place[r["u"]], place[r["v"]]) for r in edges.collect()])
    assert got == want


def test_near_duplicates(spark, rows):
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for k, (i, _) in zip(root, rows, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = collections.Counter((i, f, least.get(k)) for (i, _), f, k in zip(rows, fps, root, strict=True))
    assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(70)] + [(500, 500 + k) for k in range(90)] + [(3, 3)]
    nodes, _ = components(spark.createDataFrame([*edges, (None, 1)], "u long, v long"))
    root = roots(700, edges)
    want = {x: root[x] for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["root"] for r in nodes.collect()} == want


def test_quality_learns_the_ranking_and_the_share(spark):
    rnd = random.Random(1)
    good = [" ".join(rnd.choice("the of and house river stone garden letters morning winter".split()) + str(rnd.randrange(50)) for _ in range(60)) for _ in range(150)]
    bad = [("Buy! " * 60) if k % 2 else " | ".join("menu" for _ in range(50)) for k in range(50)]
    docs = documents(spark, [*enumerate(good + bad), (9_000, ""), (9_001, None), (0, good[0])])
    marks = spark.createDataFrame([(i, int(i < 150)) for i in range(200)] + [(0, None), (None, 1), (77_777, 1)], "doc_id long, quality int")
    model = quality.train(docs, marks, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = quality.score(docs, model).collect()
    assert len(got) == 203 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] < 150) for r in got if r["doc_id"] < 200]) > 0.97
    none = quality.train(docs, marks.filter("false"), F.lit(True))
    assert {r["predicted"] for r in quality.score(docs, none).collect()} <= {0, 1}
    assert quality.score(documents(spark, []), model).count() == 0


def test_language_spans(spark):
    rnd = random.Random(7)
    vocabulary = {"en": "the of and that is was for on are with his they".split(), "de": "der die und in den von zu das mit sich ich".split(), "ru": "это как его что она они было для при так".split()}
    say = lambda lang, n: " ".join(rnd.choice(vocabulary[lang]) for _ in range(n))
    known = [(k, say(lang, 50), lang) for k, lang in enumerate(["en", "de", "ru"] * 40)]
    docs = spark.createDataFrame([*known, (None, None, "en"), (500, "x", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    tests = [(0, say("en", 30)), (1, say("de", 30)), (2, say("ru", 5)), (3, None), (4, ""), (5, "123 !? \u2014"), (6, say("en", 40) + ". " + say("de", 60)), (7, "中文"), (0, say("en", 3))]
    got = langid.identify(documents(spark, tests), model, spans=True).collect()
    assert [r["lang_pred"] for r in got[:7]] == ["en", "de", "ru", "und", "und", "und", "de"]
    assert [(s["lang"], s["end_word"] - s["first_word"]) for s in got[6]["spans"]] == [("en", 40), ("de", 60)]
    assert got[6]["score"] < 1 and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(documents(spark, []), model).count() == 0
    nothing = langid.learn(docs.filter("false"), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(documents(spark, tests), nothing).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    model = langid.Languages(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool))
    for n in (1, 2, 5, 7):
        for _ in range(40):
            s = rng.normal(0, 4, (n, 3))
            best = max(sum(s[t, x] for t, x in enumerate(p)) - 3.0 * sum(a != b for a, b in itertools.pairwise(p)) for p in itertools.product(range(3), repeat=n))
            spans = model.paths([s[:1], s, np.zeros((0, 3))], 3.0, cells=n)[1]
            got = sum(s[lo:hi, x].sum() for lo, hi, x in spans) - 3.0 * (len(spans) - 1)
            together = [spans, *model.paths([rng.normal(0, 4, (9, 3)), s], 3.0)[1:]]
            assert together[0] == together[1]
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] and a[2] != b[2] for a, b in itertools.pairwise(spans))
            assert got == pytest.approx(best)


@pytest.mark.parametrize("block", [400, 1 << 24])
def test_language_model(spark, rows, block):
    learns = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0
    got = lm.score_documents(documents(spark, rows), learns, block_bytes=block).collect()
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    assert lm.score_documents(documents(spark, []), learns).count() == 0


def test_spelling_sums_to_one():
    """All first bytes of a word, then all second ones, share a probability of one."""
    m = lm.new_mixer(lm.pack_counts(np.random.default_rng(0).integers(0, 4, (2, int(lm.STARTS[-1])))))
    h, place = lm.contexts(*lm.spell([b"q"]), np.array([3]))
    total = 0.0
    for y in range(256):
        node, p = np.ones(1, "u4"), 1.0
        for bit in range(7, -1, -1):
            one = m.bits(m.mixed(*m.inputs(lm.slots(h[:, :1], node), True)), node)[0][0]
            b = y >> bit & 1
            p *= one if b else 1 - one
            node = node << np.uint32(1) | np.uint32(b)
        total += p
    assert total == pytest.approx(1)


def test_matroska_round_trip(spark, rows):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in matroska.stored_features(documents(spark, rows)).collect()}
    for i, t in rows:
        x = (t or "").encode()
        p = x + b"\xff" * (-len(x) % 576 if x else 576)
        r = got[i, hashlib.sha256(p).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(x), len(p), zlib.crc32(p[-32:]))
    stored = matroska.store_texts(documents(spark, rows[:5]))
    table = matroska.packets(stored).filter("error IS NULL").groupBy("doc_id").agg(F.sum("byte_size").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in table} == {i: -(-len(t.encode()) // 576) * 576 for i, t in rows[:5]}
    assert matroska.stored_features(documents(spark, [])).count() == 0


def test_matroska_reads_lacing_unknown_sizes_and_cues():
    el, u, v = matroska.element, matroska.uint, matroska.vint
    frames = [b"a" * 5, b"b" * 300, b"c" * 7, b"d" * 2]
    xiph = bytes([3, 5, 255, 45, 7]) + b"".join(frames)
    signed = lambda d: v(d + (1 << 13) - 1, 2)
    ebml = bytes([3]) + v(5) + signed(295) + signed(-293) + b"".join(frames)
    block = lambda flags, body, rel=1: v(1) + rel.to_bytes(2, "big") + bytes([flags]) + body
    cluster = u(matroska.TIME, 10) + el(matroska.SIMPLE, block(0x82, xiph)) + el(matroska.GROUP, el(matroska.BLOCK, block(0x06, ebml, 2)) + u(matroska.REFERENCE, 1)) + el(matroska.SIMPLE, block(0, b"z"))
    tracks = el(matroska.TRACKS, el(matroska.TRACK, u(matroska.NUMBER, 1) + u(matroska.FRAME_NS, 1000)))
    unknown = lambda kind, body: kind.to_bytes(4, "big") + b"\xff" + body
    data = el(matroska.EBML, el(matroska.DOC_TYPE, b"webm")) + unknown(matroska.SEGMENT, tracks + unknown(matroska.CLUSTER, cluster) + unknown(matroska.CLUSTER, u(matroska.TIME, 20) + el(matroska.SIMPLE, block(0, b"yy", 0))) + el(0xEC, b"void"))
    m = matroska.read(data)
    assert m.doc_type == "webm" and len(m.clusters) == 2
    assert [data[p[6] : p[6] + p[7]] for p in m.packets] == [*frames, *frames, b"z", b"yy"]
    assert [p[1] for p in m.packets] == [11_000_000, 11_001_000, 11_002_000, 11_003_000, 12_000_000, 12_001_000, 12_002_000, 12_003_000, 11_000_000, 20_000_000]
    assert [p[5] for p in m.packets][:5] == [True] * 4 + [False]
    for bad in (data[:40], b"\x00\x00", el(matroska.EBML, b"")[:2] + b"\x85ab"):
        with pytest.raises((ValueError, IndexError)):
            matroska.read(bad)
    assert matroska.read(b"").packets == []


def test_many_languages_take_bounded_memory():
    """A slice of distinct words with 100 languages stays under 200 MB, a long text of mixed ones too."""
    import tracemalloc

    rng = np.random.default_rng(5)
    names = [f"l{k:03d}" for k in range(100)]
    model = langid.Languages(names, rng.normal(-9, 2, (langid.slots_for(100), 100)).astype("f4"), np.ones((len(langid.NAMES), 100), bool))
    own = langid.Labeller(model)
    text = b" ".join(b"w%x" % k for k in rng.integers(0, 1 << 40, 90_000).tolist())
    tracemalloc.start()
    first = own.label([text[: 1 << 20], b"one", None])
    own.label([text[500:], text[: 1 << 19]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    spans = first[0][2]
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(spans))


def test_word_scores_in_chunks_are_those_of_each_word(monkeypatch):
    rng = np.random.default_rng(6)
    model = langid.Languages(["a", "b", "c"], rng.normal(-9, 2, (langid.SLOTS, 3)).astype("f4"), np.ones((len(langid.NAMES), 3), bool))
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 12))).encode() for _ in range(300)] + [b"x" * 5000]
    alone = np.concatenate([model.word_scores([w]) for w in words])
    for step in (langid.STEP, 30, 3):
        monkeypatch.setattr(langid, "STEP", step)
        assert np.allclose(model.word_scores(words), alone, atol=1e-2)


def plain_ranking(good, bad, share):
    """Newton steps on the same pairs, a pair at a time, and the threshold between the scores of all labelled rows."""
    r = quality.learn(good, bad, share)
    rng = np.random.default_rng(7)
    g, b = r.expand(good), r.expand(bad)
    n = quality.PAIRS * max(len(g), len(b))
    pairs = [(g[i] - b[j]) / r.deviation for i, j in zip(rng.integers(0, len(g), n), rng.integers(0, len(b), n), strict=True)]
    w = np.zeros(len(pairs[0]))
    for _ in range(40):
        slope, bend = -1e-3 * w, 1e-3 * np.eye(len(w))
        for d in pairs:
            p = 1 / (1 + math.exp(min(30, max(-30, float(d @ w)))))
            slope += d * p / n
            bend += np.outer(d, d) * p * (1 - p) / n
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def test_quality_is_the_plain_newton_search(spark):
    rnd = random.Random(4)
    good = [" ".join(rnd.choice("the of and house river stone. Garden letters, morning winter".split()) for _ in range(rnd.randrange(20, 90))) for _ in range(24)]
    bad = [" ".join(rnd.choice("buy NOW !!! click | menu 777 the of".split()) for _ in range(rnd.randrange(5, 60))) for _ in range(12)]
    docs = documents(spark, [*enumerate(good + bad), (3, good[3] + " zzz"), (900, "x" * 3_000_000), (901, None)])
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    marks = [(i, int(i < 24)) for i in range(36)]
    model = quality.train(docs, spark.createDataFrame(marks, "doc_id long, quality int"), ~held)
    ids = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 5]
    x = {i: quality.features((good + bad)[i].encode()) for i in ids}
    a, b = (np.array([x[i] for i in ids if (i < 24) == side]) for side in (True, False))
    assert np.allclose(model.weights, plain_ranking(a, b, len(b) / len(ids)), atol=1e-6)
    raw = sorted(model.raw(np.array([*x.values(), quality.features((good[3] + " zzz").encode())])) if 3 in ids else model.raw(np.array(list(x.values()))))
    k = next(k for k in range(len(raw)) if (k + 1) / len(raw) >= len(b) / len(ids))
    assert raw[k] <= model.threshold <= raw[k + 1]
    other = quality.train(docs, spark.createDataFrame([(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in marks], "doc_id long, quality int"), ~held)
    assert (other.weights == model.weights).all() and other.threshold == model.threshold  # held-out labels say nothing
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(got) == 38 and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_very_long_texts_and_plain_word_scores(spark):
    rnd = random.Random(7)
    say = lambda ws, n: " ".join(rnd.choice(ws) for _ in range(n))
    en, de = "the of and that is was for on are with".split(), "der die und in den von zu das mit sich".split()
    docs = spark.createDataFrame([(k, say((en, de)[k % 2], 40), ("en", "de")[k % 2]) for k in range(60)], "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    rows = [(0, say(en, 300_000)), (1, say(en, 60_000) + " " + say(de, 90_000)), (2, "x" * 2_000_000)]
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, rows), model, spans=True).collect()}
    assert got[0]["lang_pred"] == "en" and got[1]["lang_pred"] == "de" and [s["end_word"] - s["first_word"] for s in got[1]["spans"]] == [60_000, 90_000]
    # A word's score is half the sum of its n-grams' log likelihoods, the best language's taken off.
    for w in (b"the", b"und", b"q"):
        parts = b" " + w + b" "
        grams = [parts[i : i + n] for n in langid.SIZES for i in range(len(parts) - n + 1) if not (n < 3 and parts[i : i + n].strip() == b"") and b" " not in parts[i : i + n][1:-1]]
        total = np.zeros(len(model.names))
        for g in grams:
            h = 0
            for k, c in enumerate(g, 1):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (c + k * 256)
            total += model.table[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 16]
        want = np.maximum(total / 2 - (total / 2).max(), -20)
        assert np.allclose(model.word_scores([w])[0], want, atol=1e-3), w

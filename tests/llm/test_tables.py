"""Archives, url rules, exact search, the registered queries and the pipeline."""

import base64
import collections
import gzip
import hashlib
import itertools
import json
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickforge.llm import queries, topk, urlfilter, warc

from .test_near_copies import plain_set

DATA = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


PAGES = [(1, "http://a/x", "same"), (5, "http://a/y", "same"), (3, None, "same"), (2, "u", None), (4, "u\r\nX: y", ""), (6, "http://b", "é" * 5000 + "\r\n\r\nWARC/1.0\r\n"), (None, "n", "same"), (7, "t", "tie"), (7, "t", "tie")]


@pytest.mark.parametrize("size,least", [(1 << 20, 0), (1, 0), (200, 5)])
def test_archives(spark, size, least):
    index, at = warc.archive_pages(pages(spark, PAGES).repartition(2), least, size)
    got = warc.read_records(index, at).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for i, _, h in PAGES:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        whole, n = top[h or ""], len((h or "").encode())
        revisit = n >= least and i != whole
        want.append((i, n, digest(h), "revisit" if revisit else "response", whole if revisit else None))
    if least <= 3:
        k = want.index((7, 3, digest("tie"), "response", None))  # of two rows alike one refers to the other
        want[k] = (7, 3, digest("tie"), "revisit", 7)
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(want)
    root = Path(at.removeprefix("file://"))
    for f in root.glob("*.warc.gz"):
        data, lines = f.read_bytes(), [json.loads(x) for x in f.with_name(f.name.replace(".warc.gz", ".cdxj")).read_text().splitlines()]
        assert sum(x["byte_size"] for x in lines) == len(data)
        for x in lines:
            assert gzip.decompress(data[x["byte_start"] : x["byte_start"] + x["byte_size"]]).startswith(b"WARC/1.1\r\nWARC-Type: " + x["record_type"].encode())
    assert warc.read_records(*warc.archive_pages(pages(spark, []))).count() == 0


def plain_verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("most", [100_000, 0])
def test_url_rules(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", most)
    rnd = random.Random(2)
    rules = [*queries.URL_RULES, ("a.b", "", "block"), ("b", "/x", "block"), ("b", "/x", "allow"), ("c.d.e", "/q/r", "block"), ("", "/", "block")]
    hosts = ["com", "example.com", "www.EXAMPLE.com", "x.net", "net", "a.b", "z.a.b", "ab", "c.d.e", "İ.com", "", "com."]
    urls = [None, "", "no scheme", "http://", *("".join((rnd.choice(["http", ""]), "://", rnd.choice(hosts), rnd.choice(["", "/", "/en/", "/en", "/es/1", "/xyz", "/q/r/s"]), rnd.choice(["", "?a=/b://c", "#z", "?"]))) for _ in range(150))]
    rows = [(k % 90, u, "h") for k, u in enumerate(urls)] + [(None, "http://a.b", ""), (1, urls[1], "h")]
    got = urlfilter.judge(pages(spark, rows), spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string"))
    want = collections.Counter((i, *plain_verdict(u, rules)) for i, u, _ in rows)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert urlfilter.judge(pages(spark, []), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    none = urlfilter.judge(pages(spark, rows), spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(rows)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(0, 1, 8).tolist()) for k in range(300)]
    vectors += [(300 + k, vectors[7][1]) for k in range(20)] + [(7, vectors[7][1]), (400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (350, [0.5] * 3), (404, [0.25] * 3), (405, []), (450, []), (500, [1e9] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, rows=64, queries=4, pivots=5, step=8).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for k, (i, q) in enumerate(good):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for n, (j, v) in enumerate(good) if n != k and len(v) == len(q))
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])]
    assert topk.top_k(df.filter("false"), F.lit(True)).count() == 0


def test_pivots_rule_rows_out():
    """On clustered vectors most rows are never evaluated, and the result is the same."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 800, (40, 16))
    x = np.floor(np.repeat(centres, 50, 0) + rng.normal(0, 20, (2000, 16)))
    ids = np.arange(2000)
    p, table, longest = topk.pivot_table(x, 48)
    seen: list[int] = []
    got = topk.search_block(ids, ids, x, False, p, table, longest, ids[:20], x[:20], False, 5, 32, 256.0, seen)
    for i in range(20):
        s = x @ x[i]
        order = [int(j) for j in np.lexsort((ids, -s)) if j != i][:5]
        assert [j for q, j, _ in got if q == i] == order
    assert np.mean(seen) < 1000


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.SQL[name]).fetchall()
    columns = [c[0] for c in con.sql(queries.SQL[name]).description]
    got = queries.QUERIES[name](spark, DATA).select(*columns).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, DATA)
    own = {r["doc_id"]: r["predicted"] for r in queries.op1_quality(spark, DATA).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, p in own.items() if p}
    named = stages["language_id"](spark, good, DATA)
    assert named.columns == docs.columns and named.count() == good.count()  # all are in learned languages
    one = stages["near_dedup"](spark, named, DATA)
    texts = {r["doc_id"]: r["text"] for r in named.collect()}
    sets = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    roots = {find(i) for i in sets}
    assert {r["doc_id"] for r in one.collect()} == roots and one.count() == len(roots)
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in got} == roots
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (5, "", None, None, 0), (5, "", None, None, 0), (6, "the of and to", "en", "s", 13)], docs.schema)
    assert sorted(str(r["doc_id"]) for r in stages["near_dedup"](spark, odd, DATA).collect()) == ["5", "6"]
    for name in ("quality_classifier", "language_id", "best_fit_packing"):
        stages[name](spark, odd, DATA).collect()


def test_stages_take_columns_that_clash_with_their_own(spark):
    """Extra columns named like results or helpers of the operators change nothing."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.withColumns({c: F.lit(7) for c in ("score", "predicted", "lang_pred", "digest", "keys", "near_row", "size", "fp", "piece", "row", "block", "x")})
    for name, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, docs, DATA), stage(spark, odd, DATA)
        assert got.columns == want.columns
        ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
        assert ids(got) == ids(want), name

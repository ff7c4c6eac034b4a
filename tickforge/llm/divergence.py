"""Source divergence audit: how far the term frequencies of each source of a language are from those of the others.

Sort-based streaming. Each task sorts the terms of a stretch of its documents, as numbers, and sends runs of (lang, term, source, documents of one stretch)
with their numbers of documents and occurrences, so a frequent term comes as a row a stretch and source. These rows are dealt by (lang,
term) and sorted by (lang, term, source, stretch); one scan over the runs gives each term's document frequency and its counts by source,
and keeps the terms that enough documents have. A second scan over the kept terms, behind a row that holds the language's
groups, adds up each run's part of all pairs of sources and keeps the best terms of each source. Its rows are dealt by (lang, salt), so
one language is many tasks, and memory is bounded by rows of one number a source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, rows_of, small_batches, tidy

#: Fixed values of the audit: documents that a kept term is in, what is added to each count, the unit of p, ranks of terms.
LEAST_DOCS, ADDED, UNIT, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Bytes of a stretch of texts, kept terms of a salt, the least number of salts, and bytes of pair sums held by a task.
STRETCH_BYTES, TERMS_A_SALT, LEAST_SALTS, PAIR_BYTES = 12 << 20, 4096, 64, 64 << 20

#: Bytes of terms (letters, lower-cased, and all beyond ASCII); any other byte is a gap.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("stretch", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def runs_of(lang: pa.Array, source: pa.Array, text: pa.Array, stretch: int) -> pa.RecordBatch:
    """The runs of one stretch of documents: its terms as one column, sorted as numbers by (document, term) and then by (term, group)."""
    text = pa.concat_arrays([text]) if text.offset else text
    cut = np.frombuffer(text.buffers()[1], "i4")[: len(text) + 1].astype("i8")
    data = np.frombuffer(bytes(memoryview(text.buffers()[2] or b"")[cut[0] : cut[-1]]).translate(FOLD), "u1")
    cut -= cut[0]
    inside = data != 32
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = cut[1:-1][(cut[1:-1] > 0) & (cut[1:-1] < len(data))]  # a term doesn't reach over the end of its text
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start, size = np.flatnonzero(begins), np.flatnonzero(ends)
    doc = np.searchsorted(cut, start, "right") - 1
    size = size - start + 1
    offsets = np.concatenate([[0], np.cumsum(size)]).astype("i4")
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    pairs = np.sort(doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    n = np.diff(np.append(first, len(pairs)))
    doc, term = np.divmod(pairs[first], max(1, len(coded.dictionary)))
    groups: dict[tuple[str, str], int] = {}
    of = np.array([groups.setdefault(x, len(groups)) for x in zip(lang.to_pylist(), source.to_pylist(), strict=True)], "i8")
    key = term * len(groups) + of[doc]
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    term, g = np.divmod(key[first], len(groups))
    lang, source = (pa.array([x[k] for x in groups], pa.string()).take(pa.array(g)) for k in (0, 1))
    docs = np.diff(np.append(first, len(key)))
    n = np.add.reduceat(n, first) if len(first) else n
    return pa.RecordBatch.from_arrays([lang, coded.dictionary.take(pa.array(term)).cast(pa.string()), source, pa.array(np.full(len(first), stretch, "i8")), pa.array(docs.astype("i8")), pa.array(n.astype("i8"))], schema=RUNS)


def term_runs(docs: DataFrame, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """Rows (lang, term, source, stretch, docs, n) of (lang, source, text): the documents of one stretch of a task with the term, and its
    occurrences there. A stretch has about so many bytes of text, or one longer text."""

    def run(batches):
        stretch, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in rows_of(batches, most_bytes=stretch_bytes):
            size += b.column(2).nbytes
            held.append(b)
            if size >= stretch_bytes:
                yield runs_of(*(pa.concat_arrays([x.column(k) for x in held]) for k in range(3)), stretch)
                stretch, held, size = stretch + 1, [], 0
        if held:
            yield runs_of(*(pa.concat_arrays([x.column(k) for x in held]) for k in range(3)), stretch)
        tidy()

    return small_batches(docs).mapInArrow(run, _ddl(RUNS))


def _new(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first always does."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for c in columns:
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def scan_runs(least: int):
    """Over rows sorted by (lang, term, source, stretch): one row for each (lang, term) that at least `least` documents have, with
    its counts by source. Of an unfinished run only one row a source is held."""

    def merged(t: pa.RecordBatch | pa.Table) -> tuple:
        lang, term, source, _, docs, n = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
        at = np.flatnonzero(_new(lang, term, source))
        take = pa.array(at)
        return lang.take(take), term.take(take), source.take(take), np.add.reduceat(docs.to_numpy(), at), np.add.reduceat(n.to_numpy(), at)

    def rows(lang, term, source, docs, n):
        if not len(docs):
            return None
        start = np.flatnonzero(_new(lang, term))
        total = np.add.reduceat(docs, start)
        good = total >= least
        each = np.repeat(good, np.diff(np.append(start, len(docs))))
        ends = np.concatenate([[0], np.cumsum(np.diff(np.append(start, len(docs)))[good])]).astype("i4")
        first, part = pa.array(start[good]), pa.array(each)
        lists = [pa.ListArray.from_arrays(pa.array(ends), c) for c in (source.filter(part), pa.array(n).filter(part))]
        return pa.RecordBatch.from_arrays([lang.take(first), term.take(first), pa.array(total[good]), *lists], schema=KEPT)

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b.cast(RUNS)])
            lang, term, source, docs, n = merged(pa.concat_tables([rest, t]) if rest is not None else t)
            last = int(np.flatnonzero(_new(lang, term))[-1])
            if last:
                yield rows(*(c.slice(0, last) for c in (lang, term, source)), docs[:last], n[:last])
            rest = pa.table([*(c.slice(last) for c in (lang, term, source)), pa.array(np.zeros(len(docs) - last, "i8")), pa.array(docs[last:]), pa.array(n[last:])], schema=RUNS)
        if rest is not None:
            yield rows(*merged(rest))

    return run


def shares(counts, totals, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * v)) of each count and total, in whole numbers of any size where they need it."""
    counts, below = np.asarray(counts, "i8"), np.asarray(totals, "i8") + ADDED * int(v)
    if counts.max(initial=0) < (1 << 63) // UNIT - ADDED:
        return 1 + UNIT * (counts + ADDED) // below
    return np.array([1 + UNIT * (int(c) + ADDED) // int(b) for c, b in zip(counts, np.broadcast_to(below, counts.shape), strict=True)], "i8")


class Audit:
    """One language's groups, the sums over the terms seen so far, and each group's best terms."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], v: int, ranks: int, most: int):
        self.lang, self.sources, self.totals, self.v, self.ranks = lang, sources, np.array(totals, "i8"), int(v), ranks
        self.place = {s: k for k, s in enumerate(sources)}
        self.whole = int(self.totals.sum())
        self.absent = shares(np.zeros(len(sources), "i8"), self.totals, self.v) if self.v else np.zeros(len(sources), "i8")
        #: A row for each source a that has come, as many as fit: |p_a - p_b| beyond what it is where neither has the term, over the
        #: terms that a has (back), and over those that b doesn't have (one).
        most = min(len(sources), max(1, most // (16 * max(1, len(sources)))))
        self.back, self.one = (np.zeros((most, len(sources)), "i8") for _ in range(2))
        self.row, self.held = np.full(len(sources), -1), []
        self.best: dict[int, list[tuple[int, str]]] = {}

    def base(self, a) -> np.ndarray:
        return np.abs(self.absent[a, None] - self.absent)

    def term(self, term: str, sources: list[str], counts: list[int]):
        """Adds a term; yields sums of pairs where those of its sources don't fit beside them."""
        at = np.array([self.place[s] for s in sources])
        p = shares(counts, self.totals[at], self.v)
        q = int(shares([sum(counts)], self.whole, self.v)[0])
        full = self.absent.copy()
        full[at] = p
        for lo in range(0, len(at), len(self.one)):
            own, x = at[lo : lo + len(self.one)], p[lo : lo + len(self.one)]
            new = own[self.row[own] < 0]
            if len(self.held) + len(new) > len(self.one):
                yield from self.sums_out()
                new = own
            self.row[new] = len(self.held) + np.arange(len(new))
            self.held += new.tolist()
            more = np.abs(x[:, None] - full) - self.base(own)
            self.back[self.row[own]] += more
            more[:, at] = 0
            self.one[self.row[own]] += more
        for k in np.flatnonzero(p > q).tolist():
            best = self.best.setdefault(int(at[k]), [])
            best.append((int(p[k]) - q, term))
            if len(best) >= 20 * self.ranks:
                self.cut(best)

    def cut(self, best: list[tuple[int, str]]) -> None:
        best.sort(key=lambda r: -r[0])  # terms come in their order, and the sort is stable
        del best[self.ranks :]

    def _rows(self, a: int, values: np.ndarray, back: bool = False) -> pa.RecordBatch:
        at = np.flatnonzero(values != 0)
        own, other = [self.sources[a]] * len(at), [self.sources[b] for b in at]
        return self.batch(*((other, own) if back else (own, other)), "pair", values[at])

    def batch(self, source: list[str], item: list[str], part: str, value) -> pa.RecordBatch:
        n = len(source)
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], schema=PARTS)

    def all_pairs(self):
        """A row for each pair, with what it would sum to if no source had any term."""
        for a, s in enumerate(self.sources):
            yield self.batch([s] * (len(self.sources) - 1), [x for x in self.sources if x != s], "pair", np.delete(self.v * self.base(np.array([a]))[0], a))

    def sums_out(self):
        """The sums of pairs so far. A term that both have is in the rows of both, and counts for (a, b) by a's row alone."""
        for k, a in enumerate(self.held):
            yield self._rows(a, self.back[k])
            yield self._rows(a, self.one[k], back=True)
        self.one[: len(self.held)] = self.back[: len(self.held)] = 0
        self.row[:] = -1
        self.held = []

    def end(self):
        yield from self.sums_out()
        for a, best in self.best.items():
            self.cut(best)
            yield self.batch([self.sources[a]] * len(best), [t for _, t in best], "term", [v for v, _ in best])


def scan_terms(ranks: int, most: int):
    """Over rows sorted by (lang, salt, kind, term), where the row of kind 0 has the language's groups: parts of pairs, and the best terms."""

    def run(batches):
        now, key = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    if now:
                        yield from now.end()
                    now, key = Audit(r["lang"], r["sources"], r["counts"], r["v"], ranks, most), (r["lang"], r["salt"])
                    if r["salt"] == 0:
                        yield from now.all_pairs()
                else:
                    assert (r["lang"], r["salt"]) == key
                    yield from now.term(r["term"], r["sources"], r["counts"])
        if now:
            yield from now.end()

    return run


def audit(df: DataFrame, least: int = LEAST_DOCS, ranks: int = TERM_RANKS, stretch_bytes: int = STRETCH_BYTES, terms_a_salt: int = TERMS_A_SALT, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank of (text, lang, source).

    A language keeps the terms that at least `least` of its documents have; every (lang, source) group that occurs, and the language
    as a whole, gives each of them p. Part "pair" has each other source of the language with |p - q| summed over all kept terms; part "term" has
    the kept terms that the group uses more than its language does, to `ranks`. Null text, lang and source are empty ones. Each row is a
    document, so rows that repeat count each. A group without terms, or of a language without kept terms, has its pairs still; a language
    of one source has none. Ties go to the item that is first in UTF-8. An empty table gives an empty result. Other columns are ignored."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = df.select(text("lang"), text("source"), text("text"))
    runs = term_runs(docs, stretch_bytes).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "stretch")
    kept, kept_at = materialize(runs.mapInArrow(scan_runs(least), _ddl(KEPT)), "kept-terms")
    salts = max(LEAST_SALTS, -(-kept.count() // terms_a_salt))

    has = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("g")).groupBy("lang", F.col("g.sources").alias("source")).agg(F.sum("g.counts").alias("n"))
    groups = docs.select("lang", "source").distinct().join(has, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    # A language's groups are one row: its pairs, which the result holds, are that number squared.
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
    heads = by_lang.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    heads, heads_at = materialize(heads.select("lang", F.col("g.source").alias("sources"), F.col("g.n").alias("counts"), F.coalesce("v", F.lit(0)).alias("v")), "groups")

    rows = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("long").alias("salt"), F.lit(1).alias("kind"), "term", "sources", "counts", F.lit(0).cast("long").alias("v"))
    first = heads.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), F.lit("").alias("term"), "sources", "counts", "v")
    parts, _ = materialize(rows.unionByName(first).repartition("lang", "salt").sortWithinPartitions("lang", "salt", "kind", "term").mapInArrow(scan_terms(ranks, pair_bytes), _ddl(PARTS)), "audit-parts")
    discard(df.sparkSession, kept_at, heads_at)

    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    numbered = lambda t: t.withColumn("rank", F.row_number().over(w))
    terms = numbered(parts.filter("part = 'term'")).filter(F.col("rank") <= ranks)
    return numbered(pairs).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")

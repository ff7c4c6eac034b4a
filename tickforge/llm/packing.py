"""Best-fit packing of token sequences by a grouping genetic algorithm over islands.

Documents are cut into pieces of at most `capacity` tokens. Pieces are dealt by hash into blocks of about `block`
pieces, and each block has several islands, each with a population of packings of the block's pieces, made by best fit in
noisy orders. In an epoch each island breeds: crossover injects whole well-filled bins of one parent into another, drops the
bins that share a document with them and the emptiest others, exchanges what the rest hold for displaced documents that
fill them better, and gives what is left over to the best-fitting bins. Between epochs the elites of an island move to the
next one; the last epoch has one more guest, the packing by best fit in falling order, so that no result is worse than it.
Blocks are independent, so the work is in proportion to the rows, and nothing is gathered.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_single_spaces, byte_letters, id_bytes
from .common import map_batches, materialize, texts_of

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """Ids of texts by the installed rank-based encoder, with a table of the words met so far."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"] for t in spec["added_tokens"]}
        made = [ranks[bytes(of[c] for c in (m.replace(" ", "") if isinstance(m, str) else "".join(m)))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: ids don't follow the order of the merges")
        self.encoder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return self.encoder.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()

    def spaced(self, part: str) -> bytes:
        got = id_bytes(self.encoder.encode_ordinary(" " + part))
        if len(part) <= 48:
            if len(self.parts) >= 600_000:
                self.parts.clear()
            self.parts[part] = got
        return got

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        return by_single_spaces(text, self.parts, self.spaced, self.whole)


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of (doc_id, text): doc_id, piece, start, length, ids_crc32. A null text counts as empty (its piece is the
    end id alone). Only documents of more than capacity tokens are cut; then the first piece is the short one."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        t, end = tokens(path), np.array([end_id], "<u4").tobytes()
        rows, no, start, length, crc = [], [], [], [], []
        for i, x in enumerate(texts_of(b.column(1))):
            ids = t.encode((x or b"").decode()) + end
            n = len(ids) // 4
            at, k = 0, 0
            while at < n:
                size = (n - 1) % capacity + 1 if at == 0 else capacity
                rows.append(i)
                no.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                at, k = at + size, k + 1
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, piece int, start long, length long, ids_crc32 long", last=lambda: tokens(path).parts.clear())


class Island:
    """Packings of one block's pieces. A packing is a list of bins; a bin is (free, list of pieces)."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.size, self.capacity = lengths.tolist(), capacity
        self.rng, self.crossed = np.random.default_rng(seed), 0

    def fit(self, bins: list[list[int]], loose: list[int], order_noise: float = 0.0) -> list[list[int]]:
        """Give each loose piece, large ones first, to the fullest bin that it fits; where none does, to a new one."""
        size, capacity = self.size, self.capacity
        out = [list(b) for b in bins]
        open_ = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(out))
        keys = [size[i] for i in loose]
        if order_noise:
            keys = (np.array(keys) * (1 + order_noise * self.rng.standard_normal(len(keys)))).tolist()
        for _, i in sorted(zip(keys, loose, strict=True), reverse=True):
            at = bisect_left(open_, (size[i], -1))
            if at == len(open_):
                out.append([i])
                left, k = capacity - size[i], len(out) - 1
            else:
                left, k = open_.pop(at)
                out[k].append(i)
                left -= size[i]
            if left:
                insort(open_, (left, k))
        return out

    def cost(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the room left is best in few bins."""
        room = [self.capacity - sum(self.size[i] for i in b) for b in bins]
        return len(bins), -float(sum(r * r for r in room))

    def exchange(self, bins: list[list[int]], loose: list[int]) -> tuple[list[list[int]], list[int]]:
        """For each bin in turn, the exchange of one or two of its pieces for one loose piece that fills it most, if one does."""
        size, capacity, out = self.size, self.capacity, []
        pool = sorted((size[i], i) for i in loose)
        for b in bins:
            room = capacity - sum(size[i] for i in b)
            if room and pool:
                few = b[:6]
                best, going, place = 0, None, 0
                for x, i in enumerate(few):
                    for out_size, gone in ((size[i], (i,)), *((size[i] + size[j], (i, j)) for j in few[:x])):
                        at = bisect_left(pool, (out_size + room + 1, -1)) - 1
                        if at >= 0 and pool[at][0] - out_size > best:
                            best, going, place = pool[at][0] - out_size, gone, at
                if going:
                    new = pool.pop(place)[1]
                    b = [*(i for i in b if i not in going), new]
                    for i in going:
                        insort(pool, (size[i], i))
            out.append(b)
        return out, [i for _, i in pool]

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """Inject b's well-filled bins into a; a's bins that share a piece with them go, and their other pieces are dealt out."""
        filled = lambda x: sum(self.size[i] for i in x)
        full = [x for x in b if filled(x) >= 0.99 * self.capacity] or sorted(b, key=filled)[-max(1, len(b) // 10) :]
        take = [full[k] for k in self.rng.permutation(len(full))[: max(1, len(full) // 2)]]
        taken = {i for x in take for i in x}
        stay, loose = [], []
        for x in a:
            if taken.isdisjoint(x):
                stay.append(x)
            else:
                loose += [i for i in x if i not in taken]
        stay.sort(key=filled)
        poor = max(1, len(stay) // 100)  # mutation: the emptiest bins are dealt anew too
        stay, loose = self.exchange(stay[poor:], [*loose, *(i for x in stay[:poor] for i in x)])
        self.crossed += 1
        return self.fit([*take, *stay], loose)

    def start(self, population: int) -> list[list[list[int]]]:
        everything = list(range(len(self.size)))
        return [self.fit([], everything, 0.2 * (k + 1)) for k in range(population)]

    def plain(self) -> list[list[int]]:
        return self.fit([], list(range(len(self.size))))

    def least(self) -> int:
        return -(-sum(self.size) // self.capacity)

    def breed(self, population: list[list[list[int]]], generations: int) -> list[list[list[int]]]:
        population = sorted(population, key=self.cost)
        for _ in range(generations):
            if len(population[0]) == self.least():
                break
            i, j = self.rng.choice(len(population), 2, replace=False) if len(population) > 1 else (0, 0)
            child = self.cross(population[min(i, j)], population[max(i, j)])
            population[-1] = min(child, population[-1], key=self.cost)
            population.sort(key=self.cost)
        return population


def _flat(population: list[list[list[int]]], n: int) -> bytes:
    """Each packing as the bin of every piece."""
    out = np.zeros((len(population), n), "<u4")
    for row, bins in zip(out, population, strict=True):
        for k, b in enumerate(bins):
            row[b] = k
    return out.tobytes()


def _unflat(data: bytes, n: int) -> list[list[list[int]]]:
    out = []
    for row in np.frombuffer(data, "<u4").reshape(-1, n) if n else []:
        order = np.argsort(row, kind="stable")
        out.append([x.tolist() for x in np.split(order, np.flatnonzero(np.diff(row[order])) + 1)])
    return out


STATE = "block long, island int, n int, crossed int, lengths binary, rows binary, packings binary"


def pack(df: DataFrame, capacity: int = 2048, block: int = 4096, islands: int = 2, population: int = 4, generations: int = 5, epochs: int = 2, key: str | None = None) -> DataFrame:
    """Adds sequence_id (long), offset (long) and crossovers (int, of its block) to pieces (doc_id, piece, start, length,
    ids_crc32), none longer than capacity. Rows may repeat. Blocks get about `block` pieces each by a hash of key (a column that differs by row; by
    default of all columns), whatever the number of rows."""
    n = df.count()
    blocks = max(1, -(-n // block))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def begin(key, t):
        t = t.select(names).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = t["length"].to_numpy().astype("<i4")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        return pa.table({
            "block": [key[0].as_py()] * islands, "island": pa.array(range(islands), pa.int32()), "n": pa.array([t.num_rows] * islands, pa.int32()), "crossed": pa.array([0] * islands, pa.int32()),
            "lengths": pa.array([lengths.tobytes()] * islands, pa.binary()), "rows": pa.array([sink.getvalue().to_pybytes()] + [b""] * (islands - 1), pa.binary()),
            "packings": pa.array([b""] * islands, pa.binary()),
        })

    def live(epoch: int):
        def run(key, t):
            own = next(r for r in t.to_pylist() if r["lengths"])
            guests = [p for r in t.to_pylist() for p in _unflat(r["packings"], own["n"])]
            island = Island(np.frombuffer(own["lengths"], "<i4"), capacity, 7919 * key[0].as_py() + 31 * key[1].as_py() + epoch)
            last = epoch == epochs - 1
            grown = island.breed([*(guests or island.start(population)), *([island.plain()] if last else [])], generations)[:population]
            home, k = key[1].as_py(), own["n"]
            # One row keeps the island's pieces and population; the other carries the elite to the next island, or at the end to the first.
            out = [
                {"block": own["block"], "island": home, "n": k, "crossed": own["crossed"] + island.crossed, "lengths": own["lengths"], "rows": own["rows"], "packings": b"" if last else _flat(grown, k)},
                {"block": own["block"], "island": 0 if last else (home + 1) % islands, "n": k, "crossed": 0 if not last else own["crossed"] + island.crossed, "lengths": b"", "rows": b"", "packings": _flat(grown[:1], k)},
            ]
            return pa.Table.from_pylist(out, schema=t.schema)

        return run

    def finish(key, t):
        rows = t.to_pylist()
        own = next(r for r in rows if r["rows"])
        island = Island(np.frombuffer(own["lengths"], "<i4"), capacity, 0)
        crossed = sum(r["crossed"] for r in rows if not r["lengths"])
        best = min((p for r in rows for p in _unflat(r["packings"], own["n"])), key=island.cost)
        with pa.ipc.open_stream(own["rows"]) as r:
            t = r.read_all()
        sequence, offset = np.zeros(own["n"], "i8"), np.zeros(own["n"], "i8")
        for k, b in enumerate(best):
            at = 0
            for i in b:
                sequence[i], offset[i] = k, at
                at += island.size[i]
        return t.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 24))).append_column("offset", pa.array(offset)).append_column("crossovers", pa.array([crossed] * own["n"], pa.int32()))

    state = df.withColumn("block", F.pmod(F.xxhash64(*([key] if key else names)), F.lit(blocks))) if blocks > 1 else df.withColumn("block", F.lit(0).cast("long"))
    state = state.groupBy("block").applyInArrow(begin, STATE)
    for e in range(epochs):
        state = state.groupBy("block", "island").applyInArrow(live(e), STATE)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, crossovers int"
    return state.filter(F.col("island") == 0).groupBy("block").applyInArrow(finish, out)


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, **kw) -> DataFrame:
    """Tokenizes (doc_id, text) and packs the pieces; see pieces() and pack(). An empty table gives an empty result."""
    cut, _ = materialize(pieces(df, path, capacity), "pieces")
    return pack(cut.withColumn("row", F.monotonically_increasing_id()), capacity, key="row", **kw)

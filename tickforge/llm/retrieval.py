"""Lexical retrieval packing: each window is filled by the documents that are closest to its first one.

Documents are tokenized once and written with their terms (the ids) and term frequencies. Document frequencies over all documents
give each term its weight. Documents of whole windows fill these alone; what is left of each, shorter than a window, is dealt and
sorted by the two heaviest of its terms that enough documents have, so related documents meet and a term that many documents share is
split. Each task cuts its sorted rows into shards of bounded size. A shard has an inverted BM25 index; for the first document of each window
it returns the unused documents by falling score, which fill the window in that order. The one that doesn't fit is cut,
and its rest begins the next window. What is left at a shard's end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import map_batches, materialize, small_batches, texts_of, tidy

#: BM25's parameters: saturation of frequencies and weight of a document's length.
SATURATION, BY_LENGTH = 1.2, 0.75
#: Ids and terms of a shard, and documents that a term must be in for documents to be dealt by it.
SHARD, SHARED = 1_000_000, 32


#: How the vocabulary file normalises and splits texts.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters from A to y with acute, which normalising leaves alone but for their case; texts of these and of visible ASCII are plain.
LATIN = "".join(chr(c) for c in range(0xC0, 0xFF) if c not in (0xD7, 0xF7))
#: Without "<", with which special tokens begin.
PLAIN = re.compile(f"[!-;=-~ \n{LATIN}]*")
#: Kinds of the bytes of plain texts in Latin-1, and what stands for them within a piece of the split and at its end: small letters there and
#: capital ones here (a sharp s has none, so a multiplication sign), digits always end a piece, other signs become control characters.
SPACE, LETTER, DIGIT, SIGN, MARK = range(5)
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 60)
KIND, INNER, FINAL = np.full(256, SPACE, "u1"), np.arange(256, dtype="u1"), np.arange(256, dtype="u1")
KIND[0] = MARK
for _c in map(ord, "abcdefghijklmnopqrstuvwxyz" + LATIN.lower()):
    _end = 0xD7 if _c == 0xDF else _c - 32
    KIND[[_c, _end]], INNER[[_c, _end]], FINAL[[_c, _end]] = LETTER, _c, _end
KIND[0xD7] = SPACE  # doesn't occur itself
KIND[48:58] = DIGIT
for _k, _c in enumerate(map(ord, SIGNS)):
    KIND[_c], FINAL[_c] = SIGN, _k + 1
ENDS = "\x00-\x1f0-9A-Z\xc0-\xde"


class Words:
    """Ids of texts by the tokenizers library. Where the file normalises and splits as usual, plain texts are split by their bytes' kinds and
    merged many at once by the other installed encoder: the file's ids follow the order of its merges, and a piece's last byte
    has a form of its own, as the file has tokens of its own for the ends of pieces. All else, and any other kind of
    file, goes to the library: neither the split nor the merges reach over a space or a line's end, so what stands between them is
    encoded once and looked up from then on."""

    MOST, LONGEST, AT_ONCE = 400_000, 48, 1 << 18

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.width, self.code = ("<u2", "H") if self.vocabulary <= 1 << 16 else ("<u4", "I")
        self.known, self.old = {"": b""}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        usual = (spec["normalizer"] or {}).get("normalizers") == NORMAL and split[0].get("pattern") == {"Regex": SPLIT} and [x["type"] for x in split] == ["Split", "ByteLevel"] and not split[1]["add_prefix_space"] and all(t["content"].startswith("<") for t in spec["added_tokens"])
        self.merge = self._merger(spec["model"]) if usual else None
        self.direct = self.merge is not None

    def _merger(self, model: dict):
        """An encoder of pieces whose last byte is a final one, where the file allows it. A zero byte is a piece of its own."""
        import tiktoken

        end = model["end_of_word_suffix"]
        inner, final = {}, {}
        for c in np.flatnonzero((KIND != SPACE) & (KIND != MARK)).tolist():
            raw, last = chr(INNER[c]).encode(), chr(FINAL[c]).encode()
            if KIND[c] != DIGIT:
                inner |= dict(zip(raw, raw, strict=True))
            final[raw[-1]] = last[-1]
        of, ranks = byte_letters(), {}
        for t, i in model["vocab"].items():
            ends = t.endswith(end) and t != end
            raw = [of[c] for c in (t[: -len(end)] if ends else t)]
            changed = [inner.get(x) for x in raw[:-1]] + [(final if ends else inner).get(raw[-1])]
            if None not in changed:
                ranks[bytes(changed)] = i
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or not {*inner.values(), *final.values()} <= {b[0] for b in ranks if len(b) == 1}:
            return None
        ranks[b"\0"] = self.vocabulary
        return tiktoken.Encoding("words", pat_str=f"[^{ENDS}]*[{ENDS}]", mergeable_ranks=ranks, special_tokens={"<": self.vocabulary + 1})

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts. A zero byte stands behind each text."""
        raw = ("\0".join(texts) + "\0\0\0").encode("latin-1")
        b, kind, low, final = (np.frombuffer(x, "u1") for x in (raw, *(raw.translate(t.tobytes()) for t in (KIND, INNER, FINAL))))
        ends = (kind == DIGIT) | (kind == MARK)
        ends[:-1] |= kind[1:] != kind[:-1]
        # Short forms such as 's and 'll, where a run of signs begins with the last of them.
        at = np.flatnonzero((b[:-2] == 39) & (kind[1:-1] == LETTER))
        if len(at):
            at = at[(at == 0) | (kind[at - 1] != SIGN)]
            one = np.isin(low[at + 1], np.frombuffer(b"stmd", "u1"))
            two = np.isin(low[at + 1].astype("i4") << 8 | low[at + 2], [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
            ends[at[one | two]] = False
            ends[at[one] + 1] = True
            ends[at[two] + 2] = True
        ids = self.merge.encode_to_numpy(np.where(ends, final, low)[:-2][kind[:-2] != SPACE].tobytes().decode("latin-1"), disallowed_special=())
        marks = np.flatnonzero(ids == self.vocabulary)
        return [x[1 if k else 0 :] for k, x in enumerate(np.split(ids.astype(self.width), marks)[:-1])]

    def _part(self, part: str) -> bytes:
        """What a part that isn't known gives. The parts of before the last time that the table was full are still looked up."""
        got = self.old.get(part)
        if got is None:
            if self.direct and PLAIN.fullmatch(part):
                got = self._plain([part])[0].tobytes()
            else:
                got = array(self.code, self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(part) <= self.LONGEST:
            if len(self.known) >= self.MOST:
                self.known, self.old = {"": b""}, self.known
            self.known[part] = got
        return got

    def _parts(self, text: str) -> np.ndarray:
        parts = text.replace("\n", " ").split(" ")
        got = list(map(self.known.get, parts))
        if None in got:
            for k in [k for k, x in enumerate(got) if x is None]:
                x = self.known.get(parts[k])
                got[k] = self._part(parts[k]) if x is None else x
        return np.frombuffer(b"".join(got), self.width)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        held, size = [], 0
        for k, x in enumerate(texts):
            if self.direct and PLAIN.fullmatch(x):
                held.append(k)
                size += len(x)
            else:
                out[k] = self._parts(x)
            if held and (size >= self.AT_ONCE or k == len(texts) - 1):
                for j, ids in zip(held, self._plain([texts[j] for j in held]), strict=True):
                    out[j] = ids
                held, size = [], 0
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


TOKENS = "doc_id long, uid long, n long, windows array<long>, first_window long, ids binary, terms binary, counts binary"


def tokens(df: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """(doc_id, uid, n, windows, first_window, ids, terms, counts) of (doc_id, text): the CRC-32 of each whole window of the document's ids and
    a number for the first of them, the ids after them, and all distinct ids with their frequencies. uid numbers the rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = words_of(path)
        end = np.array([end_id], t.width)
        cols: list[list] = [[] for _ in range(5)]
        first, made = [], made_by.setdefault(TaskContext.get().taskAttemptId(), [TaskContext.get().partitionId() << 36])
        for ids in t.encode_all([(x or b"").decode() for x in texts_of(batch.column(2))]):
            ids = np.concatenate([ids, end])
            cut = len(ids) // window * window
            terms, counts = np.unique(ids, return_counts=True)
            first.append(made[0])
            made[0] += cut // window
            for c, v in zip(cols, (len(ids), [crc(ids[k : k + window]) for k in range(0, cut, window)], ids[cut:].tobytes(), terms.tobytes(), counts.astype("<u4").tobytes()), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        n, windows, rest, terms, counts = (pa.array(c, k) for c, k in zip(cols, kinds, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, windows, pa.array(first, pa.int64()), rest, terms, counts], names=["doc_id", "uid", "n", "windows", "first_window", "ids", "terms", "counts"])

    made_by: dict[int, list[int]] = {}
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, TOKENS, most_rows=512)


def frequencies(made: DataFrame, path: str) -> tuple[np.ndarray, int, int]:
    """Documents that each id is in, documents, and ids, over all rows. Each task sends a row an id, so the driver gets the vocabulary."""

    def run(batches):
        t = words_of(path)
        docs, n, ids = np.zeros(t.vocabulary, "i8"), 0, 0
        for b in batches:
            n += b.num_rows
            ids += int(np.sum(b.column(0).to_numpy()))
            docs += np.bincount(np.frombuffer(b"".join(b.column(1).to_pylist()), t.width), minlength=t.vocabulary)
        at = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([n, ids, *docs[at].tolist()], pa.int64())], names=["id", "docs"])

    docs, n, ids = np.zeros(words_of(path).vocabulary, "i8"), 0, 0
    for r in small_batches(made).select("n", "terms").mapInArrow(run, "id long, docs long").groupBy("id").agg(F.sum("docs").alias("docs")).collect():
        if r["id"] == -1:
            n = r["docs"]
        elif r["id"] == -2:
            ids = r["docs"]
        else:
            docs[r["id"]] = r["docs"]
    return docs, n, ids


class Weights:
    """BM25 weights from counts over all documents."""

    def __init__(self, docs: np.ndarray, n: int, ids: int, shared: int = SHARED):
        self.idf = np.log1p((n - docs + 0.5) / (docs + 0.5))
        self.mean, self.shared = max(1.0, ids / max(1, n)), docs >= shared

    def of(self, terms: np.ndarray, counts: np.ndarray, length) -> np.ndarray:
        return self.idf[terms] * counts * (SATURATION + 1) / (counts + SATURATION * (1 - BY_LENGTH + BY_LENGTH * length / self.mean))

    def heaviest(self, terms: np.ndarray, counts: np.ndarray, length: int) -> tuple[int, int]:
        """The two heaviest terms that enough documents have, else any, and -1 where there are not two."""
        w = self.of(terms, counts, length)
        w = np.where(self.shared[terms], w, w - 1e6)
        first = int(w.argmax())
        if len(w) == 1:
            return int(terms[first]), -1
        w[first] = -np.inf
        return int(terms[first]), int(terms[int(w.argmax())])


class Index:
    """The inverted index of one shard: for each term the documents that have it, with their weights."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, weights: Weights):
        sizes = np.array([len(t) for t in terms])
        flat = np.concatenate(terms).astype("i8")
        value = weights.of(flat, np.concatenate(counts).astype("f8"), np.repeat(lengths, sizes))
        order = np.argsort(flat, kind="stable")
        self.docs, self.value = np.repeat(np.arange(len(terms)), sizes)[order], value[order]
        self.names, start = np.unique(flat[order], return_index=True)
        self.start, self.n = np.append(start, len(flat)), len(terms)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """The BM25 score of every document for a query of these terms, all of which the index has."""
        at = np.searchsorted(self.names, terms)
        lo, size = self.start[at], self.start[at + 1] - self.start[at]
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.docs[place], self.value[place], self.n)


def fill(lengths: list[int], terms: list[np.ndarray], index: Index, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start in it, length) that hold each document once, all full but the last ones, which are powers of two."""
    unused, out = np.ones(len(lengths), bool), []
    following, seed, start = 0, -1, 0
    while True:
        if seed < 0:
            while following < len(lengths) and not unused[following]:
                following += 1
            if following == len(lengths):
                break
            seed, start = following, 0
            unused[seed] = False
        now, room = [(seed, start, lengths[seed] - start)], window - lengths[seed] + start
        if room:
            score = index.scores(terms[seed])
            left = np.flatnonzero(unused)
            seed = -1
            for k in left[np.argsort(-score[left], kind="stable")].tolist():
                take = min(room, lengths[k])
                now.append((k, 0, take))
                unused[k] = False
                room -= take
                if not room:
                    if take < lengths[k]:
                        seed, start = k, take
                    break
        else:
            seed = -1
        out.append(now)
    if out and sum(p[2] for p in out[-1]) < window:
        out += powers(out.pop())
    return out


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces in order, cut into sequences of falling powers of two."""
    total, out = sum(p[2] for p in pieces), []
    rest = iter(pieces)
    k, at, n = next(rest)
    for bit in range(total.bit_length() - 1, -1, -1):
        need = total & 1 << bit
        if not need:
            continue
        now = []
        while need:
            if not n:
                k, at, n = next(rest)
            take = min(need, n)
            now.append((k, at, take))
            need, at, n = need - take, at + take, n - take
        out.append(now)
    return out


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def shards(path: str, weights: Weights, window: int, size: int):
    """Over sorted rows (doc_id, n, ids, terms, counts): each shard's pieces. A shard ends once it holds `size` ids and terms."""

    def pack(rows: list[dict], width: str, number: int) -> pa.RecordBatch:
        ids = [np.frombuffer(r["ids"], width) for r in rows]
        terms, counts = [np.frombuffer(r["terms"], width) for r in rows], [np.frombuffer(r["counts"], "<u4") for r in rows]
        index = Index(terms, counts, np.array([r["n"] for r in rows], "f8"), weights)
        cols: list[list] = [[] for _ in range(7)]
        for k, sequence in enumerate(fill([len(x) for x in ids], terms, index, window)):
            offset = 0
            for i, start, length in sequence:
                r = rows[i]
                for c, v in zip(cols, (r["doc_id"], r["n"] - len(ids[i]) + start, length, crc(ids[i][start : start + length]), r["n"], number + k, offset), strict=True):
                    c.append(v)
                offset += length
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in OUT.split(", ")])

    def run(batches):
        width, number = words_of(path).width, TaskContext.get().partitionId() << 40
        held, total = [], 0
        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                total += (len(r["ids"]) + len(r["terms"])) // np.dtype(width).itemsize
                if total >= size:
                    made = pack(held, width, number)
                    number += made.num_rows
                    held, total = [], 0
                    yield made
        if held:
            yield pack(held, width, number)
        tidy()

    return run


def pack_related(df: DataFrame, path: str, window: int = 4096, end_id: int = 2, shard: int = SHARD, shared: int = SHARED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of (doc_id, text), each document's
    ids with end_id behind them.

    A null or empty text is the end id alone. Each row is a document: rows that repeat are packed each, a null doc_id stays null. A document
    longer than a window fills whole ones by itself. Ties of scores go to the document that is first in the order of the shard. Sequences are
    full, but for the last ones of a shard, which have powers of two as lengths, so nothing needs padding. An empty table gives an
    empty result. Other columns are ignored."""
    made, _ = materialize(tokens(df, path, window, end_id), "tokens")
    weights = Weights(*frequencies(made, path), shared)

    def route(batches):
        t = words_of(path)
        for b in batches:
            pairs = [weights.heaviest(np.frombuffer(x, t.width), np.frombuffer(c, "<u4").astype("f8"), n) for x, c, n in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32())], names=[*b.schema.names, "heaviest", "next"])

    rests = small_batches(made.filter(F.length("ids") > 0).select("doc_id", "uid", "n", "ids", "terms", "counts"))
    routed = rests.mapInArrow(route, "doc_id long, uid long, n long, ids binary, terms binary, counts binary, heaviest int, next int").withColumn("deal", F.xxhash64("uid"))
    order = ["heaviest", "next", "deal", "uid"]
    short = routed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "ids", "terms", "counts").mapInArrow(shards(path, weights, window, shard), OUT)

    # Windows that one document fills have numbers below zero.
    long = made.filter(F.size("windows") > 0).select("doc_id", "n", "first_window", F.posexplode("windows").alias("place", "crc"))
    place = F.col("place").cast("long")
    full = long.select("doc_id", (place * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (-1 - F.col("first_window") - place).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full)

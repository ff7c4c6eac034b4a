"""Byte-level BPE as a deterministic tokenization automaton.

Merges are compiled one by one. The automaton starts as one state with an arc to itself for each byte. The gadget of
a merge (u, v) redirects all arcs u to a copy of their target without the arc v, and adds an arc uv, to v's target,
beside every arc u. All arcs with one label have one target throughout, so a state is kept as (parent, label removed,
time), the arcs of a state follow from its chain of parents, and rows of the transition table are filled as they are
first used. A path's arc labels spell a text exactly if they are its BPE tokens.

Words are read a byte at a time. A second table, compiled from the labels, goes from (longest label that may be under way,
byte) to the next such place and names the labels that end there. Each prefix of a word has one path, so of those labels one
alone has an arc from the state in which it would begin; that one is noted, and the word's labels are read off from its end.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

NEVER = 1 << 60
#: White space of the pre-split, Unicode's White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _class(major: str) -> str:
    """A regular expression's character ranges for all characters of a Unicode major category."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def splitter() -> re.Pattern:
    letter, number = _class("L"), _class("N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


#: White space of the pre-split, as characters.
SPACES = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c)))


def by_single_spaces(text: str, known: dict[str, bytes], spaced, whole) -> bytes:
    """The ids of a text. Where each space stands alone between two other characters, the pre-split cuts before it, so what
    follows a space is looked up in known, and else made by spaced(part); the rest, or any other text, by whole(text)."""
    head, *parts = text.split(" ")
    if not parts:
        return whole(text)
    got = list(map(known.get, parts))
    if not head or head[-1] in SPACES:
        return whole(text)
    for i in [k for k, x in enumerate(got) if x is None] if None in got else ():
        p = parts[i]
        if p and p[0] not in SPACES and p[-1] not in SPACES:
            got[i] = spaced(p)
        elif p and p[0] not in SPACES and i == len(parts) - 1:
            got[i] = whole(" " + p)
        else:
            return whole(text)
    return b"".join([whole(head), *got])


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: itself, or the next free one from 256."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    free = count(256)
    return {chr(b if b in plain else next(free)): b for b in range(256)}


class Automaton:
    """Compiled merges. encode() takes pre-split words; split() and decode() work on whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        raw = lambda s: bytes(of[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.labels = [b""] * size
        for t, i in self.ids.items():
            self.labels[i] = t
        for t, i in self.special.items():
            self.labels[i] = t.encode()
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._compile([tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]], raw)
        self._compile_bytes()
        self.known: dict[str, bytes] = {}  # ids by pre-split word
        self.parts: dict[str, bytes] = {}  # ids by what follows a single space, with the space

    def _compile(self, merges: list[tuple[str, str]], raw) -> None:
        n = len(self.labels)
        self.made = [-1] * n  # when a label's arcs were added
        self.first = [-1] * n  # the label that the arcs were added beside
        self.parent, self.removed, self.time = [-1], [-1], [-1]  # by state
        self.target = [0] * n  # the state that a label's arcs lead to
        self.table: dict[int, bool] = {}
        for k, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            u, v, uv = self.ids[a], self.ids[b], self.ids[a + b]
            if self.made[uv] >= 0:  # a second way to an existing label adds no arc
                continue
            after = self.target[v]
            self.parent.append(self.target[u])
            self.removed.append(v)
            self.time.append(k)
            self.target[u] = len(self.parent) - 1
            self.made[uv], self.first[uv], self.target[uv] = k, u, after
        # Unbranched chains of states share one dictionary, label removed -> time, that a state reads up to its own time.
        self.segment = [0] * len(self.parent)
        ends: dict[int, int] = {0: 0}
        own: list[dict[int, int]] = [{}]
        link = [(-1, -1)]  # of a segment: the segment it leaves and until when
        for s in range(1, len(self.parent)):
            p = self.parent[s]
            if p and ends[self.segment[p]] == p:
                g = self.segment[p]  # the chain goes on
            else:
                g = len(own)
                own.append({})
                link.append((self.segment[p], self.time[p]))
            own[g][self.removed[s]] = self.time[s]
            self.segment[s], ends[g] = g, s
        self.own, self.link = own, link

    def _lost(self, state: int, label: int) -> int:
        """When the arc was removed on the way from the first state to this one; NEVER if it wasn't."""
        g, until = self.segment[state], self.time[state]
        while g >= 0:
            t = self.own[g].get(label, NEVER)
            if t <= until:
                return t
            g, until = self.link[g]
        return NEVER

    def allowed(self, last: int, label: int) -> bool:
        """Whether the state after the label last has an arc with this label."""
        key = last << 32 | label
        got = self.table.get(key)
        if got is None:
            state, by, x, got = self.target[last], NEVER, label, True
            while x >= 0:
                if self._lost(state, x) <= (by if by < NEVER else NEVER - 1):
                    got = False
                    break
                by, x = self.made[x], self.first[x]
            if len(self.table) > 4_000_000:
                self.table.clear()
            self.table[key] = got
        return got

    def _compile_bytes(self) -> None:
        """The trie of the labels as a table (place << 8 | byte) -> place, with each place's longest proper suffix in the trie and
        the labels that end there, the longest first."""
        down: dict[int, int] = {}
        own, level = [-1], [0]
        for t, i in sorted(self.ids.items(), key=lambda x: x[1]):
            at = 0
            for b in t:
                nxt = down.get(at << 8 | b)
                if nxt is None:
                    nxt = down[at << 8 | b] = len(own)
                    own.append(-1)
                    level.append(level[at] + 1)
                at = nxt
            own[at] = i
        size = [len(x) for x in self.labels]
        suffix = [0] * len(own)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        for key, to in sorted(down.items(), key=lambda x: level[x[1]]):  # shorter places first
            at, b = key >> 8, key & 255
            if at:
                f = suffix[at]
                while f and f << 8 | b not in down:
                    f = suffix[f]
                suffix[to] = down.get(f << 8 | b, 0)
            ends[to] = (((own[to], size[own[to]]),) if own[to] >= 0 else ()) + ends[suffix[to]]
        self.down, self.suffix, self.ends = down, suffix, ends

    def step(self, place: int, byte: int) -> int:
        """The next place, by way of suffixes where the trie has none; entered in the table, which has as many entries as places
        and bytes at most."""
        got = self.down.get(place << 8 | byte)
        if got is None:
            got = self.down[place << 8 | byte] = self.step(self.suffix[place], byte) if place else 0
        return got

    def walk(self, word: bytes) -> list[int]:
        """The arc labels of the only path that spells the word, one look at each byte."""
        last, begins = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        down, ends, allowed, place = self.down.get, self.ends, self.allowed, 0
        for j, b in enumerate(word, 1):
            nxt = down(place << 8 | b)
            place = self.step(place, b) if nxt is None else nxt
            for t, n in ends[place]:
                i = j - n
                if not i or allowed(last[i], t):
                    last[j], begins[j] = t, i
                    break
        out, j = [], len(word)
        while j:
            out.append(last[j])
            j = begins[j]
        return out[::-1]

    def forget(self) -> None:
        """Empty the tables of words met."""
        self.known.clear()
        self.parts.clear()

    def word(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = id_bytes(self.walk(word.encode()))
            if len(word) <= 48:
                if len(self.known) >= 300_000:
                    self.known.clear()
                self.known[word] = got
        return got

    def piece(self, text: str) -> bytes:
        """A text without special tokens, by its pre-split words."""
        return b"".join(map(self.word, splitter().findall(text)))

    def spaced(self, part: str) -> bytes:
        got = self.piece(" " + part)
        if len(part) <= 48:
            if len(self.parts) >= 600_000:
                self.parts.clear()
            self.parts[part] = got
        return got

    def plain(self, text: str) -> bytes:
        return by_single_spaces(text, self.parts, self.spaced, self.piece)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The arc labels joined; malformed UTF-8 becomes replacement characters."""
        raw = b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(4)
def automaton(path: str) -> Automaton:
    return Automaton(path)


def encode_documents(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and ids (array<int>): the tokens of each whole text. A null text counts as empty; rows may
    repeat, ids of any column of keep may be null, other columns of df are left out."""
    cols = [c for c in dict.fromkeys(keep) if c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols), "ids array<int>"])

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        a = automaton(path)
        got = [a.encode((t or b"").decode()) for t in texts_of(b.column(len(cols)))]
        ends = np.cumsum([0, *(len(x) // 4 for x in got)]).astype("i4")
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))
        return pa.RecordBatch.from_arrays([*b.columns[: len(cols)], ids], names=[*cols, "ids"])

    return map_batches(df.select(*cols, F.col(text).alias("\x00text")), fn, schema, "\x00text")


def decode_documents(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and text: the arc labels of ids (null: empty) joined."""
    cols = [c for c in dict.fromkeys(keep) if c != ids]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols), "text string"])

    def run(batches):
        a = automaton(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = [a.decode(np.array(x or [], "<u4").tobytes()).decode() for x in b.column(len(cols)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(texts, pa.string())], names=[*cols, "text"])

    return df.select(*cols, F.col(ids).cast("array<int>").alias("\x00ids")).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each text of (doc_id, text) and returns digests of both: doc_id, n_tokens, ids_sha256 (of the
    little-endian ids), decoded_sha256. A null text counts as empty; a repeated row gives a repeated result."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        a, sha = automaton(path), hashlib.sha256
        ids = [a.encode((t or b"").decode()) for t in texts_of(b.column(1))]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids]), pa.array([sha(a.decode(x)).hexdigest() for x in ids])],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", last=lambda: automaton(path).forget())

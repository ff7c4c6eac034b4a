"""Language identification by word scores and a Viterbi path.

A word's script (ranges of code points) narrows the languages that it can be in. Its score for a language is the
logarithm of the likelihood of its character n-grams (1 to 4 bytes, in one table of hashed slots). The path through the
languages with the largest sum of word scores, less a penalty for each switch, labels spans of the text. Where one
language all through is such a path, which sums tell, no path is searched.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small_batches, texts_of, tidy

#: Documents of each language that the table is counted from (in expectation), n-gram sizes, nats for a switch.
SAMPLE, SIZES, SWITCH = 2_000, (1, 2, 3, 4), 8.0
#: Slots of the table: up to 128 languages all of them, for more fewer, so that the table has 32 MB (up to 2048 languages).
SLOTS, CELLS, LEAST_SLOTS = 1 << 16, 1 << 23, 1 << 12
#: Floats that are gathered or stepped through at once, and floats of kept word scores, in a task.
STEP, KEPT = 1 << 20, 1 << 22
#: A language can be in a script that at least this share of its words is in.
SCRIPT_SHARE = 1e-3
#: First code point of ranges of scripts, "" for what tells nothing.
SCRIPTS = [
    (0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, ""), (0x900, "Devanagari"),
    (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"),
    (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, ""), (0x1780, "Khmer"), (0x1800, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0x20000, "Han"), (0x30000, ""),
]
NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = [c for c, _ in SCRIPTS]

#: ASCII letters in lower case and bytes beyond ASCII stay; all else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def has_letter(text: bytes) -> bool:
    folded = text.translate(_FOLD)
    return bool(folded.strip()) and (any(b < 128 for b in folded.split(None, 1)[0]) or any(c.isalpha() for c in text.decode()))


def script(word: bytes) -> int:
    """Place in NAMES of the script of the word's first letter beyond ASCII, else Latin."""
    if not word.isascii():
        for c in word.decode("utf-8", "replace"):
            if c > "\x7f" and c.isalpha():
                return NAMES.index(SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1])
    return NAMES.index("Latin")


def slots_for(languages: int) -> int:
    n = SLOTS
    while n > LEAST_SLOTS and n * languages > CELLS:
        n //= 2
    return n


def grams(words: list[bytes], slots: int = SLOTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size its slots in the order of the words, and the place of each one's word."""
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    gap = b == 32
    word = np.cumsum(gap, dtype=np.int32) - 1
    out, h = [], np.zeros(len(b), np.uint32)
    inner = np.zeros(len(b), bool)
    for n in range(1, max(SIZES) + 1):
        m = len(b) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.int32)))
            continue
        h = (h[:m] * np.uint32(0x01000193)) ^ (b[n - 1 :] + np.uint32(n * 256))
        if n == 1:
            ok = ~gap
        elif n == 2:
            ok = ~(gap[:m] & gap[1:])
        else:  # a space only at the ends
            inner = inner[:m] | gap[n - 2 : n - 2 + m]
            ok = ~inner
        mixed = h[ok] * np.uint32(0x9E3779B1)
        out.append(((mixed >> np.uint32(16)).astype(np.int32) % slots, word[:m][ok]))
    return out


def chunks(words: list[bytes], most: int) -> list[tuple[int, int]]:
    """Ranges of words with about `most` bytes each (a longer word is alone)."""
    out, lo, total = [], 0, 0
    for i, n in enumerate(map(len, words)):
        if i > lo and total + n > most:
            out.append((lo, i))
            lo, total = i, 0
        total += n + 1
    return [*out, (lo, len(words))] if words else out


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # slots x languages: log likelihood
    fits: np.ndarray  # scripts x languages

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """words x languages: scores, the best 0; languages that the script rules out far below. STEP floats are gathered at once."""
        k = len(self.names)
        out = np.zeros((len(words), k), "f4")
        if not k:
            return out
        step = max(1, STEP // k)
        for a, z in chunks(words, step):
            s = out[a:z]
            for slots, of in grams(words[a:z], len(self.table)):
                for lo in range(0, len(slots), step):
                    w = of[lo : lo + step]
                    first = np.flatnonzero(np.diff(w, prepend=-1))
                    s[w[first]] += np.add.reduceat(self.table[slots[lo : lo + step]], first) / 2
            s -= s.max(1, keepdims=True)
            np.maximum(s, -20, out=s)
            s[~self.fits[np.fromiter(map(script, words[a:z]), "i8", z - a)]] = -40.0
        return out

    def paths(self, scores: list[np.ndarray], switch: float = SWITCH, cells: int = STEP // 4) -> list[list[tuple[int, int, int]]]:
        """spans_of for texts whose words' scores (words x languages) are given."""
        ends = np.cumsum([len(s) for s in scores])
        return self.spans_of([np.arange(e - len(s), e) for s, e in zip(scores, ends, strict=True)], np.concatenate(scores), switch, cells)

    def spans_of(self, ids: list[np.ndarray], scores: np.ndarray, switch: float = SWITCH, cells: int = STEP // 4) -> list[list[tuple[int, int, int]]]:
        """For each text, given as places of its words in scores (words x languages), the spans (first word, end, language)
        of its best path."""
        out: list = [[] for _ in ids]
        left = []
        for i, at in enumerate(ids):
            if not len(at):
                continue
            one = self._alone(at, scores, switch)
            if one is not None:
                out[i] = [(0, len(at), one)]
            else:
                left.append(i)
        left.sort(key=lambda i: -len(ids[i]))
        cells = max(1, cells // max(1, len(self.names)))
        while left:  # texts of like length side by side, as many as the longest allows
            n = max(1, cells // len(ids[left[0]]))
            now, left = left[:n], left[n:]
            for i, labels in zip(now, _best_paths([ids[i] for i in now], scores, switch), strict=True):
                cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                out[i] = [(lo, hi, int(labels[lo])) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        return out

    def _alone(self, at: np.ndarray, scores: np.ndarray, switch: float) -> int | None:
        """The language of a text in which no run of words gains more than half a switch's penalty in another one, so that no
        path of several languages gains; else None."""
        step = max(1, STEP // scores.shape[1])
        parts = [at[lo : lo + step] for lo in range(0, len(at), step)]
        one = int(sum(scores[p].sum(0, dtype="f8") for p in parts).argmax())
        total = least = np.zeros(scores.shape[1])
        for p in parts:
            s = scores[p]
            c = np.cumsum(s - s[:, one : one + 1], axis=0, dtype="f8") + total
            low = np.minimum(np.minimum.accumulate(c, axis=0), least)
            if float((c - low).max()) > switch / 2:
                return None
            total, least = c[-1], low[-1]
        return one


def _best_paths(ids: list[np.ndarray], scores: np.ndarray, switch: float) -> list[np.ndarray]:
    """Viterbi over several texts at once, a step a word; the first text is the longest. Behind a text's end all languages score
    0, so that its path stays. Whether a language's path stays is kept as bits."""
    n, m, k = len(ids[0]), len(ids), scores.shape[1]
    block = max(1, STEP // 16 // (m * k))
    rows = np.arange(m)
    best = np.zeros((m, k))
    stays, tops = np.zeros((n, m, -(-k // 8)), "u1"), np.zeros((n, m), np.int16)
    for lo in range(0, n, block):
        s = np.zeros((min(block, n - lo), m, k))
        for j, x in enumerate(ids):
            own = x[lo : lo + block]
            s[: len(own), j] = scores[own]
        own = np.zeros(s.shape, bool)
        for t in range(len(s)):
            if lo or t:
                top = best.argmax(1)
                least = (best[rows, top] - switch)[:, None]
                np.greater_equal(best, least, out=own[t])
                tops[lo + t] = top
                np.maximum(best, least, out=best)
            best += s[t]
        stays[lo : lo + len(s)] = np.packbits(own, axis=2, bitorder="little")
    labels = np.zeros((n, m), np.int16)
    now = labels[n - 1] = best.argmax(1)
    for t in range(n - 1, 0, -1):
        now = np.where(stays[t][rows, now >> 3] >> (now & 7) & 1, now, tops[t])
        labels[t - 1] = now
    return [labels[: len(x), j] for j, x in enumerate(ids)]


class Labeller:
    """Spans of texts; scores of words are kept from text to text, up to KEPT floats besides those of the texts at hand."""

    def __init__(self, model: Languages, most: int = 200_000):
        self.model, self.most = model, max(1, min(most, KEPT // max(1, len(model.names))))
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = defaultdict(count().__next__)
        self.scores = np.zeros((0, len(self.model.names)), "f4")

    def label(self, texts: list[bytes | None]) -> list[tuple[str, float, list[tuple[int, int, int]], list[bytes]]]:
        """(language or und, share of the letters in it, spans, words) of each text."""
        words = [words_of(t or b"") for t in texts]
        if len(self.place) + sum(map(len, words)) > 2 * self.most:
            self._clear()
        place, known = self.place, len(self.place)
        at = [np.fromiter((place[w] for w in ws), "i4", len(ws)) for ws in words]
        if len(place) > known:
            need = len(place)
            if need > len(self.scores):
                grown = np.zeros((need + need // 4, self.scores.shape[1]), "f4")
                grown[:known] = self.scores[:known]
                self.scores = grown
            self.scores[known:need] = self.model.word_scores(list(islice(place, known, None)))
        out = []
        named = [bool(ws) and bool(self.model.names) and has_letter(t) for t, ws in zip(texts, words, strict=True)]
        paths = self.model.spans_of([ids if ok else ids[:0] for ids, ok in zip(at, named, strict=True)], self.scores)
        for ws, ok, spans in zip(words, named, paths, strict=True):
            if not ok:
                out.append(("und", 0.0, [], ws))
                continue
            if len(spans) == 1:
                out.append((self.model.names[spans[0][2]], 1.0, spans, ws))
                continue
            letters = [0] * len(self.model.names)
            for lo, hi, x in spans:
                letters[x] += sum(map(len, ws[lo:hi]))
            x = letters.index(max(letters))
            out.append((self.model.names[x], letters[x] / sum(letters), spans, ws))
        return out


def learn(docs: DataFrame, learns: Column, sample: int = SAMPLE) -> Languages:
    """Counts n-grams in documents (doc_id, text, lang) that `learns` accepts and that have a language: of each language a
    share by a hash of doc_id that gives `sample` documents in expectation. No document gives no languages."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learns).select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    names = sorted(sizes)
    n_slots = slots_for(len(names))
    if not names:
        return Languages([], np.zeros((n_slots, 0), "f4"), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*(F.lit(x) for n in names for x in (n, int(2**31 * min(1.0, sample / sizes[n])))))
    chosen = known.filter(F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(3)), F.lit(2**31)) < share[F.col("lang")])

    def fn(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                ws = words_of(t)
                if ws:
                    own = total.setdefault(lang, np.zeros(n_slots + len(NAMES), "i8"))
                    for slots, _ in grams(ws, n_slots):
                        own[:n_slots] += np.bincount(slots, minlength=n_slots)
                    own[n_slots:] += np.bincount([script(w) for w in ws], minlength=len(NAMES))
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype("i4")), pa.array(own[at])], names=["lang", "slot", "n"])

    counts = chosen.select("text", "lang").repartition(2 * len(names)).mapInArrow(fn, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    tally = np.zeros((n_slots + len(NAMES), len(names)))
    np.add.at(tally, (counts["slot"].to_numpy(), np.searchsorted(names, counts["lang"].to_pylist())), counts["n"].to_numpy())
    letters, scripts = tally[:n_slots], tally[n_slots:]
    table = np.log((letters + 0.3) / (letters.sum(0) + 0.3 * n_slots))
    fits = scripts > SCRIPT_SHARE * np.maximum(1, scripts.sum(0))
    fits[~fits.any(1)] = True  # a script that no language was seen in rules none out
    fits[NAMES.index("")] = True
    return Languages(names, table.astype("f4"), fits)


def identify(docs: DataFrame, model: Languages, keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """The columns keep, lang_pred (und if text is null or has no letter), score (the share of the letters labelled so, 0
    for und) and, if asked for, spans (array of first_word, end_word, lang), of each whole text. Ties go to the first
    language by name; a repeated row gives a repeated result; an empty table gives an empty one."""
    extra = ", spans array<struct<first_word:int,end_word:int,lang:string>>" if spans else ""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"lang_pred string, score double{extra}"])
    cols = [F.col(c) for c in keep] + ([] if "text" in keep else [F.col("text").cast("string").alias("\x00text")])
    at, name = (keep.index("text"), "text") if "text" in keep else (len(keep), "\x00text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CELLS floats, or LEAST_SLOTS a language beyond 2048 of them

    most = max(1 << 20, min(4 << 20, (16 << 20) // max(1, len(model.names))))  # text bytes at once

    def run(batches):
        own = Labeller(sent.value)
        for b in rows_of(batches, name, most):
            got = own.label(texts_of(b.column(at)))
            made = [pa.array([g[0] for g in got], pa.string()), pa.array([min(1.0, max(0.0, g[1])) for g in got], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))
                made.append(pa.array([[{"first_word": lo, "end_word": hi, "lang": own.model.names[x]} for lo, hi, x in g[2]] for g in got], kind))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=[*keep, "lang_pred", "score", *(["spans"] if spans else [])])
        del own
        tidy()

    return small_batches(docs.select(*cols)).mapInArrow(run, schema)

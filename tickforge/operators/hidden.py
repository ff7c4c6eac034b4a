"""Hidden states of a symbol's log returns: a Gaussian hidden Markov model whose passes are scans of small matrices.

A bar takes the row of state probabilities before it to the one after it by a matrix: the transitions times the densities of its return.
Such matrices multiply associatively, so a symbol's bars are cut into blocks of positions, and each block alone gives its product. A
scan over the products, a few numbers a block, gives the probabilities that come into a block from before and from behind;
with these the blocks give their parts of all sums that a step of expectation maximisation needs. So one symbol's bars
use as many tasks as they have blocks. Inside a block the same cut is made again, into lanes that numpy runs side by side.

A bar without a return (the first one, or a price that has no logarithm) has no probabilities, and the chain starts anew after it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path

#: Positions of a block, and the most models that are sent to all executors at once (some hundred bytes each).
BLOCK, NEAR_MODELS = 1 << 16, 50_000


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def pack(self) -> bytes:
        return np.concatenate([self.start, self.step.ravel(), self.mean, self.var]).astype("<f8").tobytes()

    @staticmethod
    def unpack(data: bytes) -> Model:
        a = np.frombuffer(data, "<f8")
        k = int(math.isqrt(len(a) + 2)) - 1  # k k + 3 k numbers
        return Model(a[:k], a[k : k + k * k].reshape(k, k), a[-2 * k : -k], a[-k:])

    def ordered(self) -> Model:
        o = np.argsort(self.var, kind="stable")
        return Model(self.start[o], self.step[o][:, o], self.mean[o], self.var[o])

    def matrices(self, x: np.ndarray, before: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """A matrix for each bar (of densities relative to the likeliest state, never quite 0), which bars start the chain anew, and the
        logarithm of what the densities were divided by. before: whether the bar before x has a return."""
        good = np.isfinite(x)
        log = -0.5 * ((np.where(good, x, 0.0)[:, None] - self.mean) ** 2 / self.var + np.log(2 * math.pi * self.var))
        top = log.max(1)
        density = np.maximum(np.exp(log - top[:, None]), 1e-200)
        fresh = good & ~np.concatenate([[before], good[:-1]])
        out = self.step[None] * density[:, None, :]
        out[fresh] = (self.start * density[fresh])[:, None, :]
        out[~good] = np.eye(len(self.mean))
        return out, fresh, float(top[good].sum())


def product(t: np.ndarray) -> np.ndarray:
    """The product of matrices in their order, up to a factor."""
    one = np.eye(t.shape[1])[None]
    while len(t) > 1:
        if len(t) % 2:
            t = np.concatenate([t, one])
        t = t[0::2] @ t[1::2]
        t = t / t.max((1, 2), keepdims=True)
    return t[0] if len(t) else one[0]


def carried(rows: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row vector after each matrix, scaled to a sum of 1, from rows before the first; and the logarithms of the scales. Lanes of
    consecutive matrices run side by side once the vectors that enter them are known from the lanes' products."""
    n, k = len(t), t.shape[1]
    width = max(1, math.isqrt(n))
    lanes = -(-n // width) if n else 0
    t = np.concatenate([t, np.broadcast_to(np.eye(k), (lanes * width - n, k, k))]).reshape(lanes, width, k, k)
    whole = np.broadcast_to(np.eye(k), (lanes, k, k))
    for j in range(width):
        whole = whole @ t[:, j]
        whole = whole / whole.max((1, 2), keepdims=True)
    p = np.empty((lanes, k))
    for i in range(lanes):
        p[i] = rows if i == 0 else p[i - 1] @ whole[i - 1]
        p[i] /= p[i].sum()
    out, scale = np.empty((lanes, width, k)), np.empty((lanes, width))
    for j in range(width):
        p = (p[:, None, :] @ t[:, j])[:, 0]
        scale[:, j] = p.sum(1)
        p = p / scale[:, j, None]
        out[:, j] = p
    return out.reshape(-1, k)[:n], np.log(scale.reshape(-1)[:n])


def expected(m: Model, x: np.ndarray, before: bool, entry: np.ndarray, exit_: np.ndarray, centre: float) -> np.ndarray:
    """A block's part of the sums: likelihood (logarithm), starts, moves, and the weight, first and second moment of each state about
    centre. entry, exit_: what comes into the block from before and from behind."""
    k = len(m.mean)
    t, fresh, log = m.matrices(x, before)
    ahead, scales = carried(entry, t)
    behind = np.concatenate([carried(exit_, t[::-1].transpose(0, 2, 1))[0][::-1][1:], exit_[None] / exit_.sum()]) if len(t) else ahead
    good = np.isfinite(x)
    weight = np.where(good[:, None], ahead * behind, 0.0)
    weight[good] /= weight[good].sum(1, keepdims=True)
    moves = np.concatenate([entry[None] / entry.sum(), ahead[:-1]])[:, :, None] * t * behind[:, None, :]
    moves = moves[good & ~fresh]
    d = np.where(good, x, centre) - centre
    return np.concatenate([[log + scales.sum()], weight[fresh].sum(0), (moves / moves.sum((1, 2), keepdims=True)).sum(0).ravel(), weight.sum(0), d @ weight, (d * d) @ weight]) if k else np.zeros(1)


def updated(m: Model, sums: np.ndarray, centre: float, least_var: float) -> Model:
    """The model that the sums make likeliest. A state without weight stays as it is; no transition is ever quite impossible."""
    k = len(m.mean)
    starts, moves, (weight, first, second) = sums[1 : 1 + k], sums[1 + k : 1 + k + k * k].reshape(k, k), sums[1 + k + k * k :].reshape(3, k)
    moves = np.where(moves.sum(1, keepdims=True) > 0, moves, m.step) + 1e-12
    alive = weight > 1e-12
    mean = np.where(alive, first / np.where(alive, weight, 1.0), m.mean - centre)
    var = np.where(alive, second / np.where(alive, weight, 1.0) - mean**2, m.var)
    start = (starts if starts.sum() > 0 else m.start) + 1e-12
    return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), mean + centre, np.maximum(var, least_var))


def first_models(states: int, n: float, mean: float, var: float, least_var: float) -> list[Model]:
    """Where a fit begins: states that differ in spread, and states that differ in level, both slow to change. Without a value for
    each state all states are alike."""
    k, var = states, max(var, least_var)
    flat = np.full(k, 1 / k)
    if n < k:
        return [Model(flat, np.full((k, k), 1 / k), np.full(k, mean), np.full(k, var if n else 1.0))]
    slow = np.full((k, k), 0.1 / (k - 1))
    np.fill_diagonal(slow, 0.9)
    place = np.arange(k) - (k - 1) / 2
    return [Model(flat, slow, np.full(k, mean), np.maximum(var * 4.0**place, least_var)), Model(flat, slow, mean + 3 * math.sqrt(var) * place / k, np.full(k, max(var / 2, least_var)))]


def fit_returns(x: np.ndarray, states: int = 2, rounds: int = 50, tolerance: float = 1e-4, least_var: float = 1e-12) -> Model:
    """The likeliest of the fits of one block, states by rising variance. A fit ends once a round adds less than tolerance to the
    logarithm of the likelihood."""
    good = x[np.isfinite(x)]
    centre = float(good.mean()) if len(good) else 0.0
    every = first_models(states, len(good), centre, float(good.var()) if len(good) else 0.0, least_var)
    if len(every) == 1:
        return every[0]
    fits = []
    for m in every:
        before = -math.inf
        for _ in range(rounds):
            sums = expected(m, x, False, m.start, np.ones(states), centre)
            m = updated(m, sums, centre, least_var)
            if sums[0] - before < tolerance:
                break
            before = sums[0]
        fits.append((float(sums[0]), m))
    return max(fits, key=lambda f: f[0])[1].ordered()


def filtered(m: Model, x: np.ndarray, before: bool = False, entry: np.ndarray | None = None) -> np.ndarray:
    """State probabilities of each bar given the past alone; not a number where there is no return."""
    p = carried(m.start if entry is None else entry, m.matrices(x, before)[0])[0]
    p[~np.isfinite(x)] = np.nan
    return p


PACKED = "symbol string, block long, before boolean, pos binary, x binary"


def packed(bars: DataFrame, block: int) -> DataFrame:
    """A row for each block of a symbol's positions (dense ones): the returns of its bars, and whether the bar before has one. The two bars before a
    block come with it, so no window runs over a symbol."""
    own = F.floor(F.col("pos") / block).cast("long")
    both = F.when(F.col("pos") % block >= block - 2, F.array(own, own + 1)).otherwise(F.array(own))
    rows = bars.select("symbol", F.col("pos").cast("long").alias("pos"), F.col("close").cast("double").alias("close"), F.explode(both).alias("block"))

    def run(key, t):
        t = t.sort_by("pos")
        pos, close = t["pos"].to_numpy(), t["close"].to_numpy()
        with np.errstate(all="ignore"):
            x = np.concatenate([[np.nan], np.where(np.diff(pos) == 1, np.diff(np.log(close)), np.nan)])
        mine = pos // block == key[1].as_py()
        if not mine.any():
            return t.select([]).from_pydict({"symbol": pa.array([], pa.string()), "block": pa.array([], pa.int64()), "before": pa.array([], pa.bool_()), "pos": pa.array([], pa.binary()), "x": pa.array([], pa.binary())})
        halo = x[~mine]
        return pa.table({"symbol": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "before": pa.array([bool(len(halo) and np.isfinite(halo[-1]) and pos[mine][0] - pos[~mine][-1] == 1)]), "pos": pa.array([pos[mine].astype("<i8").tobytes()], pa.binary()), "x": pa.array([x[mine].astype("<f8").tobytes()], pa.binary())})

    return rows.groupBy("symbol", "block").applyInArrow(run, PACKED)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _near(df: DataFrame) -> DataFrame:
    """Models go to all executors while they are few; many are joined by symbol, which then deals the work."""
    return F.broadcast(df) if df.count() <= NEAR_MODELS else df


def _rows(fn, names: list[tuple[str, pa.DataType]]):
    """A function for mapInArrow that gives fn's tuples for each row."""

    def run(batches):
        for b in batches:
            got = [out for r in b.to_pylist() for out in fn(r)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, (_, t) in enumerate(names)], names=[n for n, _ in names])

    return run


_KEY = [("symbol", pa.string()), ("fit", pa.int32())]


def _ends(met: DataFrame) -> DataFrame:
    """(symbol, fit, block, entry, exit_) of blocks with their models."""

    def transfer(r):
        m = Model.unpack(r["model"])
        yield r["symbol"], r["fit"], r["block"], product(m.matrices(np.frombuffer(r["x"], "<f8"), r["before"])[0]).tobytes()

    def scan(key, t):
        t = t.sort_by("block")
        each = [np.frombuffer(x, "<f8") for x in t["product"].to_pylist()]
        k = math.isqrt(len(each[0]))
        each = np.array(each).reshape(-1, k, k)
        ahead = np.concatenate([np.full((1, k), 1 / k), carried(np.full(k, 1 / k), each)[0][:-1]])
        behind = np.concatenate([carried(np.full(k, 1 / k), each[::-1].transpose(0, 2, 1))[0][::-1][1:], np.full((1, k), 1 / k)])
        n = len(each)
        return pa.table({"symbol": pa.array([key[0].as_py()] * n, pa.string()), "fit": pa.array([key[1].as_py()] * n, pa.int32()), "block": t["block"], "entry": pa.array([p.tobytes() for p in ahead], pa.binary()), "exit_": pa.array([p.tobytes() for p in behind], pa.binary())})

    products = met.mapInArrow(_rows(transfer, [*_KEY, ("block", pa.int64()), ("product", pa.binary())]), "symbol string, fit int, block long, product binary")
    return products.groupBy("symbol", "fit").applyInArrow(scan, "symbol string, fit int, block long, entry binary, exit_ binary")


MODELS = "symbol string, fit int, model binary, centre double, likelihood double, done boolean"


def fit_blocks(blocks: DataFrame, states: int, rounds: int, tolerance: float, least_var: float) -> DataFrame:
    """(symbol, model) of symbols with several blocks. Each round is two passes over the blocks; the driver sees how many fits go on."""

    def moments(r):
        x = np.frombuffer(r["x"], "<f8")
        x = x[np.isfinite(x)]
        yield r["symbol"], len(x), float(x.sum()), float((x * x).sum())

    def begin(r):
        n = max(r["n"], 1)
        mean = r["first"] / n
        for k, m in enumerate(first_models(states, r["n"], mean, r["second"] / n - mean * mean, least_var)):
            yield r["symbol"], k, m.pack(), mean, -math.inf, r["n"] < states

    kinds = [*_KEY, ("model", pa.binary()), ("centre", pa.float64()), ("likelihood", pa.float64()), ("done", pa.bool_())]
    sums = blocks.mapInArrow(_rows(moments, [("symbol", pa.string()), ("n", pa.int64()), ("first", pa.float64()), ("second", pa.float64())]), "symbol string, n long, first double, second double")
    models = _written(sums.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.sum("second").alias("second")).mapInArrow(_rows(begin, kinds), MODELS), "hidden")

    def parts(r):
        m = Model.unpack(r["model"])
        got = expected(m, np.frombuffer(r["x"], "<f8"), r["before"], np.frombuffer(r["entry"], "<f8"), np.frombuffer(r["exit_"], "<f8"), r["centre"])
        yield r["symbol"], r["fit"], r["model"], r["centre"], r["likelihood"], got.tobytes()

    def update(key, t):
        r = t.slice(0, 1).to_pylist()[0]
        got = np.sum([np.frombuffer(x, "<f8") for x in t["sums"].to_pylist()], 0)
        m = updated(Model.unpack(r["model"]), got, r["centre"], least_var)
        return pa.table({"symbol": pa.array([key[0].as_py()], pa.string()), "fit": pa.array([key[1].as_py()], pa.int32()), "model": pa.array([m.pack()], pa.binary()), "centre": [r["centre"]], "likelihood": [float(got[0])], "done": [bool(got[0] - r["likelihood"] < tolerance)]})

    for _ in range(rounds):
        live = models.filter("NOT done")
        if live.isEmpty():
            break
        met = blocks.join(_near(live), "symbol")
        got = met.join(_ends(met), ["symbol", "fit", "block"]).mapInArrow(_rows(parts, [*_KEY, ("model", pa.binary()), ("centre", pa.float64()), ("likelihood", pa.float64()), ("sums", pa.binary())]), "symbol string, fit int, model binary, centre double, likelihood double, sums binary")
        models = _written(got.groupBy("symbol", "fit").applyInArrow(update, MODELS).unionByName(models.filter("done")), "hidden")
    return models.groupBy("symbol").agg(F.max_by("model", F.struct("likelihood", -F.col("fit"))).alias("model"))


class HmmDetector:
    """Regimes of log returns: fit learns a model of each symbol, regimes and proba filter forward with it. States are by
    rising variance; a bar without a return has regime -1 and no probabilities, and so has a symbol that wasn't fitted."""

    def __init__(self, states: int = 2, rounds: int = 50, tolerance: float = 1e-4, least_var: float = 1e-8, block: int = BLOCK):
        if states < 2 or rounds < 1 or least_var <= 0 or block < 2:
            raise ValueError("at least two states, one round, a positive least variance and blocks of two bars are needed")
        self.states, self.settings, self.block, self.models = states, (rounds, tolerance, least_var), block, None

    def fit(self, bars: DataFrame) -> HmmDetector:
        """Learns from all of bars: give it history that ends before what is to be labelled. A symbol of one block is fitted by the task that
        has it, longer ones by rounds over their blocks, with the same sums."""
        states, settings = self.states, self.settings
        blocks = _written(packed(bars, self.block), "returns")
        counts = blocks.groupBy("symbol").agg(F.count("*").alias("blocks"))
        sized = blocks.join(_near(counts), "symbol")

        def one(r):
            yield r["symbol"], fit_returns(np.frombuffer(r["x"], "<f8"), states, *settings).pack()

        short = sized.filter("blocks = 1").mapInArrow(_rows(one, [("symbol", pa.string()), ("model", pa.binary())]), "symbol string, model binary")
        many = sized.filter("blocks > 1").drop("blocks")
        if many.isEmpty():
            self.models = _written(short, "models")
            return self

        def sort(r):
            yield r["symbol"], Model.unpack(r["model"]).ordered().pack()

        long = fit_blocks(many, states, *settings).mapInArrow(_rows(sort, [("symbol", pa.string()), ("model", pa.binary())]), "symbol string, model binary")
        self.models = _written(short.unionByName(long), "models")
        return self

    def proba(self, bars: DataFrame) -> DataFrame:
        """(symbol, pos, proba: an array by state, null where there is no return), from the past alone."""
        if self.models is None:
            raise ValueError("the detector isn't fitted")
        blocks = _written(packed(bars, self.block), "returns")
        met = blocks.join(_near(self.models), "symbol").withColumn("fit", F.lit(0))
        entered = met.join(_ends(met), ["symbol", "fit", "block"]).select("symbol", "before", "pos", "x", "model", "entry")
        none = blocks.join(self.models.select("symbol"), "symbol", "left_anti").select("symbol", "before", "pos", "x", F.lit(None).cast("binary").alias("model"), F.lit(None).cast("binary").alias("entry"))

        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    pos, x = np.frombuffer(r["pos"], "<i8"), np.frombuffer(r["x"], "<f8")
                    p = filtered(Model.unpack(r["model"]), x, r["before"], np.frombuffer(r["entry"], "<f8")) if r["model"] else np.full((len(x), 1), np.nan)
                    good = np.isfinite(p[:, 0])
                    offsets = np.concatenate([[0], np.cumsum(good)]) * p.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(~good, False)), pa.array(p[good].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([r["symbol"]] * len(pos), pa.string()), pa.array(pos), lists], names=["symbol", "pos", "proba"])

        return entered.unionByName(none).mapInArrow(run, "symbol string, pos long, proba array<double>")

    def regimes(self, bars: DataFrame) -> DataFrame:
        top = F.array_position("proba", F.array_max("proba")) - 1
        return self.proba(bars).select("symbol", "pos", F.coalesce(top, F.lit(-1)).cast("int").alias("regime"))


def hmm_regimes(bars: DataFrame, states: int = 2, train: int = 200) -> DataFrame:
    """(symbol, pos, regime, p_high): the model is fitted to the first `train` bars of each symbol; -1 and null where there is no
    return, p_high is the probability of the state of the largest variance."""
    p = HmmDetector(states).fit(bars.filter(F.col("pos") < train)).proba(bars)
    top = F.array_position("proba", F.array_max("proba")) - 1
    return p.select("symbol", "pos", F.coalesce(top, F.lit(-1)).cast("int").alias("regime"), F.element_at("proba", -1).alias("p_high"))

"""Many linear models in one pass: all labels, folds, shares and grid points see a batch of rows together.

Rows have a vector, targets, a fold and a place between 0 and 1. A model is a column of one weight matrix:
its label, the fold that it does not see, the share of places that it sees, its loss and its penalty. A pass
over the rows makes the scores of all models by one matrix product a batch, and their gradients by another;
sums are added up in the tasks, and one gradient a pass comes to the driver, without the features that a model's scale takes out. Each model has its own L-BFGS steps,
but all step together, so passes do not grow with the number of models.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.ordered import running_sum
from callweave.operators.phrases import WORD
from callweave.plans.scratch import materialise

#: Rows that are worked on together.
TOGETHER = 4096
MEMORY = 10


@dataclass(frozen=True)
class Model:
    """A scale also makes each sparse row one of length 1. ``label``: target to tell from the rest; ``fold`` not seen (-1: all are); rows with a place up to ``share``; ``penalty`` on squared weights.

    ``loss``: "logistic" or "hinge" (squared); ``balanced``: both sides of the target weigh alike; ``scale``: row of the scales that multiplies the features.
    """

    label: int
    fold: int = -1
    share: float = 1.0
    penalty: float = 0.01
    loss: str = "logistic"
    balanced: bool = False
    scale: int = -1


@dataclass
class Fit:
    """Weights (features + 1, models), the last row being intercepts, and the passes over the rows that they took."""

    models: list[Model]
    weights: np.ndarray
    passes: int
    scales: np.ndarray | None = field(default=None, repr=False)

    def effective(self) -> np.ndarray:
        """Weights for unscaled features."""
        return _scaled(self.models, self.weights, self.scales)


def _scaled(models: Sequence[Model], weights: np.ndarray, scales: np.ndarray | None) -> np.ndarray:
    if scales is None:
        return weights
    factor = np.ones_like(weights)
    for m, model in enumerate(models):
        if model.scale >= 0:
            factor[:-1, m] = scales[model.scale]
    return weights * factor


class Rows:
    """A piece of a batch: dense or sparse features, targets, folds, places."""

    def __init__(self, batch: pa.RecordBatch, width: int, labels: int):
        n = batch.num_rows
        names = batch.schema.names
        self.n, self.width = n, width
        self.fold = batch.column("fold").to_numpy(zero_copy_only=False)
        self.place = batch.column("place").to_numpy(zero_copy_only=False)
        self.target = np.zeros((n, labels), bool)
        said = batch.column("y")
        at = np.repeat(np.arange(n), np.diff(said.offsets.to_numpy()))
        self.target[at, said.flatten().to_numpy(zero_copy_only=False)] = True
        if "v" in names:
            self.x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width)
        else:
            idx, val = batch.column("idx"), batch.column("val")
            self.x = None
            self.idx = idx.flatten().to_numpy(zero_copy_only=False)
            self.val = val.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            self.at = np.repeat(np.arange(n), np.diff(idx.offsets.to_numpy()))

    def units(self, scales: np.ndarray | None, at: np.ndarray) -> np.ndarray | float:
        """(rows, models): what makes a row of scaled features one of length 1, for models with these scales; 1 without."""
        if scales is None or self.x is not None:
            return 1.0
        per = np.stack([np.bincount(self.at, (self.val * s[self.idx]) ** 2, self.n) for s in scales], axis=1)
        one = np.where(per > 0, 1 / np.sqrt(np.maximum(per, 1e-300)), 0.0)
        return np.where(at >= 0, one[:, at], 1.0)

    def scores(self, weights: np.ndarray, units: np.ndarray | float = 1.0) -> np.ndarray:
        if self.x is not None:
            return self.x @ weights[:-1] * units + weights[-1]
        out = np.empty((self.n, weights.shape[1]))
        for m in range(weights.shape[1]):
            out[:, m] = np.bincount(self.at, self.val * weights[self.idx, m], self.n)
        return out * units + weights[-1]

    def back(self, r: np.ndarray, units: np.ndarray | float = 1.0) -> np.ndarray:
        """(features + 1, models): the transposed product with residuals, and their sums."""
        out = np.empty((self.width + 1, r.shape[1]))
        sums, r = r.sum(axis=0), r * units
        if self.x is not None:
            out[:-1] = self.x.T @ r
        else:
            for m in range(r.shape[1]):
                out[:-1, m] = np.bincount(self.idx, self.val * r[self.at, m], self.width)
        out[-1] = sums
        return out


def pieces(batches: Iterator[pa.RecordBatch], width: int, labels: int) -> Iterator[Rows]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            # a copy of the piece, so that its offsets begin at 0
            yield Rows(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, TOGETHER)]) for c in batch.columns], names=batch.schema.names), width, labels)


#: Numbers of an array that are added up together.
SLICE = 8192


def summed(df: DataFrame, make, size: int) -> np.ndarray:
    """Adds up the arrays of ``size`` numbers that tasks make, slice by slice over the tasks, so that one array alone comes to the driver."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part in make(batches):
            total += part
        cuts = range(0, size, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array([total[at : at + SLICE].tobytes() for at in cuts], pa.binary())], names=["g", "s"])

    def add(t: pa.Table) -> pa.Table:
        total = 0.0
        for s in t.column("s"):
            total = total + np.frombuffer(s.as_buffer())
        return pa.table({"g": t.column("g").slice(0, 1), "s": pa.array([total.tobytes()], pa.binary())})

    slices = df.mapInArrow(one, "g int, s binary").groupBy("g").applyInArrow(lambda t: add(t), "g int, s binary").collect()  # ``size`` numbers
    out = np.zeros(size)
    for r in slices:
        out[r.g * SLICE : (r.g + 1) * SLICE] = np.frombuffer(r.s)
    return out


def _seen(rows: Rows, models: Sequence[Model], weights: np.ndarray) -> np.ndarray:
    """(rows, models): the weight of each row for each model, by side of the target; 0 where it is not seen."""
    fold, share, label = (np.array([getattr(m, n) for m in models]) for n in ("fold", "share", "label"))
    mask = (rows.fold[:, None] != fold) & (rows.place[:, None] <= share)
    return mask * np.where(rows.target[:, label], weights[1], weights[0])


def side_weights(data: DataFrame, models: Sequence[Model], width: int, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(2, models) weights of the two sides, and each model's sum of weights: one pass."""
    m = len(models)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for rows in pieces(batches, width, labels):
            seen = _seen(rows, models, np.ones((2, m)))
            on = rows.target[:, [x.label for x in models]]
            yield np.r_[(seen * ~on).sum(axis=0), (seen * on).sum(axis=0)]

    n = summed(data, make, 2 * m).reshape(2, m)
    total = n.sum(axis=0)
    even = np.where(n > 0, total / np.maximum(2 * n, 1), 0)
    weights = np.where([x.balanced for x in models], even, 1.0)
    return weights, np.maximum((weights * n).sum(axis=0), 1e-12)


def losses(data: DataFrame, models: Sequence[Model], weights: np.ndarray, sides: np.ndarray, total: np.ndarray, labels: int, scales: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean losses with penalties (models), and gradients (features + 1, models): one pass."""
    width, m = weights.shape[0] - 1, len(models)
    hinge = np.array([x.loss == "hinge" for x in models])
    label, at = [x.label for x in models], np.array([x.scale for x in models])
    factor = _scaled(models, np.ones_like(weights), scales)
    kept = np.flatnonzero(factor)  # elsewhere the gradient is 0
    sent = data.sparkSession.sparkContext.broadcast((weights * factor, scales, kept))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        w, scales, kept = sent.value
        for rows in pieces(batches, width, labels):
            seen = _seen(rows, models, sides)
            sign = np.where(rows.target[:, label], 1.0, -1.0)
            units = rows.units(scales, at)
            margin = sign * rows.scores(w, units)
            gap = np.maximum(0, 1 - margin)
            loss = np.where(hinge, gap * gap, np.logaddexp(0, -margin))
            slope = np.where(hinge, -2 * gap, -1 / (1 + np.exp(np.minimum(margin, 700))))
            yield np.r_[(seen * loss).sum(axis=0), rows.back(seen * slope * sign, units).ravel()[kept]]

    found = summed(data, make, m + len(kept))
    sent.unpersist()
    raw = np.zeros((width + 1) * m)
    raw[kept] = found[m:]
    gradient = raw.reshape(width + 1, m) * factor / total
    penalty = np.array([x.penalty for x in models])
    gradient[:-1] += penalty * weights[:-1]
    return found[:m] / total + penalty / 2 * (weights[:-1] ** 2).sum(axis=0), gradient


class Steps:
    """One model's L-BFGS with halved steps: where to look next, and what was found there."""

    def __init__(self, size: int):
        self.x, self.f, self.g = np.zeros(size), None, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.d, self.t = np.zeros(size), 0.0

    def at(self) -> np.ndarray:
        return self.x + self.t * self.d

    def direction(self) -> np.ndarray:
        q, kept = self.g.copy(), []
        for s, y in reversed(self.pairs):
            a = s @ q / (y @ s)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += s * (a - y @ q / (y @ s))
        return -q

    def told(self, f: float, g: np.ndarray, tolerance: float) -> bool:
        """Takes in what was found; whether the model is done."""
        if self.f is not None and f > self.f + 1e-4 * self.t * (self.g @ self.d) + 1e-15 * abs(self.f):
            self.t /= 2
            return self.t < 1e-12
        if self.f is not None:
            s, y = self.t * self.d, g - self.g
            if s @ y > 1e-14 * (y @ y):
                self.pairs = [*self.pairs[1 - MEMORY :], (s, y)]
        self.x, self.f, self.g = self.at(), f, g
        self.d = self.direction()
        self.t = 1.0 if self.pairs else 1 / max(1.0, float(np.abs(g).sum()))
        return float(np.abs(g).max()) < tolerance


def fit(data: DataFrame, models: Sequence[Model], width: int, labels: int, scales: np.ndarray | None = None, tolerance: float = 1e-8, most_passes: int = 200) -> Fit:
    """Fits all models to ``y array<int>, fold int, place double`` and ``v array<double>`` (or sparse ``idx array<int>, val array<double>``) rows.

    Minimises each model's mean weighted loss plus ``penalty / 2`` times its squared weights,
    intercepts aside. Models that are done drop out of the passes. ``data`` is read once a
    pass, so it should be a written table. Without rows all weights are 0.
    """
    sides, total = side_weights(data, models, width, labels)
    steps, active, passes = [Steps(width + 1) for _ in models], list(range(len(models))), 1
    while active and passes < most_passes:
        own = [models[i] for i in active]
        f, g = losses(data, own, np.stack([steps[i].at() for i in active], axis=1), sides[:, active], total[active], labels, scales)
        passes += 1
        active = [i for k, i in enumerate(active) if not steps[i].told(float(f[k]), g[:, k], tolerance)]
    return Fit(list(models), np.stack([s.x for s in steps], axis=1), passes, scales)


def out_of_fold(data: DataFrame, fitted: Fit, width: int, labels: int, key: str = "key") -> DataFrame:
    """``key, model, score``: each row's score from the models that did not see its fold; the margin, not a probability."""
    fold, scale = np.array([m.fold for m in fitted.models]), np.array([m.scale for m in fitted.models])
    sent = data.sparkSession.sparkContext.broadcast((fitted.effective(), fitted.scales))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, scales = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, TOGETHER)]) for c in batch.columns], names=batch.schema.names)
                rows = Rows(part, width, labels)
                r, m = np.nonzero(rows.fold[:, None] == fold)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(r)), pa.array(m.astype(np.int32)), pa.array(rows.scores(weights, rows.units(scales, scale))[r, m])], names=["key", "model", "score"])

    kind = dict(data.dtypes)[key]
    return data.mapInArrow(make, f"key {kind}, model int, score double")


def grams_of(text: str | None, grams: int) -> Iterator[tuple[str, int]]:
    """Runs of up to ``grams`` words in lower case, with their number of words."""
    words = WORD.findall((text or "").lower())
    for n in range(1, grams + 1):
        for i in range(len(words) - n + 1):
            yield " ".join(words[i : i + n]), n


def gram_table(df: DataFrame, grams: int, least: int, most_terms: int) -> DataFrame:
    """``gram, n, df``: runs of up to ``grams`` words of ``text``, by the rows (``df``, a map by fold) that hold them; the ``most_terms`` most frequent of ``least`` rows or more.

    Each batch counts its own grams first.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part, counts = batch.slice(at, TOGETHER), Counter()
                for text, fold in zip(part.column("text").to_pylist(), part.column("fold").to_pylist(), strict=True):
                    counts.update((g, n, fold) for g, n in set(grams_of(text, grams)))
                if counts:
                    columns = zip(*((*k, c) for k, c in counts.items()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["gram", "n", "fold", "k"])

    each = df.select("text", F.col("fold").cast("int").alias("fold")).mapInArrow(make, "gram string, n int, fold int, k bigint").groupBy("gram", "n", "fold").agg(F.sum("k").alias("k"))
    per = each.groupBy("gram", "n").agg(F.map_from_entries(F.collect_list(F.struct("fold", "k"))).alias("df"), F.sum("k").alias("total")).where(F.col("total") >= least)
    # places come from range partitions: a sort with a limit would send the first rows of every task to the driver
    frequent = materialise(per.select("gram", "n", "df", (-F.col("total")).alias("o")), "frequent")
    return running_sum(frequent, F.lit(1), ["o", "gram"]).where(F.col("run") <= most_terms).orderBy("run").select("gram", "n", "df")


def text_rows(df: DataFrame, keys: Sequence[str], grams: int, least: int, most_terms: int = 1 << 18) -> tuple[DataFrame, list[tuple[str, int, dict[int, int]]]]:
    """Sparse counts (``idx, val``) of the terms of ``text``, with ``keys``, and the terms (gram, words, rows by fold), ``most_terms`` at most."""
    terms = [(r.gram, r.n, r.df) for r in gram_table(df, grams, least, most_terms).collect()]
    sent = df.sparkSession.sparkContext.broadcast({g: i for i, (g, _, _) in enumerate(terms)})
    types = dict(df.dtypes)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch, idx, val = whole.slice(at, TOGETHER), [], []
                for text in batch.column("text").to_pylist():
                    own = Counter(i for g, _ in grams_of(text, grams) if (i := known.get(g)) is not None)
                    idx.append(list(own))
                    val.append([float(n) for n in own.values()])
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64()))], names=[*keys, "idx", "val"])

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", idx array<int>, val array<double>"
    return materialise(df.select("text", *keys).mapInArrow(make, schema), "terms"), terms

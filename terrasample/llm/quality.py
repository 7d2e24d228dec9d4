"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives (labels of quality 1) and unlabelled web text (the corpus
itself) are all that training uses.  The class prior of the unlabelled text is
estimated first: a plain positive-against-unlabelled scorer is fitted on one
half of the rows, and on the other half the smallest ratio of unlabelled to
positive mass above a score, with a confidence margin, bounds the prior.  Then
a scorer minimises

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss, for which all but the maximum is convex.  Newton steps
find its least; where the second part turns negative, the step goes up its
gradient instead, which stops the scorer from overfitting the positives.

Every positive and every unlabelled text counts: the features of all texts that
aren't held out are written once, some 64 bytes a row, and each step adds up
its sums over them in Spark (a few hundred numbers a task).  Scoring reads every
whole text of every document, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.llm import _features, _text
from terrasample.llm._session import TEXT_ROWS, cut, discard, lean, shared_folder, ship


@dataclass
class Model:
    """A fitted scorer: standardisation, weights and the prior it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z[:, 0] = 1
        return np.concatenate((z, np.square(z[:, 1:]) / 6), 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x.astype(np.float64)) @ self.weight, -40, 40)))


def _adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: Equal steps of the score in which its distribution is counted.
BINS = 4000


def estimate_prior(p: np.ndarray, u: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives in the unlabelled rows, by the counts of both in BINS steps of a score: the least upper-bounded ratio of tail masses."""
    q_p, q_u = (np.append(np.cumsum(x[::-1])[::-1], 0) / x.sum() for x in (p, u))
    margin = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(u.sum()) + 1 / np.sqrt(p.sum()))
    ok = q_p > 0.05
    best = np.argmin((q_u[ok] + margin) / q_p[ok])
    return float(np.clip(q_u[ok][best] / q_p[ok][best], 0.02, 0.98))


def sums(x: np.ndarray, positive: np.ndarray, model: Model, w: np.ndarray) -> np.ndarray:
    """What a step needs of some rows, to be added up over all: of the positives and of all rows (the unlabelled) their number, summed features, loss, gradient and curvature."""
    z = model.expand(x.astype(np.float64))
    out = []
    for some in (z[positive], z):
        f = some @ w
        s = _sigmoid(f)
        out += [[len(some)], some.sum(0), [np.logaddexp(0, f).sum()], some.T @ s, (some.T @ (some * (s * (1 - s))[:, None])).reshape(-1)]
    return np.concatenate([np.asarray(v, float) for v in out])


@dataclass
class _Side:
    """The sums of one side, as means."""

    n: float
    mean: np.ndarray
    loss: float
    gradient: np.ndarray
    curvature: np.ndarray

    @classmethod
    def both(cls, total: np.ndarray, d: int) -> tuple[_Side, _Side]:
        size = 2 + 2 * d + d * d
        parts = [total[:size], total[size:]]
        return tuple(
            cls(
                v[0], v[1 : d + 1] / max(v[0], 1), v[d + 1] / max(v[0], 1), v[d + 2 : 2 * d + 2] / max(v[0], 1),
                v[2 * d + 2 :].reshape(d, d) / max(v[0], 1)
            ) for v in parts
        )


#: Adds up sums() over the rows of a half (0 or 1; None: all) at some weights.
Adder = Callable[[Model, np.ndarray, int | None], np.ndarray]
#: Counts the scores of a half's positives and of all its rows in BINS steps.
Counter = Callable[[Model, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def _newton(step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], d: int, rounds: int) -> np.ndarray:
    """The least of a convex risk from its gradient and curvature, in damped steps."""
    w = np.zeros(d)
    for _ in range(rounds):
        gradient, curvature = step(w)
        move = np.linalg.solve(curvature + 1e-9 * np.eye(d), gradient)
        size = np.linalg.norm(move)
        w = w - move * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-5:
            break
    return w


def fit(add: Adder, count: Counter, mean: np.ndarray, scale: np.ndarray, prior: float | None = None, rounds: int = 12, ridge: float = 20.0) -> Model:
    """Fit by sums over the rows; the prior is estimated where none is given.

    The squared weights are held down by ``ridge`` over the number of positives,
    so the fewer there are, the less the scorer follows their chance.
    """
    model = Model(mean, scale, np.zeros(0), prior or 0.5)
    d = 2 * len(mean) - 1

    def plain(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, u = _Side.both(add(model, w, 0), d)
        l2 = ridge / max(2 * p.n, 1)
        return (p.gradient - p.mean + u.gradient) / 2 + l2 * w, (p.curvature + u.curvature) / 2 + l2 * np.eye(d)

    if prior is None:
        w = _newton(plain, d, rounds)
        p, u = count(model, w, 1)
        if p.sum() and u.sum():
            model.prior = estimate_prior(p, u)
    pi = model.prior

    def risk(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, u = _Side.both(add(model, w, None), d)
        l2 = ridge / max(p.n, 1)
        if u.loss - pi * p.loss < 0:  # up the gradient of the negative part, in a short step
            return pi * p.gradient - u.gradient + l2 * w, 10 * np.eye(d)
        # with the logistic loss R_p(+1) - R_p(-1) is the mean of -f over the positives
        return u.gradient - pi * p.mean + l2 * w, u.curvature + l2 * np.eye(d)

    model.weight = _newton(risk, d, rounds)
    return model


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, ridge: float = 20.0) -> Model:
    """:func:`fit` on arrays of dense features."""
    x = np.concatenate((positive, unlabelled)).astype(np.float64)
    is_p = np.arange(len(x)) < len(positive)
    half = np.concatenate((np.arange(len(positive)) % 2, np.arange(len(unlabelled)) % 2))

    def add(model: Model, w: np.ndarray, part: int | None) -> np.ndarray:
        own = half == part if part is not None else half >= 0
        a, b = (sums(x[own & s], np.full(int((own & s).sum()), s[0]), model, w) for s in (is_p, ~is_p))
        k = len(a) // 2
        return np.concatenate((a[:k], b[k:]))

    def count(model: Model, w: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_binned(x[(half == part) & s], model, w) for s in (is_p, ~is_p))

    return fit(add, count, x.mean(0), x.std(0) + 1e-6, prior, ridge=ridge)


def _binned(x: np.ndarray, model: Model, w: np.ndarray) -> np.ndarray:
    s = _sigmoid(model.expand(x.astype(np.float64)) @ w)
    return np.bincount(np.minimum((s * BINS).astype(np.int64), BINS - 1), minlength=BINS)


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id's text leaves 0 modulo ``folds``: such rows' labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i, j in _text.slices(whole.column(1)):
            part = whole.slice(i, j - i)
            x = _features.dense(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "x"])


def _added(table: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``of(features, positive)`` added up over a table (x, p): each task sends its sums, a row a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                v = of(x, b.column("p").to_numpy(zero_copy_only=False))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.float64))], names=["k", "v"])

    rows = table.select("x", "p").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow().sort_by("k")
    return rows.column("v").to_numpy()


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on all rows that aren't held out; None where there are no positives or no texts to learn from."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_folder(spark)
    usable = F.col(id_col).isNotNull() & ~held_out(id_col)
    good = labels.where(usable & (F.col(label_col) == 1)).select(F.col(id_col).alias("id"), F.lit(True).alias("p")).distinct()
    pool = docs.where(usable).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    mapped = pool.mapInArrow(lean(_map_features), f"id {dict(docs.dtypes)[id_col]}, x array<float>")
    joined = mapped.join(good, "id", "left").select(
        "x", F.coalesce("p", F.lit(False)).alias("p"),
        F.pmod(F.xxhash64("id", F.lit(77)), F.lit(2)).cast("int").alias("half")
    )
    rows = cut(joined, folder, "features", TEXT_ROWS)
    size = len(_features.DENSE)
    total = _added(rows, lambda x, p: np.concatenate(([len(x), p.sum()], x.sum(0, dtype=np.float64), np.square(x.astype(np.float64)).sum(0))))
    if not len(total) or not total[1]:
        discard(spark, folder)
        return None
    mean = total[2 : 2 + size] / total[0]
    scale = np.sqrt(np.maximum(total[2 + size :] / total[0] - np.square(mean), 0)) + 1e-6
    of_half = lambda part: rows if part is None else rows.where(F.col("half") == part)

    def add(model: Model, w: np.ndarray, part: int | None) -> np.ndarray:
        out = _added(of_half(part), lambda x, p: sums(x, p, model, w))
        d = 2 * size - 1
        return out if len(out) else np.zeros(2 * (2 + 2 * d + d * d))

    def count(model: Model, w: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        out = _added(of_half(part), lambda x, p: np.concatenate((_binned(x[p], model, w), _binned(x, model, w))))
        return (out[:BINS], out[BINS:]) if len(out) else (np.zeros(BINS), np.zeros(BINS))

    model = fit(add, count, mean, scale)
    discard(spark, folder)
    return model


def score(
    docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
    keep_columns: bool = False
) -> DataFrame:
    """Score every row of ``docs``: id (or all columns), held_out, score, predicted.

    Null and empty texts are scored as texts without words, very long ones whole.
    Repeated rows are scored alike.  Without a model (nothing to learn from) every score is 0.5.
    Columns named held_out, score or predicted are replaced.
    """
    ship(docs.sparkSession)
    extra = {"score": "double"}
    kept = [c for c in docs.columns if c not in ("score", "predicted", "held_out")] if keep_columns else [id_col]
    types = dict(docs.dtypes)
    source = docs.select(*dict.fromkeys([*(f"`{c}`" for c in kept), f"`{text_col}`"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in _text.slices(whole.column(text_col)):
                part = whole.slice(i, j - i)
                s = model.score(_features.dense(part.column(text_col))) if model else np.full(len(part), 0.5)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(s)], names=[*kept, "score"])

    out = source.mapInArrow(lean(run), ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"{c} {t}" for c, t in extra.items())]))
    return out.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= threshold).cast("int")})

"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model is P(grade >= k) = sigmoid(w . x - t_k) for k = 1 .. K with one
weight vector ``w`` for all thresholds t_1 <= ... <= t_K.  ``x`` says which of
the selected words and word beginnings occur in the whole text.  The expected
severity is the sum of P(grade >= k), between 0 and K.

Grades.  Labels mark documents as toxic or not.  Grade 0 is "not toxic"; the
toxic ones are graded by how often marked words occur in them, a quantity that
the features (which tell only *whether* a word occurs) don't hold: 1 up to the
median of the toxic training documents, 2 above it.

Fitting uses labelled rows that aren't held out, about ``max_rows`` of them
(chosen by a hash of the id).  Features are all words and beginnings whose
signed likelihood ratio with the label is ``min_ratio`` or more, and ``min_share``
or more a labelled row, by counts that Spark adds up over this sample; the
squared weights are held down, so that many features don't overfit.  Scoring reads every text of every document, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm import _features, _text
from terrasample.llm._session import TEXT_ROWS, cut, lean, shared_folder, ship
from terrasample.llm.quality import _adam, _sigmoid, held_out

BITS = 22
#: How much the squared weights count, over the number of rows.
RIDGE = 0.3


@dataclass
class OrdinalModel:
    """Selected buckets (sorted), their shared weights and the ordered thresholds."""

    bucket: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def at_least(self, total: np.ndarray) -> np.ndarray:
        """P(grade >= k), rows x K, for the rows' weighted sums."""
        return _sigmoid(total[:, None] - self.threshold[None, :])

    def table(self) -> np.ndarray:
        """Place of each bucket among the selected ones plus one, 0 for the rest."""
        t = np.zeros(2**BITS, np.int32)
        t[self.bucket] = np.arange(1, len(self.bucket) + 1)
        return t


def present(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, selected feature) pairs of a text column, and how many of each row's words and beginnings are selected, repeats included."""
    row, key = _features.word_features(column, BITS)
    place = table[key]
    hit = place > 0
    often = np.bincount(row[hit], minlength=len(column))
    pair = np.unique(row[hit] * np.int64(2**31) + place[hit] - 1)
    return pair >> 31, pair & (2**31 - 1), often


def fit_ordinal(
    row: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, grades: int, l2: float = 1e-4,
    steps: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the cumulative logistic loss over all thresholds."""
    n, y = len(grade), (grade[:, None] >= np.arange(1, grades + 1)[None, :]).astype(float)

    def gradient(p):
        w, t = p[:n_features], np.cumsum(np.append(p[n_features], np.exp(np.clip(p[n_features + 1 :], -20, 20))))
        d = (_sigmoid(np.bincount(row, w[feature], n)[:, None] - t[None, :]) - y) / n
        g_t = -d.sum(0)
        g_raw = np.cumsum(g_t[::-1])[::-1].copy()
        g_raw[1:] *= np.diff(t)
        return np.concatenate((np.bincount(feature, d.sum(1)[row], n_features) + l2 * w, g_raw))

    p = _adam(gradient, n_features + grades, steps, 0.1)
    return p[:n_features], np.cumsum(np.append(p[n_features], np.exp(np.clip(p[n_features + 1 :], -20, 20))))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 20_000, min_ratio: float = 10.0, min_share: float = 0.0015
) -> OrdinalModel | None:
    """Fit on labelled rows that aren't held out; None where either class or all text is missing."""
    ship(docs.sparkSession)
    use = F.col(id_col).isNotNull() & ~held_out(id_col)
    seen = labels.where(use & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    n = seen.count()
    if not n:
        return None
    part = F.pmod(F.xxhash64(F.col("id"), F.lit(78)), F.lit(1 << 30)) < F.lit(int(min(1.0, max_rows / n) * (1 << 30)))
    sample = docs.where(use).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("t")
    ).where(part).join(F.broadcast(seen.where(part)), "id").select("id", "y", "t")  # about max_rows labels
    sample = cut(sample, shared_folder(docs.sparkSession), "sample")  # read three times below

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            y_all = whole.column(1).to_numpy()
            for i, j in _text.slices(whole.column(2), 8_000_000):
                row, key = _features.word_features(whole.column(2).slice(i, j - i), BITS)
                pair = np.unique(key << 24 | row)
                bucket, y = pair >> 24, y_all[i:j][pair & (2**24 - 1)]
                some, at = np.unique(bucket, return_inverse=True)
                bad = np.bincount(at, y, len(some)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(bad), pa.array(np.bincount(at, minlength=len(some)) - bad)],
                    names=["bucket", "bad", "good"]
                )

    totals = sample.groupBy("y").count().collect()
    n_bad, n_good = (sum(r["count"] for r in totals if (r["y"] > 0) == side) for side in (True, False))
    if not n_bad or not n_good:
        return None
    c = sample.mapInArrow(lean(counts), "bucket long, bad long, good long").groupBy("bucket").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    # signed likelihood ratio of "has the feature" against the label
    def term(k, n_all, rate):
        return k * F.log((k + 1e-9) / (n_all * rate)) + (n_all - k) * F.log((n_all - k + 1e-9) / (n_all * (1 - rate)))

    rate = (F.col("bad") + F.col("good")) / F.lit(float(n_bad + n_good))
    c = c.where((rate < 1) & (F.col("bad") * n_good > F.col("good") * n_bad)).withColumn(
        "llr", term(F.col("bad"), F.lit(float(n_bad)), rate) + term(F.col("good"), F.lit(float(n_good)), rate)
    )
    best = c.where(F.col("llr") >= max(min_ratio, min_share * (n_bad + n_good))).select("bucket").toArrow().column("bucket").to_numpy()  # of the bounded sample's words
    if not len(best):
        return None
    model = OrdinalModel(np.sort(best), np.zeros(0), np.zeros(0))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for whole in batches:
            for i, j in _text.slices(whole.column(2)):
                row, feature, often = present(whole.column(2).slice(i, j - i), table)
                lists = np.split(feature, np.searchsorted(row, np.arange(1, j - i)))
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(i, j - i), whole.column(1).slice(i, j - i), pa.array(often), pa.array(lists, pa.list_(pa.int32()))],
                    names=["id", "y", "often", "f"]
                )

    rows = sample.mapInArrow(
        lean(select), f"id {dict(docs.dtypes)[id_col]}, y int, often long, f array<int>"
    ).toArrow().sort_by([("id", "ascending"), ("often", "ascending")])
    y, often, lists = rows.column("y").to_numpy(), rows.column("often").to_numpy(), rows.column("f").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    row, feature = np.repeat(np.arange(len(y)), size), lists.flatten().to_numpy(zero_copy_only=False)
    grade = np.where(y > 0, np.where(often > np.median(often[y > 0]), 2, 1), 0)
    model.weight, model.threshold = fit_ordinal(row, feature, grade, len(model.bucket), 2, l2=RIDGE / len(y), steps=800)
    return model


def score(docs: DataFrame, model: OrdinalModel | None, *, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Every row's id (or all columns), p_mild = P(grade >= 1), p_severe, expected_severity, grade and toxic (p_mild >= 0.5).

    Null and empty texts have no words and get the grade of a text without
    marked words; very long texts count whole; repeated rows are scored alike; an
    empty table gives an empty table.  Columns of ``docs`` named as result columns
    are replaced.  Without a model (nothing to learn from) all is 0.
    """
    ship(docs.sparkSession)
    extra = {"p_mild": "double", "p_severe": "double", "expected_severity": "double", "grade": "int", "toxic": "boolean"}
    kept = [c for c in docs.columns if c not in extra] if keep_columns else [id_col]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table() if model else None
        for whole in batches:
            for i, j in _text.slices(whole.column(text_col)):
                part = whole.slice(i, j - i)
                p = np.zeros((j - i, 2))
                if model:
                    row, feature, _ = present(part.column(text_col), table)
                    p = model.at_least(np.bincount(row, model.weight[feature], j - i))
                out = [pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1), pa.int32()), pa.array(p[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *out], names=[*kept, *extra])

    source = docs.select(*dict.fromkeys([*(f"`{c}`" for c in kept), f"`{text_col}`"]))
    return source.mapInArrow(lean(run), ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"{c} {t}" for c, t in extra.items())]))

"""Quality classifier: ordinal cumulative-link regression on hashed text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

#: Hash range of features, and so the length of the weights, which are shipped to every task.
DIM = 1 << 18
#: Labelled documents that a fit uses at most: those with the smallest hash of their id.
FIT_ROWS = 12_000

_MARKS = regex.compile(rb"[^0-9A-Za-z\x80-\xff]+")


def features(text: str | None, dim: int = DIM) -> np.ndarray:
    """Sorted numbers of the features that a whole text has: its distinct words (lower case, marks
    stripped), the runs of marks around and in its words, and the bands of a few shares: upper case, marks,
    repeated lines, distinct words, word length."""
    raw = (text or "").encode()
    words = raw.split()
    low = [w.lower() for w in set(words)]
    names = {b"w" + w.strip(b".,;:!?\"'()") for w in low}
    names |= {b"m" + m for w in low for m in _MARKS.findall(w)}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(raw))
    share = {
        b"upper": sum(map(str.isupper, text or "")) / n,
        b"marks": sum(map(len, _MARKS.findall(raw))) / n,
        b"lines": 1 - len(set(lines)) / max(1, len(lines)),
        b"distinct": len(set(words)) / max(1, len(words)) ** 0.8,
        b"length": sum(map(len, words)) / max(1, len(words)) / 40,
    }
    names |= {b"s" + k + b"%d" % int(20 * min(v, 1)) for k, v in share.items()}
    names.add(b"b%d" % len(words).bit_length())
    return np.unique(np.fromiter((xxh32_intdigest(x) % dim for x in names), np.int32, len(names)))


@dataclass(frozen=True)
class Model:
    """P(grade <= j) = logistic(thresholds[j] - weights . x), x the set of a text's features."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """(rows, grades - 1): P(grade > j)."""
        s = np.array([self.weights[r].sum(dtype=np.float64) for r in rows]).reshape(-1, 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s, -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, dim: int = DIM, l2: float = 3.0, rounds: int = 250, rate: float = 0.05) -> Model:
    """Maximum penalised likelihood by full-batch Adam; grades weigh alike, features seen once are left out."""
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows)), sizes)
    seen = np.bincount(flat, minlength=dim) > 1
    doc, flat = doc[seen[flat]], flat[seen[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    share = np.bincount(grades, minlength=n_grades) / len(grades)
    weight = (1 / np.maximum(share, 1e-9) ** 0.5)[grades]
    weight /= weight.sum()
    # thresholds are a first one and the logs of the steps between them, so they stay in order
    w, first, steps = np.zeros(len(used)), -1.0, np.zeros(max(0, n_grades - 2))
    theta = np.concatenate([w, [first], steps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, cut = theta[: len(used)], np.cumsum(np.concatenate([[theta[len(used)]], np.exp(theta[len(used) + 1 :])]))
        s = np.bincount(doc, w[flat], len(rows))
        bounds = np.concatenate([[-np.inf], cut, [np.inf]])
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        hi, lo = sig(bounds[grades + 1] - s), np.where(grades == 0, 0.0, sig(bounds[grades] - s))
        hi = np.where(grades == n_grades - 1, 1.0, hi)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        ds = weight * (dhi - dlo) / p
        dcut = np.bincount(np.minimum(grades, n_grades - 2), -weight * dhi / p * (grades < n_grades - 1), n_grades - 1)
        dcut += np.bincount(np.maximum(grades - 1, 0), weight * dlo / p * (grades > 0), n_grades - 1)
        dw = np.bincount(flat, ds[doc], len(used)) + l2 / len(rows) * w
        dsteps = np.cumsum(dcut[::-1])[::-1]
        g = np.concatenate([dw, [dcut.sum()], dsteps[1:] * np.exp(theta[len(used) + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(dim, np.float32)
    weights[used] = theta[: len(used)]
    return Model(weights, np.cumsum(np.concatenate([[theta[len(used)]], np.exp(theta[len(used) + 1 :])])))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model | None:
    """A model of (id, grade) ratings from 0 to n_grades - 1; None without any.

    At most ``fit_rows`` rated documents are used, those with the smallest hash of the id; their
    features, not their texts, meet in one task, and the model, of a fixed size, comes to the driver.
    Null grades are no ratings; of several ratings of a document the lowest counts.
    """
    known = ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("grade").cast("int").alias("grade"))
    chosen = known.orderBy(F.xxhash64(F.col(id_col).cast("long"), F.lit("fit")), id_col).limit(fit_rows)
    kind = dict(docs.dtypes)[id_col]

    def extract(batches):
        for b in batches:
            f = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.list_(pa.int32()))], names=["id", "grade", "f"])

    # the chosen ids are at most fit_rows, so that side may be broadcast
    rated = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(id_col, "grade", text_col)
    made = rated.mapInArrow(extract, f"id {kind}, grade int, f array<int>")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        model = fit([np.asarray(x, np.int32) for x in pdf["f"]], pdf["grade"].to_numpy(), n_grades)
        return pd.DataFrame({"w": [model.weights.astype("<f4").tobytes()], "t": [model.thresholds.tolist()]})

    got = made.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "w binary, t array<double>").first()
    return Model(np.frombuffer(bytes(got.w), "<f4"), np.array(got.t)) if got else None


def grade(docs: DataFrame, model: Model | None, least_grade: int, tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail_probability, selected): P(grade >= least_grade) and whether it reaches ``tail``.

    Without a model both figures are null and every document is selected. Null texts are empty texts.
    """
    if model is None:
        return docs.select(id_col, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("selected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            tails = shared.value.tails([features(t.as_py()) for t in b.column(1)])
            p = tails[:, least_grade - 1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(p), pa.array(p >= tail)], names=[id_col, "expected_grade", "tail_probability", "selected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, tail_probability double, selected boolean")


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 toxic, 1 low quality, 2 good; a null toxic counts as not toxic."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def keep_selected(docs: DataFrame, model: Model | None, least_grade: int, tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``grade`` would select."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            tails = shared.value.tails([features(t.as_py()) for t in b.column(at)])
            yield b.filter(pa.array(tails[:, least_grade - 1] >= tail))

    return docs.mapInArrow(run, docs.schema)

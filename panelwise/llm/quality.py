"""Quality classifier by compression with zstandard dictionaries.

One dictionary is built from good labelled texts and one from bad ones. A text is compressed with
each; the difference of the two sizes, over their sum, is small or negative for good text. A
logistic curve fitted on other labelled rows turns it, together with the compressed size per byte
(which tells repeated filler), into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import small_batches

#: Labelled rows that the model is fitted on: this many of each class for the dictionaries, and
#: as many again for the curve, at most. A fixed bound; all rows are scored.
FIT_ROWS = 1500
DICT_BYTES = 1 << 17
#: A text is compressed in blocks of this size, all of it, so that the dictionaries weigh as much
#: in the last part of a long text as in the first.
BLOCK_BYTES = 4096
LEVEL = 3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column, folds: int = FOLDS, part: int = HELD_OUT) -> Column:
    """True for rows that no model may learn from; null ids are never held out (nor labelled)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> pd.DataFrame:
    """At most ``rows`` texts of each class, in the order of a hash of doc_id: ``y, text, weight``.

    The ids are drawn from the labels first and sent to the scan of the documents, so no text is
    shuffled. Documents that repeat an id give one row, that of the least text. ``weight`` makes up for the classes being
    drawn in other shares than they have among the labels; it is 1 on average.
    """
    pool = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    share = {r["y"]: r["count"] for r in pool.groupBy("y").count().collect()}
    ids = None
    for y in (0, 1):
        part = pool.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = part if ids is None else ids.unionByName(part)
    ids = docs.sparkSession.createDataFrame(ids.collect(), "doc_id bigint, y int")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # Rows that repeat an id are one row before anything comes to the driver: the least of their texts.
    out = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).toPandas()
    drawn = out["y"].map(out["y"].value_counts())
    out["weight"] = out["y"].map(share) / drawn * len(out) / max(sum(share.values()), 1)
    order = pd.util.hash_array(out["doc_id"].to_numpy("int64"))
    return out.iloc[np.argsort(order, kind="stable")].reset_index(drop=True)


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, steps: int = 60) -> np.ndarray:
    """Damped Newton's method for a ridge logistic regression; the first column of x is constant.

    Columns are standardised for the fit and the ridge; the weights are for the columns as given.
    """
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0.0, 1.0
    z = (x - mean) / np.where(scale > 0, scale, 1.0)
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y > 0, -(z @ w), z @ w))).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - penalty * w)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    w = w / np.where(scale > 0, scale, 1.0)
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False, write_checksum=False)
                for d in (self.good, self.bad)]
        return tuple(made)


def features(text: str, compressors: tuple[zstandard.ZstdCompressor, ...]) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)] or [b""]
    good, bad = (sum(len(c.compress(x)) for x in blocks) for c in compressors)
    n = max(len(raw), 1)
    difference = (bad - good) / (bad + good)
    per_byte = math.log((min(good, bad) + 8) / (n + 16))
    return (1.0, difference, per_byte, per_byte * per_byte, math.log1p(n) / 10)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the end of the raw texts where there are too few to train on."""
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICT_BYTES:]


def train(sample: pd.DataFrame) -> CompressionModel:
    """Dictionaries from one half of the sample, the curve from the other. With one class only, or
    no rows, the score is the smoothed share of label 1 for every text."""
    y = sample["y"].to_numpy(float)
    half = np.arange(len(sample)) % 2 == 0
    weight = sample["weight"].to_numpy(float)
    prior = math.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1))
    if len(set(y[half])) < 2 or len(set(y[~half])) < 2:
        return CompressionModel(b"", b"", (prior, 0.0, 0.0, 0.0, 0.0))
    text = sample["text"]
    model = CompressionModel(_dictionary(list(text[half & (y == 1)])), _dictionary(list(text[half & (y == 0)])), ())
    compressors = model.compressors()
    x = np.array([features(t, compressors) for t in text[~half]])
    model.weights = tuple(logistic_fit(x, y[~half], weight[~half]))
    return model


def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    return train(labelled_sample(docs, labels, "quality", ~held_out(F.col("doc_id")), 2 * FIT_ROWS))


def with_scores(docs: DataFrame, model: CompressionModel, column: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the probability of label 1 of their whole text.

    Null text is the empty text, which has a score like any other. Rows that repeat are scored one by
    one, whatever their doc_id; a column that has the result's name is replaced. Empty tables stay empty.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors, w = model.compressors(), np.array(model.weights)
        for texts in batches:
            x = np.array([features(t, compressors) for t in texts]).reshape(-1, len(w))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return docs.withColumn(column, score(F.coalesce(F.col("text"), F.lit(""))))

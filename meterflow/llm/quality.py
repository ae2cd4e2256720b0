"""Quality classifier by positive-unlabelled learning.

Features are shares and ratios of a whole text: letters, case, punctuation, repeated words and lines, lengths. A small network learns
from trusted positives (labelled rows of quality 1) and unlabelled texts by the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``. The class prior is estimated from the labelled rows, and the scores are calibrated
on them so that a score reads as a probability. Training takes bounded samples of labelled rows, those of smallest id hash:
MOST_POSITIVES trusted positives, MOST_UNLABELLED texts whose label it does not look at (so that they are drawn as the labels were, and the
prior holds for them), and MOST_CALIBRATION for the prior and the calibration. One pass finds all three: no more than MOST_UNLABELLED rows of
either label reach the driver. Scoring runs in the workers over all rows; only the model's few kilobytes move.

Held-out rows (crc32 of the id as text, mod 5, is 0) give neither labels nor unlabelled texts.

Cases: NULL text is the empty text, which has a score too. Rows with NULL ids are scored and not held out, and never
train. Labels that are NULL or have no document are ignored. Without any positive label every score is the prior. Other
columns never matter, nor do repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import slices, texts_of, worker_tools

MOST_POSITIVES, MOST_UNLABELLED, MOST_CALIBRATION = 4000, 8000, 4000
THRESHOLD = 0.3
SEED = 5

_LOWER, _UPPER, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_HIGH = np.arange(256) >= 128
_MARK = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH)
_STOP = np.isin(np.arange(256), list(b".,;:"))
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _MARK & ~_STOP, _STOP, _HIGH, _SPACE]).astype(float).T


def features(texts: list[str]) -> np.ndarray:
    """A row of features for each text."""
    out = np.zeros((len(texts), 20))
    for row, text in zip(out, texts):
        raw = text.encode()
        words, lines = raw.split(), raw.split(b"\n")
        n, k = max(1, len(raw)), max(1, len(words))
        row[:7] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
        distinct, distinct_lines = set(words), set(lines)
        row[7] = len(distinct) / k
        row[8] = len(set(zip(words, words[1:]))) / k
        row[9] = sum(map(bytes.__eq__, words, words[1:])) / k
        row[10] = sum(map(len, words)) / k / 10
        row[11] = max(map(len, words), default=0) / 40
        row[12] = len(distinct_lines) / len(lines)
        row[13] = np.log1p(len(raw)) / 12
        row[14] = np.log1p(len(words)) / 10
        row[15] = np.log1p(k / len(lines)) / 8
        row[16] = sum(map(bytes.isupper, distinct)) / max(1, len(distinct))
        row[17] = raw.count(b"|") / k
        row[18] = sum(map(bytes.isalpha, distinct)) / max(1, len(distinct))
        row[19] = len(distinct) / np.sqrt(k) / 20
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 0.01) -> Model:
    """Minimise the non-negative unbiased risk (sigmoid loss) by Adam over mini-batches."""
    rng = np.random.default_rng(SEED)
    x = np.concatenate([positive, unlabelled])
    model = Model(x.mean(0), x.std(0) + 1e-6, [rng.normal(0, 0.3, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)], prior=prior)
    p, u = ((part - model.mean) / model.scale for part in (positive, unlabelled))
    first, second, step = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0

    def gradients(x: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of sum(weight * margin)."""
        w1, b1, w2, _ = model.weights
        h = np.tanh(x @ w1 + b1)
        back = weight[:, None] * w2 * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ weight, weight.sum(keepdims=True)]

    for _ in range(epochs):
        order = rng.permutation(len(u))
        for i in range(0, len(u), batch):
            bu, bp = u[order[i : i + batch]], p[rng.integers(0, len(p), batch)]
            sp, su = (1 / (1 + np.exp(-np.clip(np.tanh(z @ model.weights[0] + model.weights[1]) @ model.weights[2] + model.weights[3], -40, 40))) for z in (bp, bu))
            negative = su.mean() - prior * sp.mean()  # sigmoid loss: l(z, -) = sigmoid(z), l(z, +) = sigmoid(-z)
            dp, du = sp * (1 - sp) / len(bp), su * (1 - su) / len(bu)
            if negative >= 0:
                g = [a + b for a, b in zip(gradients(bp, -2 * prior * dp), gradients(bu, du))]
            else:  # the risk of negatives is below zero: go back up on that part only
                g = [a + b for a, b in zip(gradients(bp, prior * dp), gradients(bu, -du))]
            step += 1
            for w, d, m, v in zip(model.weights, g, first, second):
                m[...] = 0.9 * m + 0.1 * d
                v[...] = 0.999 * v + 0.001 * d * d
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def calibrated(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Fit slope and offset of the margin to labels by Newton's method."""
    if len(set(y.tolist())) < 2:
        return model
    z = model.margin(x)
    w = np.zeros(2)
    w[0] = 1.0
    f = np.stack([z, np.ones_like(z)], 1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        h = (f * (q * (1 - q))[:, None]).T @ f + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, f.T @ (q - y) + 1e-3 * w), -2, 2)
    model.slope, model.offset = float(w[0]), float(w[1])
    return model


def held_out(id_col: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", prior: float | None = None) -> Model | float:
    """The model, or the prior alone if there is no positive label to learn from."""
    spark = df.sparkSession
    ids = df.select(F.col(id_col).cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & ~held_out()).distinct()
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("mark", "doc_id"))
    marked = ids.join(known, "doc_id").withColumn("mark", F.xxhash64("doc_id")).withColumn("place", place)
    chosen = marked.filter(F.col("place") <= max(MOST_POSITIVES, MOST_UNLABELLED, MOST_CALIBRATION)).select("mark", "doc_id", "label").collect()
    chosen = [(i, label) for _, i, label in sorted(map(tuple, chosen))]
    positives = set([i for i, label in chosen if label == 1][:MOST_POSITIVES])
    unlabelled = {i for i, _ in chosen[:MOST_UNLABELLED]}
    labelled = dict(chosen[:MOST_CALIBRATION])
    share = (sum(labelled.values()) + 1) / (len(labelled) + 2) if prior is None else prior
    if not positives:
        return share
    wanted = spark.createDataFrame([(x,) for x in sorted(positives | unlabelled | set(labelled))], "doc_id long")  # bounded by the three limits
    sample = texts_of(df, id_col, text_col).join(F.broadcast(wanted), "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(features(part.column("text").to_pylist())), pa.list_(pa.float64()))], ["doc_id", "x"])

    found = sorted((r["doc_id"], tuple(r["x"])) for r in sample.mapInArrow(run, "doc_id long, x array<double>").collect())
    made = dict(found)
    of = lambda keys: np.array([made[k] for k in sorted(keys) if k in made])
    model = fit_nnpu(of(positives), of(unlabelled), share)
    return calibrated(model, of(labelled), np.array([labelled[k] for k in sorted(labelled) if k in made], float))


def score(df: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(model, part.column("text").to_pylist()))], ["doc_id", "score"])

    rows = texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scores(model: Model | float, texts: list[str]) -> np.ndarray:
    return np.full(len(texts), model) if isinstance(model, float) else model.score(features(texts))


def kept(df: DataFrame, model: Model | float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, whole, whose text the model accepts."""

    def run(batches):
        worker_tools(("quality",), lambda: None)
        for batch in batches:
            for part in slices(batch, column=text_col):
                texts = [x or "" for x in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(scores(model, texts) >= threshold))

    return df.mapInArrow(run, df.schema)

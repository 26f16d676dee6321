"""Language identification by a byte convolutional network.

A text's UTF-8 bytes (A-Z lowered) are cut into windows of 128 bytes that cover it all.  In
each window, filters of several widths slide over one-hot bytes; their maxima feed a softmax
over the learned labels.  A text's distribution is the mean of its windows', weighted by
bytes.  Filters and softmax are trained in numpy on all windows of a bounded sample of the
labelled rows, in which equal rows count once; each row weighs the same, however long.

Null texts and texts without a letter (Unicode category L) get ``und`` and score 0; so does
everything where no labelled row exists.  Rows are independent: repeated rows repeat their results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, free_name, load, remainder, struct

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bound of the training sample: rows of a label.
SAMPLE_ROWS = 1000
EPOCHS, STEPS, BATCH, RATE = 2, 800, 128, 0.01  # at least so many steps
UNKNOWN = "und"
MOST_WEIGHT = 10.0  # of a window, so that no single one upsets the net

_LETTER = regex.compile(r"\p{L}")
_PREDICTED = "lang_pred string, score double"


@dataclass
class ByteNet:
    labels: list[str]
    filters: list[np.ndarray]  # of each width: width x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of all filters in each window, and where they stand."""
        tops, places = [], []
        for table in self.filters:
            n = x.shape[1] - len(table) + 1
            response = table[0].take(x[:, :n], axis=0)
            for j in range(1, len(table)):
                response += table[j].take(x[:, j : j + n], axis=0)
            tops.append(response.max(axis=1))
            if where:
                places.append(response.argmax(axis=1))
        return np.concatenate(tops, 1) + self.bias, np.concatenate(places, 1) if where else None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.pooled(x)[0], 0)
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def windows(text: str) -> np.ndarray:
    """All windows of a text as rows of bytes, the last one padded with 0."""
    data = text.encode("utf-8", "replace").lower()
    return np.frombuffer(data + bytes(-len(data) % WINDOW if data else WINDOW), np.uint8).reshape(-1, WINDOW)


def train(x: np.ndarray, y: list[str], many: np.ndarray | None = None) -> ByteNet | None:
    """Fit by Adam on windows and their labels; the same input gives the same net. ``many``: windows of the text that each is from."""
    if not len(x):
        return None
    labels = sorted(set(y))
    target = np.searchsorted(labels, y)
    rng = np.random.default_rng(0)
    net = ByteNet(
        labels,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    params = [*net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.ones(len(y)) if many is None else 1 / np.asarray(many, float)
    weight /= np.bincount(target, weights=weight, minlength=len(labels))[target]  # labels weigh the same, and so do a label's texts
    weight = (weight / weight.mean()).clip(0, MOST_WEIGHT).astype(np.float32)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(x)))):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            pick = order[a : a + BATCH]
            xb = x[pick]
            raw, place = net.pooled(xb, where=True)
            hidden = np.maximum(raw, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), target[pick]] -= 1
            p *= (weight[pick] / len(pick))[:, None]
            back = (p @ net.out.T) * (raw > 0)
            grads = []
            rows = np.arange(len(pick))[:, None]
            for k, table in enumerate(net.filters):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                at, g = place[:, own], back[:, own]
                grad = np.empty_like(table)
                for j in range(len(table)):
                    cell = xb[rows, at + j].astype(np.int64) * FILTERS + np.arange(FILTERS)
                    grad[j] = np.bincount(cell.ravel(), weights=g.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def classify(net: ByteNet | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(label, probability) of each text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    for i, text in enumerate(texts):
        if text and _LETTER.search(text):
            x = windows(text)
            total = np.zeros(len(net.labels))
            for a in range(0, len(x), 512):
                part = net.probabilities(x[a : a + 512])
                total += part.sum(0)
                if a + 512 >= len(x):  # the last window counts by its bytes
                    total -= part[-1] * (1 - max(1, np.count_nonzero(x[-1])) / WINDOW)
            best = int(total.argmax())
            out[i] = (net.labels[best], float(min(1.0, total[best] / total.sum())))
    return out


def fit(docs: DataFrame, train_rows: Column | bool = True, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> ByteNet | None:
    """A net learned from the rows that ``train_rows`` holds for, SAMPLE_ROWS of a label at most, drawn by a hash of id and text."""
    held = docs.where(F.lit(True) if train_rows is True else train_rows)
    base = held.select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("draw"), F.col(text).alias("body"), F.col(lang).cast("string").alias("label"))
    base = base.where(F.col("label").isNotNull() & (F.col("label") != UNKNOWN) & F.col("body").rlike(r"\p{L}"))
    rows = sorted((r["label"], r["body"]) for r in bounded(base, "label", SAMPLE_ROWS).select("label", "body").collect())
    cut = [windows(body) for _, body in rows]
    many = np.repeat([len(x) for x in cut], [len(x) for x in cut])
    return train(np.concatenate(cut) if cut else np.zeros((0, WINDOW), np.uint8), [label for (label, _), x in zip(rows, cut, strict=True) for _ in x], many)


def predictor(spark: SparkSession, net: ByteNet | None):
    """Column function text -> struct(lang_pred, score)."""
    held = spark.sparkContext.broadcast(net)  # some 40 thousand numbers, whatever the input

    @F.pandas_udf(struct(_PREDICTED))
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(classify(held.value, list(part)), columns=["lang_pred", "score"])

    return predict


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    predict = predictor(spark, fit(docs, ~held_out))
    own = free_name(docs, "predicted")
    return docs.select("doc_id", held_out.alias("held_out"), predict("text").alias(own)).select("doc_id", "held_out", f"{own}.*")

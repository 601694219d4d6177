"""Quality classifier: averaged hashed word and character n-gram vectors with a softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from roadloom.llm import textscan as ts
from roadloom.llm.cluster import fresh

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
CHAR_GRAMS = (2, 3, 4)
REPEATED = np.uint64(0x51ED27)
#: Bounds of the labelled sample on which the model is fitted.
MAX_TRAIN_DOCS = 3000
MAX_TRAIN_CHARS = 16384


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, first, end): hashed words, word pairs and character n-grams, and each document's range among them; case and marks count."""
    if len(data) == 0:
        return
    n_docs = np.arange(len(offsets) - 1)
    hashes = ts.Hasher(data)
    mask = np.uint64(BUCKETS - 1)
    starts, ends, docs = ts.spans(data, offsets, ts.TOKEN)
    if len(starts):
        words = hashes.ranges(starts, ends)
        yield (words & mask).astype(np.int32), np.searchsorted(docs, n_docs), np.searchsorted(docs, n_docs, side="right")
        same = np.flatnonzero(docs[1:] == docs[:-1])
        pairs = ts.mix(words[same] * np.uint64(0x100000001B3) + words[same + 1])
        pairs[words[same] == words[same + 1]] = REPEATED  # any word said twice is one feature
        docs = docs[same]
        yield (pairs & mask).astype(np.int32), np.searchsorted(docs, n_docs), np.searchsorted(docs, n_docs, side="right")
    for n in CHAR_GRAMS:
        grams = hashes.gram_buckets(n, BUCKET_BITS)
        yield grams, offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])


@dataclass
class QualityModel:
    """Score of class 1 is softmax over the mean of the features' vectors; ``margins`` holds each vector's difference of logits."""

    margins: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for buckets, first, end in features(data, offsets):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(self.margins[buckets], out=sums[1:])
            first, end = np.minimum(first, len(buckets)), np.minimum(end, len(buckets))
            total += sums[end] - sums[first]
            count += end - first
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -40, 40)))


def train(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 0.4, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over the given documents, one document a step; the order follows ``seed`` alone."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    output[:] = rng.uniform(-0.5, 0.5, output.shape)
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        found = [b for b, _, _ in features(data, np.array([0, len(data)]))]
        bags.append(np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    steps, done = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            buckets, counts = bags[i]
            step = rate * (1 - done / steps)
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            held = vectors[buckets]
            hidden = share @ held if len(buckets) else np.zeros(DIMENSIONS, np.float32)
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = output @ p
            output -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            # Not the loss's plain gradient: the mean divides each feature's step by the document's length, of which half is undone, so that long documents teach too.
            vectors[buckets] = held - step * (np.sqrt(share) * np.float32(8))[:, None] * back[None, :]
    return QualityModel((vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> QualityModel:
    """Fit on at most ``max_docs`` labelled documents of at most ``max_chars`` characters outside the held-out fold: of the labelled rows with the smallest hash of their id.

    Of rows that repeat a drawn id, the least text is learned from; of labels that contradict each
    other, the greater. Without a labelled row the model scores 0.5 everywhere. Rows with a null id,
    text or label are not learned from.
    """
    labelled = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    # The sample is drawn from the labels alone and broadcast (at most ``max_docs`` short rows): texts are never shuffled.
    drawn = labelled.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text").between(1, max_chars))
    # One row for each drawn id: at most ``max_docs`` rows of at most ``max_chars`` characters.
    rows = sorted(texts.join(F.broadcast(drawn), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label")).collect())
    if not rows:
        return QualityModel(np.zeros(BUCKETS), 0.0)
    return train([r["_text"] for r in rows], [int(r["_label"]) for r in rows])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.7, model: QualityModel | None = None, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if score >= ``accept``), or other ``names``, appended.

    Whole texts are scored in Arrow batches; a null or empty text gets the score of the bias alone.
    Only the text is an input of a score. Rows repeated are scored each; a row with a null id is not
    held out. Columns of ``docs`` with the appended names, in any case, are replaced; the text may be
    one of them. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model or fit(docs, labels, id_col, text_col))
    fold, score, predicted = names
    taken = {n.lower() for n in names}
    text = fresh(docs, "scored_text")
    docs = docs.select(*(c for c in docs.columns if c.lower() not in taken), held_out(id_col).alias(fold), F.col(text_col).alias(text))
    kept = len(docs.columns) - 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            data, offsets = ts.text_buffers(batch.column(kept))
            parts = [model.score(d, o) for _, _, d, o in ts.chunks(data, offsets)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(scores)], [*batch.schema.names[:kept], score])

    out = StructType([*docs.schema.fields[:kept], StructField(score, DoubleType())])
    return docs.mapInArrow(scored, out).withColumn(predicted, (F.col(score) >= accept).cast("int"))

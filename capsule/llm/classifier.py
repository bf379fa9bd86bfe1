"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words, pairs of words, and runs of one to three word shapes (capitals, small letters, digits,
signs), each hashed to one of 2**BITS places; their counts are divided by the number of n-grams, so a text's score does
not depend on its length. Training sees one document at a time (FTRL-proximal: per-coordinate rates, L1 and L2). The
model is one array of weights of fixed size; a score is a sparse dot product.

The training rows are a bounded sample, `rows` of them (parameter), those of smallest hash of doc_id; they pass through
one task as packed features. Scoring reads every whole text once, with no shuffle.

Defined cases. Null or empty text: scored by the intercept alone. Null doc_id: its text counts as the empty string, so
it is held out. Labels that are null or not 0 or 1 are not learned from. Repeated rows: each is scored alike; repeated
labels are each learned. No labels: all scores are 0.5. Columns of the input stay; input columns named like an added one
are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from capsule.llm.common import table
from capsule.llm.hashed import Words, blocks, mixed

BITS = 18
#: Weight of a text's counts: with all of them in one place, its value.
SCALE = 10.0
#: Labelled rows that the model is fitted on at most.
TRAIN_ROWS = 12_000
#: Score from which a document is predicted good.
ACCEPT = 0.3

ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 1e-3, 1e-3, 2


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the places of its n-grams (sorted, distinct) and their values."""
    w = Words(texts, lower=False)
    shape = w.shapes()
    kinds = [w.ngrams(1), w.ngrams(2), *(w.ngrams(n, shape) for n in (1, 2, 3))]
    same = np.zeros(len(shape), np.uint64)
    same[1:] = w.hash[1:] == w.hash[:-1]
    kinds.append(w.ngrams(2, same))
    mask, out = np.uint64((1 << BITS) - 1), [([], []) for _ in texts]
    for salt, (h, doc) in enumerate(kinds):
        places = (mixed(h + np.uint64(salt)) & mask).astype(np.int32)
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            if at[i] < at[i + 1]:
                p, n = np.unique(places[at[i]:at[i + 1]], return_counts=True)
                out[i][0].append(p)
                out[i][1].append((n * (SCALE / (at[i + 1] - at[i]))).astype(np.float32))
    none = np.empty(0, np.int32), np.empty(0, np.float32)
    return [(np.concatenate(p), np.concatenate(v)) if p else none for p, v in out]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights (the last is the intercept) after EPOCHS passes over (places, values, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    for _ in range(EPOCHS):
        for places, values, label in rows:
            at, x = np.append(places, size - 1), np.append(values, 1.0)
            # a place that two kinds of n-gram share counts once with both values
            at, where = np.unique(at, return_inverse=True)
            x = np.bincount(where, x)
            w = weight(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return weight(z, n).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from `labels` (doc_id, quality) of `docs` (doc_id, text), held-out rows left aside."""
    order = F.xxhash64("doc_id")
    chosen = (labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
              .select("doc_id", F.col("quality").cast("double").alias("label"), order.alias("nth"))
              .orderBy("nth", "doc_id", "label").limit(rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in blocks(b["text"]):
                part = b.slice(at, len(some))
                found = features(some)
                yield pa.RecordBatch.from_arrays(
                    [part["nth"], part["label"], pa.array([p.tobytes() for p, _ in found], pa.binary()),
                     pa.array([v.tobytes() for _, v in found], pa.binary())], ["nth", "label", "places", "values"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(n.as_py(), p.as_py(), v.as_py(), y.as_py()) for b in batches
                for n, p, v, y in zip(b["nth"], b["places"], b["values"], b["label"])]
        held.sort()
        weights = ftrl([(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32), y) for _, p, v, y in held])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    packed = texts.mapInArrow(pack, "nth long, label double, places binary, values binary")
    made = packed.repartition(1).mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(made[0][0], np.float32) if made else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, accept: float = ACCEPT) -> DataFrame:
    """`docs` (column text and any others) with score (0 to 1) and predicted (1 from `accept` on)."""
    held = docs.sparkSession.sparkContext.broadcast(weights.tobytes())
    kept = docs.drop("score", "predicted")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(held.value, np.float32).astype(np.float64)
        for b in batches:
            for at, some in blocks(b.column(b.schema.get_field_index("text"))):
                part = b.slice(at, len(some))
                logit = np.array([w[-1] + np.dot(w[p], v) for p, v in features(some)])
                s = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(s), pa.array((s >= accept).astype(np.int32))], schema.fieldNames())
    return kept.mapInArrow(run, schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """Every document scored by a model of `labels.quality`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"), rows)
    return (score(docs, weights).withColumn("held_out", held_out(F.col("doc_id")))
            .select("doc_id", "held_out", "score", "predicted"))

"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachflow.llm import common

#: Features are hashed to so many coordinates; the model is fitted on so many labelled rows at most.
BITS, MOST_ROWS, EPOCHS = 20, 16_000, 4
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.1
FOLDS = 5
TIMES = common.powers(4, 0xC2B2AE3D27D4EB4F)
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = True
WORD[128:] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[after] += 32
    return out


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and coordinate of each word, pair of neighbours and pair with one word between."""
    data, begins = common.joined(texts)
    data = lowered(data)
    starts, words = common.word_hashes(data, WORD[data])
    text = np.searchsorted(begins, starts, side="right") - 1
    rows, keys = [text], [words * TIMES[0]]
    for kind, gap in ((1, 1), (2, 2)):
        if len(words) > gap:
            both = text[gap:] == text[:-gap]
            rows.append(text[gap:][both])
            keys.append((words[:-gap] * TIMES[kind] + words[gap:] * TIMES[3])[both])
    return np.concatenate(rows), (common.mixed(np.concatenate(keys)) >> np.uint64(64 - BITS)).astype(np.int32)


def presence(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct coordinates of each text."""
    rows, keys = occurrences(texts)
    both = np.unique(rows.astype(np.int64) << BITS | keys)
    cut = np.searchsorted(both >> BITS, np.arange(len(texts) + 1))
    keys = (both & ((1 << BITS) - 1)).astype(np.int32)
    return [keys[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def fit(features: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates with a weight, their weights, and the bias, which is not regularised."""
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for _ in range(EPOCHS):
        for x, y in zip(features, labels.tolist(), strict=True):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x], n[x] = zx + g - sigma * w, nx + g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    kept = np.flatnonzero(w)
    return kept.astype(np.int32), w[kept], bias


def scores(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of each text; coordinates of no weight are left before they are made distinct."""
    rows, keys = occurrences(texts)
    live = np.flatnonzero(weights[keys])
    both = np.unique(rows[live].astype(np.int64) << BITS | keys[live])
    total = np.bincount(both >> BITS, weights[both & ((1 << BITS) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(bias + total, -35, 35)))


def trained(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits the model on at most most_rows labelled rows: those of least hash among rows outside the held-out fold.

    A document with several labels counts as toxic if any says so; null labels don't count. Of rows that repeat an id the
    text of least hash counts. The rows are made
    features by all tasks; one task fits on this bounded sample, in the order of the hash. Without labelled rows the
    model scores 0.5 everywhere.
    """
    common.small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(common.crc_mod(F.col("doc_id"), FOLDS) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("known_id")).agg(F.max("toxic").cast("int").alias("y"))
    sample = known.withColumn("turn", F.xxhash64("known_id")).orderBy("turn", "known_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("known_id")).select("turn", "known_id", "y", F.xxhash64("text").alias("own"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in common.slices(batches, "text"):
            yield pa.record_batch([*[part.column(c) for c in ("turn", "known_id", "y", "own")], pa.array([x.tobytes() for x in presence(own)], pa.binary())], ["turn", "known_id", "y", "own", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sorted(((t, d, y, x) for b in batches for t, d, y, x in zip(*(b.column(c).to_pylist() for c in ("turn", "known_id", "y", "x")), strict=True)), key=lambda r: r[:2] + r[3:])
        at, w, bias = fit([np.frombuffer(r[3], np.int32) for r in every], np.array([r[2] for r in every]))
        yield pa.record_batch([pa.array([-1, *at.tolist()], pa.int32()), pa.array([bias, *w.tolist()])], ["at", "w"])

    features = rows.mapInArrow(extract, "turn long, known_id long, y int, own long, x binary").groupBy("turn", "known_id", "y").agg(F.min_by("x", "own").alias("x"))
    model = features.repartition(1).mapInArrow(run, "at int, w double").toArrow()  # at most 2**BITS weights
    at, w = model.column("at").to_numpy(), model.column("w").to_numpy()
    return at[at >= 0].astype(np.int32), w[at >= 0], float(w[at < 0].sum())


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts get the bias's score. Other columns are left out."""
    at, w, bias = model
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast((at, w, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        weights = np.zeros(1 << BITS)
        weights[at] = w
        for rows, texts in common.slices(batches, "text"):
            s = scores(texts, weights, bias)
            yield pa.record_batch([rows.column("doc_id"), rows.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (common.crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

"""Language identification by a string kernel with Nyström landmarks and one-versus-rest ridge regression.

The blended-spectrum kernel of two texts is the number of character n-grams, of one to four letters, that both hold,
divided by the geometric mean of their own numbers. N-grams are hashed to BUCKETS presence bits, in which a text is
one row of a matrix; a batch of texts is scored by two matrix products.

A text counts as one of its best language if enough of its n-grams are that language's: in at least LEAST of its labelled
texts. How many are enough is learned for each language from the shares of its own labelled texts, so that the rule does
not depend on the number of languages, as the scores do: those of one-versus-rest ridge regression sum to about 2 - L.
All of this is counted over all labelled texts; the landmarks alone are a bounded choice of rows, which the kernel is
projected on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachflow.llm import common
from reachflow.llm.toxicity import WORD, lowered

LONGEST, BUCKET_BITS = 4, 14
BUCKETS = 1 << BUCKET_BITS
#: So many rows of each language are landmarks, taken from so many hash classes.
SALTS, LANDMARKS, RIDGE = 60, 40, 1e-2
#: An n-gram is a language's if this share of its labelled texts has it.
LEAST = 0.025
#: Kernel values are summed in units of 1 / UNIT, in parts of so many sums; shares are counted in steps of 1 / STEPS.
UNIT, PART, STEPS = 65_536, 1024, 65_536
FOLDS, HELD_OUT = 4, 2
ROWS = 64
#: A text may lack so many times the share of n-grams that all but the QUANTILE of its language's labelled texts lack at most.
QUANTILE, SLACK = 0.01, 3.0
#: Letters are Unicode's category L: no fractions, circled digits or Roman numeral signs.
HAS_LETTER = regex.compile(r"\p{L}")
GAP = b" " * LONGEST
TIMES = common.powers(LONGEST, 0x9FB21C651E98DF25)
SALT = common.mixed(np.arange(1, LONGEST + 1, dtype=np.uint64))
LETTERS = np.where(WORD, np.arange(256), 32).astype(np.uint8)
LETTERS[48:58] = 32


def presence(texts: list[bytes]) -> np.ndarray:
    """A row of BUCKETS zeros and ones for each text: which n-grams of its letters, lower-cased, it holds."""
    data, begins = common.joined([b"", *texts], GAP)
    data = LETTERS[lowered(data)].astype(np.uint64) + np.uint64(1)
    # An n-gram belongs to the text that it begins in or less than LONGEST places before: gaps keep texts apart.
    row = np.repeat(np.arange(-1, len(texts)), np.diff([0, *(begins[1:-1] - LONGEST + 1), begins[-1]]))
    out = np.zeros((len(texts), BUCKETS), np.float32)
    key = np.zeros(len(data), np.uint64)
    for n in range(LONGEST):
        key = key[: len(data) - n] + data[n:] * TIMES[n]
        bucket = (common.mixed(key + SALT[n]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        own = row[: len(bucket)] >= 0
        out[row[: len(bucket)][own], bucket[own]] = 1
    return out


def rows_of(texts: list[bytes], most: int = ROWS) -> Iterator[np.ndarray]:
    for i in range(0, len(texts), most):
        yield presence(texts[i : i + most])


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel values of presence rows against unit rows of landmarks."""
    return (x @ landmarks.T) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]


def unit(bits: np.ndarray) -> np.ndarray:
    x = bits.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]


def shares(x: np.ndarray, union: np.ndarray) -> np.ndarray:
    """The share of each presence row's n-grams that are in the union."""
    return ((x @ union).T / np.maximum(x.sum(axis=1), 1)).T


def common_grams(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which n-grams at least LEAST of a language's texts hold, from how many hold each (a row a language), and one at least."""
    return (counts >= LEAST * np.maximum(rows, 0)[:, None]) & (counts > 0)


def fit(names: list[str], rows: np.ndarray, marks: np.ndarray, gram: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the landmarks' kernel values and the constants, of ridge regression over all rows, from their sums.

    gram sums the weighted products of two kernel values, sides their weighted sums by language. Languages weigh alike,
    however many rows they have.
    """
    base = unit(marks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    m, n = len(marks), len(names)
    total = root @ sides.sum(axis=0)
    a = np.block([[root @ gram @ root, total[:, None]], [total[None], np.full((1, 1), float(rows.sum()))]]) + RIDGE * np.eye(m + 1)
    target = 2 * np.eye(n) - 1
    b = np.vstack([root @ sides.T @ target, np.full((1, n), rows.sum() / n) @ target])
    w = np.linalg.solve(a, b)
    return (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)


def summed(rows: DataFrame, names: list[str], sizes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all rows (text, lang): how many of each language hold each n-gram, and fit()'s gram and sides.

    Weighted kernel values are rounded to whole numbers, so that sums don't depend on the order of tasks.
    """
    packed, at = np.packbits(marks, axis=1), {x: i for i, x in enumerate(names)}
    scale = np.sqrt(sizes.sum() / (len(names) * sizes)) * UNIT
    upper = np.triu_indices(len(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = unit(np.unpackbits(packed, axis=1)), False
        counts, gram, sides = np.zeros((len(at), BUCKETS), np.int64), np.zeros((len(base), len(base)), np.int64), np.zeros((len(at), len(base)), np.int64)
        for part, texts in common.slices(batches, "text"):
            langs, begin = np.array([at[x] for x in part.column("lang").to_pylist()]), 0
            for x in rows_of(texts):
                own = langs[begin : begin + len(x)]
                begin, seen = begin + len(x), True
                k = np.rint(kernel(x, base) * scale[own][:, None])
                gram += (k.T @ k).astype(np.int64)
                for i in np.unique(own).tolist():
                    counts[i] += x[own == i].sum(axis=0).astype(np.int64)
                    sides[i] += k[own == i].sum(axis=0).astype(np.int64)
        if seen:
            flat = np.concatenate((counts.ravel(), gram[upper], sides.ravel()))
            for i in range(0, len(flat), PART):
                yield pa.record_batch([pa.array([i // PART], pa.int32()), pa.array([flat[i : i + PART].tobytes()], pa.binary())], ["part", "sums"])

    def add(own: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in own.column("sums"))
        return pa.table({"part": own.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("text", "lang").mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()  # as long as the model
    flat = np.concatenate([np.frombuffer(p["sums"], np.int64) for p in sorted(parts, key=lambda p: p["part"])])
    counts, triangle, sides = np.split(flat, [len(names) * BUCKETS, len(flat) - len(names) * len(marks)])
    gram = np.zeros((len(marks), len(marks)))
    gram[upper] = triangle
    gram = gram + np.triu(gram, 1).T
    return counts.reshape(len(names), -1), gram / UNIT**2, sides.reshape(len(names), -1) * (scale / UNIT**2)[:, None]


def floors(rows: DataFrame, names: list[str], sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least share of n-grams among its language's that a text may have, from the shares of all rows (text, lang).

    A row is held against all other ones of its language. A language of one text has no floor. Shares are counted in
    steps of 1 / STEPS, so that the quantile is that of all rows.
    """
    others, at = np.packbits(common_grams(counts - 1, sizes - 1), axis=1), {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.unpackbits(others, axis=1).T.astype(np.float32)
        for part, texts in common.slices(batches, "text"):
            langs = part.column("lang").to_pylist()
            own = np.concatenate([shares(x, grams) for x in rows_of(texts)])[np.arange(len(texts)), [at[x] for x in langs]]
            yield pa.record_batch([part.column("lang"), pa.array(np.floor(own * STEPS).astype(np.int32))], ["lang", "step"])

    steps = rows.select("text", "lang").mapInArrow(run, "lang string, step int").groupBy("lang", "step").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    whole = F.sum("n").over(Window.partitionBy("lang"))
    found = steps.select("lang", "step", upto.alias("upto"), whole.alias("whole")).where(F.col("upto") > F.floor((F.col("whole") - 1) * QUANTILE))
    least = {r["lang"]: r["step"] for r in found.groupBy("lang").agg(F.min("step").alias("step")).collect()}  # a row a language
    return np.array([max(0.0, 1 - SLACK * (1 - least[x] / STEPS)) for x in names])


def landmark_rows(rows: DataFrame, once: DataFrame) -> list:
    """turn, lang, x of the LANDMARKS ids of each language that come first: of least hash in turn from each of SALTS hash classes."""
    # Hash classes keep a language that holds most rows from meeting in one task.
    keyed = once.withColumn("key", F.xxhash64("doc_id")).withColumn("salt", F.pmod("key", F.lit(SALTS)))
    turn = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("key", "doc_id"))
    first = keyed.withColumn("turn", turn).where(F.col("turn") <= LANDMARKS).withColumn("turn", (F.col("turn") * SALTS + F.col("salt")).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn"))
    picked = first.withColumn("place", place).where(F.col("place") <= LANDMARKS).select(F.col("doc_id").alias("picked"), F.col("lang").alias("picked_lang"), "turn")
    texts = rows.join(F.broadcast(picked), (F.col("doc_id") == F.col("picked")) & (F.col("lang") == F.col("picked_lang")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in common.slices(batches, "text"):
            packed = [b.tobytes() for x in rows_of(own) for b in np.packbits(x.astype(np.uint8), axis=1)]
            yield pa.record_batch([part.column("turn"), part.column("lang"), pa.array(packed, pa.binary())], ["turn", "lang", "x"])

    return texts.select("turn", "lang", "text").mapInArrow(extract, "turn int, lang string, x binary").collect()


def trained(docs: DataFrame, every: bool = False) -> dict | None:
    """Fits the model on all texts outside the held-out fold, or on every one.

    Rows of null ids, texts or languages don't count; an id counts once in each language, by the text of least hash. The
    landmarks alone are some rows, LANDMARKS of each language, as the method has it; the n-grams of a language, the weights
    and the floors come from sums over all rows, that the tasks make. None if there is no row.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and text is not null and lang is not null")
    if not every:
        rows = rows.where(common.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    once = common.narrow(rows.groupBy("doc_id", "lang").agg(F.count("*").alias("n")))
    found = {r["lang"]: r["n"] for r in once.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not found:
        return None
    names = sorted(found)
    sizes = np.array([found[x] for x in names], np.int64)
    repeated = once.where("n > 1").select("doc_id", "lang")
    if not repeated.isEmpty():
        least = F.min(F.struct(F.xxhash64("text").alias("own"), "text")).alias("least")
        again = rows.join(repeated, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(least).select("doc_id", "least.text", "lang")
        rows = rows.join(repeated, ["doc_id", "lang"], "left_anti").select("doc_id", "text", "lang").union(again)
    order = sorted((r["lang"], r["turn"], bytes(r["x"])) for r in landmark_rows(rows, once))
    marks = np.stack([np.unpackbits(np.frombuffer(x, np.uint8)) for _, _, x in order])
    counts, gram, sides = summed(rows, names, sizes, marks)
    w, b = fit(names, sizes, marks, gram, sides)
    return {"names": np.array(names), "unions": np.packbits(common_grams(counts, sizes), axis=1), "least": floors(rows, names, sizes, counts), "marks": np.packbits(marks, axis=1), "w": w, "b": b}


class Scorer:
    """The model, unpacked in a task."""

    def __init__(self, model: dict | None):
        self.model = model
        if model is not None:
            self.base, self.names = unit(np.unpackbits(model["marks"], axis=1)), [str(x) for x in model["names"]]
            self.unions = np.unpackbits(model["unions"], axis=1).T.astype(np.float32)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (`und` without a letter) and score of each text, and whether enough of its n-grams are that language's."""
        if self.model is None:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        parts, likely = [], []
        for x in rows_of(texts):
            parts.append(kernel(x, self.base) @ self.model["w"] + self.model["b"])
            at = parts[-1].argmax(axis=1)
            likely.append(shares(x, self.unions)[np.arange(len(at)), at] >= self.model["least"][at])
        values = np.concatenate(parts) if parts else np.zeros((0, len(self.names)))
        best = values.argmax(axis=1) if len(values) else np.zeros(0, np.int64)
        top = np.clip((values[np.arange(len(best)), best].astype(np.float64) + 1) / 2, 0, 1)
        known = np.array([HAS_LETTER.search(t.decode()) is not None for t in texts], bool)
        enough = known & np.concatenate(likely) if likely else known
        return [self.names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, top, 0.0), enough


def identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; texts that are null or hold no letter are `und` with score 0."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for rows, texts in common.slices(batches, "text"):
            langs, score, _ = own.predict(texts)
            yield pa.record_batch([rows.column("doc_id"), rows.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (common.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def kept(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter and enough n-grams of its best language.

    Each row is judged by itself, ids may repeat. Without a model, as of an empty table, every row with a letter stays.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared, scored = spark.sparkContext.broadcast(model), common.free(docs.columns, "scored_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for rows, texts in common.slices(batches, scored):
            if shared.value is None:
                good = [HAS_LETTER.search(t.decode()) is not None for t in texts]
            else:
                good = own.predict(texts)[2].tolist()
            part = rows.filter(pa.array(good, pa.bool_()))
            yield pa.record_batch(part.columns[:-1], docs_columns)

    docs_columns = docs.columns
    return docs.select(*docs.columns, F.col("text").cast("string").alias(scored)).mapInArrow(run, docs.schema)

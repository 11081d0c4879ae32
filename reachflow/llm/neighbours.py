"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

With c the coarse centre of x and x = c + s u, |u| = 1, the nearest x to q has the greatest 2 s (q - c).u - s^2 - |q - c|^2,
a maximum inner product. u is quantised in subspaces of two components with 16 centres each, under a loss that weighs
the residual along u more than that across it, since only the former moves the scores of queries that lie near x. A
scan adds up one table entry for each two subspaces; the best of each block of candidates are measured on the original
vectors. Directions from a centre keep vectors apart that differ by little.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachflow.sources.scratch import written

COARSE, CENTRES, WIDTH = 64, 16, 2
#: The codebooks are fitted on so many vectors at most, those of least hash.
MOST_VECTORS, ROUNDS = 8192, 8
#: Share of the norm above which an inner product matters; it sets how much more the parallel residual weighs.
THRESHOLD = 0.2
#: Candidates and queries of one block, and how many candidates a block's scan passes on for each query.
CANDIDATES, QUERIES, PASSED = 8192, 2048, 160


def cut(x: np.ndarray) -> np.ndarray:
    """Rows as subspaces, filled up with zeros to whole ones."""
    lack = -x.shape[1] % (2 * WIDTH)
    return np.pad(x, ((0, 0), (0, lack))).reshape(len(x), -1, WIDTH)


def assign(x: np.ndarray, books: np.ndarray, weight: float, codes: np.ndarray | None = None, rounds: int = 2) -> np.ndarray:
    """The code of each subspace, by descent on the score-aware loss, one subspace after another."""
    norms = np.maximum((x**2).sum(axis=(1, 2)), 1e-30)
    if codes is None:
        codes = np.stack([((x[:, m, None] - books[m]) ** 2).sum(axis=2).argmin(axis=1) for m in range(x.shape[1])], axis=1)
    subspaces = np.arange(x.shape[1])
    along = ((x - books[subspaces, codes]) * x).sum(axis=2)
    total = along.sum(axis=1)
    for _ in range(rounds):
        for m in subspaces:
            r = x[:, m, None] - books[m]
            own = (r * x[:, m, None]).sum(axis=2)
            loss = (r**2).sum(axis=2) + (weight - 1) * ((total - along[:, m])[:, None] + own) ** 2 / norms[:, None]
            codes[:, m] = loss.argmin(axis=1)
            new = own[np.arange(len(x)), codes[:, m]]
            total += new - along[:, m]
            along[:, m] = new
    return codes


def directions(x: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest coarse centre of each row, its distance and the unit vector from there (zero if it is the centre)."""
    own = np.concatenate([((x[i : i + 512, None] - coarse) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(x), 512)])
    rest = x - coarse[own]
    far = np.sqrt((rest**2).sum(axis=1))
    return own, far, rest / np.maximum(far, 1e-300)[:, None]


def coarse_centres(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:COARSE]].copy()
    for _ in range(ROUNDS):
        own = directions(x, centres)[0]
        for c in np.unique(own):
            centres[c] = x[own == c].mean(axis=0)
    return centres


def fit(x: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centres, and codebooks (subspace, centre, component) of the directions of the rows of x from them."""
    rng = np.random.default_rng(seed)
    coarse, d = coarse_centres(x, rng), x.shape[1]
    x = cut(directions(x, coarse)[2])
    weight = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    norms = np.maximum((x**2).sum(axis=(1, 2)), 1e-30)
    books = np.stack([x[rng.integers(0, len(x), CENTRES), m] for m in range(x.shape[1])])
    for _ in range(ROUNDS):  # plain centres first
        for m in range(x.shape[1]):
            own = ((x[:, m, None] - books[m]) ** 2).sum(axis=2).argmin(axis=1)
            size = np.bincount(own, minlength=CENTRES)
            for k in range(WIDTH):
                total = np.bincount(own, x[:, m, k], minlength=CENTRES)
                books[m, :, k] = np.where(size > 0, total / np.maximum(size, 1), books[m, :, k])
    codes = None
    for _ in range(ROUNDS):
        codes = assign(x, books, weight, codes, 1)
        along = ((x - books[np.arange(x.shape[1]), codes]) * x).sum(axis=2)
        total = along.sum(axis=1)
        for m in range(x.shape[1]):
            y, rest = x[:, m], total - along[:, m]
            outer = np.eye(WIDTH) + (weight - 1) * y[:, :, None] * y[:, None, :] / norms[:, None, None]
            right = y + (weight - 1) * y * ((rest + (y * y).sum(axis=1)) / norms)[:, None]
            for c in range(CENTRES):
                of = codes[:, m] == c
                if of.any():
                    books[m, c] = np.linalg.solve(outer[of].sum(axis=0), right[of].sum(axis=0))
            new = ((y - books[m, codes[:, m]]) * y).sum(axis=1)
            total += new - along[:, m]
            along[:, m] = new
    return coarse, books


def encode(x: np.ndarray, coarse: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row two codes a byte; and its coarse centre, its distance s from it, and centre times quantised direction."""
    own, far, u = directions(x, coarse)
    weight = max(1.0, (x.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    codes = assign(cut(u), books, weight)
    back = books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)[:, : x.shape[1]]
    codes = codes.astype(np.uint8)
    return codes[:, ::2] << 4 | codes[:, 1::2], np.stack([own, far, (coarse[own] * back).sum(axis=1)], axis=1)


def scan(queries: np.ndarray, packed: np.ndarray, extra: np.ndarray, coarse: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate negative squared distances of all queries (rows) and candidates (columns), from tables of two subspaces each."""
    tables = np.einsum("qmk,mck->qmc", cut(queries), books).astype(np.float32)
    pairs = (tables[:, ::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)
    out = np.zeros((len(queries), len(packed)), np.float32)
    for m in range(packed.shape[1]):
        out += pairs[:, m][:, packed[:, m]]
    centre, far, shift = extra[:, 0].astype(np.int64), extra[:, 1].astype(np.float32), extra[:, 2].astype(np.float32)
    away = ((queries[:, None] - coarse) ** 2).sum(axis=2).astype(np.float32)
    return 2 * far * (out - shift) - far**2 - away[:, centre]


def matrix(binary: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), np.float64).reshape(len(binary), -1)


def nearest_in_block(candidates: pa.Table, queries: pa.Table, coarse: np.ndarray, books: np.ndarray, k: int) -> pa.Table:
    """The k nearest candidates of each query, measured exactly among those that the scan passes on."""
    x, q = matrix(candidates.column("x")), matrix(queries.column("x"))
    ids = candidates.column("rep").to_numpy()
    packed = np.frombuffer(b"".join(candidates.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
    extra, out = matrix(candidates.column("extra")), []
    for i in range(0, len(q), 64):
        part = q[i : i + 64]
        scores = scan(part, packed, extra, coarse, books)
        most = min(PASSED, len(ids))
        best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
        for j in range(len(part)):
            far = np.sqrt(((x[best[j]] - part[j]) ** 2).sum(axis=1))
            order = np.lexsort((ids[best[j]], far))[:k]
            out.append((np.full(len(order), i + j), ids[best[j]][order], far[order]))
    at = np.concatenate([o[0] for o in out])
    return pa.table({"q": queries.column("q").to_numpy()[at], "rep": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of doubles) of the rows that take part.

    Not those with a null id, a null, empty or zero vector, a null or non-finite component, or of another dimension
    than most rows have (of equally frequent ones the greatest).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and size(x) > 0")
    huge = float("inf")
    good = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(huge))) & F.exists("x", lambda v: v != 0))
    sizes = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size("x") == (sizes["d"] if sizes else -1))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose vec_id is divisible by `every`.

    Equal vectors are searched once, as one candidate and one query, and told apart afterwards: of a class of equal
    vectors the k + 1 least ids can be in a result. Rows that take no part: see usable(). Rows of one id count as one
    each; a query leaves out all rows of its own id. The index holds every usable row; only the codebooks are fitted on a bounded sample.
    """
    spark = vectors.sparkSession
    base = usable(vectors).withColumn("key", F.xxhash64("x"))
    in_class = Window.partitionBy("key", "x").orderBy("vec_id")
    first = base.withColumn("turn", F.row_number().over(in_class)).where(F.col("turn") <= k + 1).withColumn("rep", F.min("vec_id").over(in_class))
    members = written(first.select("rep", "vec_id", "key", F.when(F.col("turn") == 1, F.col("x")).alias("x")))
    reps = members.where("x is not null").select("rep", "key", "x")
    as_bytes = "rep long, key long, x binary"

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array(v, np.float64).tobytes() for v in b.column("x").to_pylist()]
            yield pa.record_batch([b.column("rep"), b.column("key"), pa.array(rows, pa.binary())], ["rep", "key", "x"])

    reps = reps.mapInArrow(to_bytes, as_bytes)
    n = members.where("x is not null").count()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "rep", "x")), strict=True))
        if rows:
            file = io.BytesIO()
            coarse, books = fit(np.stack([np.frombuffer(r[2], np.float64) for r in rows]))
            np.savez(file, coarse=coarse, books=books)
            yield pa.record_batch([pa.array([file.getvalue()], pa.binary())], ["books"])

    sample = reps.orderBy("key", "rep").limit(MOST_VECTORS)
    found = sample.repartition(1).mapInArrow(learn, "books binary").collect()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = np.load(io.BytesIO(found[0]["books"]))
    shared = spark.sparkContext.broadcast((fitted["coarse"], fitted["books"]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                packed, extra = encode(matrix(b.column("x")), *shared.value)
                yield pa.record_batch([b.column("rep"), b.column("key"), b.column("x"), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array([e.tobytes() for e in extra], pa.binary())], ["rep", "key", "x", "codes", "extra"])

    indexed = reps.mapInArrow(index, as_bytes + ", codes binary, extra binary")
    asking = base.where(F.col("vec_id") % every == 0).select("vec_id", "key", "x").distinct()
    # Queries of equal vectors share a class, named by the least of their ids.
    asked = written(asking.withColumn("q", F.min("vec_id").over(Window.partitionBy("key", "x"))).select("q", "vec_id", F.when(F.col("vec_id") == F.col("q"), F.col("x")).alias("x"), "key"))
    queries = asked.where("x is not null").select(F.col("q").alias("rep"), "key", "x").mapInArrow(to_bytes, as_bytes).withColumnRenamed("rep", "q")
    rows, columns = max(1, -(-n // CANDIDATES)), max(1, -(-asked.where("x is not null").count() // QUERIES))
    left = indexed.withColumn("row", F.pmod("key", F.lit(rows))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).select("row", "column", "rep", "x", "codes", "extra")
    right = queries.withColumn("column", F.pmod("key", F.lit(columns)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long")))).select("row", "column", "q", "x")

    def block(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return nearest_in_block(candidates, queries, *shared.value, k + 1)

    near = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(block, "q long, rep long, score double")
    near = near.withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy("score", "rep"))).where(F.col("turn") <= k + 1).drop("turn")
    pairs = near.join(members.select("rep", "vec_id"), "rep").join(asked.select("q", F.col("vec_id").alias("query_id")), "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Hard negatives by maximum inner product within score windows, over an STR-packed R-tree.

Spark packs the tree: rows are dealt by label and the coordinate that varies most into slabs of some SLAB rows, each slab is
sorted by label and the coordinate that varies next, and every LEAF rows of a label make a leaf. A leaf knows its minimum
bounding box, a slab one box for each of its labels. A box bounds the inner product with a query from below and
above, coordinate by coordinate. Queries go to the slabs that their bounds leave: first each to its best one, then with the score
of its k-th best row so far to the others. Within a slab the best leaves come first. A box is left out if it lies outside the
query's window or strictly below its k-th score, as equal scores may still have smaller ids; so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachflow.llm import common

#: Rows of a slab and of a leaf. A task holds one slab.
SLAB, LEAF = 32_768, 64
#: Boxes of slabs, and queries, that a task bounds at once; queries that search a slab at once.
BOXES, ASKS = 1_024, 8_192
#: Queries whose bounds a task holds as one matrix.
AT_ONCE = 512
SCALE = 256
EXACT = float(1 << 53)
INF = float("inf")
LONG = (-(1 << 63), (1 << 63) - 1)
LEAVES = "slab int, label long, ids binary, low binary, high binary, rows binary"
ASKED = "ask long, anchor long, label long, same boolean, k int, least double, most double, x binary"
FOUND = "ask long, score double, id long"


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Binary rows of doubles as a matrix."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), np.float64)
    return flat.reshape(len(rows), -1) if rows else np.zeros((0, width or 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers; exact, as those beyond 53 bits are taken as Python integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a], object).reshape(len(a), len(b))


def bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of each row of x with any point of each box, or somewhat beyond."""
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    if x.size and low.size and np.abs(x).max() * max(np.abs(low).max(), np.abs(high).max()) * x.shape[1] >= EXACT:
        slack = (np.abs(x) @ np.maximum(np.abs(low), np.abs(high)).T) * 1e-12
        return least - slack, most + slack
    return least, most


def usable(vectors: DataFrame, relabel: Column | None = None) -> DataFrame:
    """id, label, x (array of doubles, each floor(256 * x)) of the rows that take part.

    Not those with a null id, label or vector, with a null or non-finite component (or one whose 256-fold is), or of
    another dimension than most rows have (of equally frequent ones the greatest). Zero vectors take part.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda v: v * float(SCALE)).alias("x"))
    good = rows.where("id is not null and label is not null and x is not null").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(INF))))
    sizes = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    good = good.where(F.size("x") == (sizes["d"] if sizes else -1))
    return good.withColumn("label", relabel) if relabel is not None else good


def widest(df: DataFrame) -> list[int]:
    """The two coordinates of x that vary most."""
    spread = df.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.variance("v").alias("spread")).orderBy(F.desc_nulls_last("spread"), "at").limit(2)
    axes = [r["at"] for r in spread.collect()]
    return (axes + axes)[:2] if axes else [0, 0]


def few_copies(df: DataFrame, most: int) -> DataFrame:
    """df (id, label, x) without the copies of a vector, of one label, that no search for `most` rows can need.

    A search leaves out the rows of one id, so that of equal rows those of the most + 1 least ids can be found, `most` of each.
    Spark drops the others in each task before it shuffles the rest.
    """
    keyed = df.withColumn("key", F.xxhash64("x"))
    turn = F.row_number().over(Window.partitionBy("key", "label", "x", "id").orderBy("id"))
    place = F.dense_rank().over(Window.partitionBy("key", "label", "x").orderBy("id"))
    once = keyed.withColumn("turn", turn).where(F.col("turn") <= most).drop("turn")
    return once.withColumn("place", place).where(F.col("place") <= most + 1).select(*df.columns)


def as_rows(df: DataFrame, axes: list[int]) -> DataFrame:
    """row (a number of its own), id, label, x (binary, floored), first and second (its coordinates of the two axes): a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.floor(np.array(v, np.float64)) + 0.0 for v in b.column("x").to_pylist()]
            yield pa.record_batch([b.column("id"), b.column("label"), b.column("first"), b.column("second"), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "label", "first", "second", "x"])

    flat = df.select("id", "label", "x", F.get("x", F.lit(axes[0])).alias("first"), F.get("x", F.lit(axes[1])).alias("second"))
    flat = flat.mapInArrow(run, "id long, label long, first double, second double, x binary")
    return common.written(flat.withColumn("row", F.monotonically_increasing_id()))


def packed(rows: DataFrame, slab: int = SLAB) -> DataFrame:
    """The leaves of the tree: slab, label, ids, low, high, rows (doubles, row after row); a written table.

    Equal rows are told apart by their row number, so that they fill as many slabs as they take.
    """
    slabs = max(1, -(-rows.count() // slab))
    dealt = rows.repartitionByRange(slabs, "label", "first", "row").sortWithinPartitions("label", "second", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, label = [], None

        def leaf() -> tuple:
            points = np.stack([np.frombuffer(x, np.float64) for _, x in held])
            return label, np.array([i for i, _ in held], np.int64).tobytes(), points.min(axis=0).tobytes(), points.max(axis=0).tobytes(), points.tobytes()

        def record(leaves: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), *[pa.binary()] * 4]
            return pa.record_batch([pa.array([x[k] for x in leaves], kind) for k, kind in enumerate(kinds)], ["label", "ids", "low", "high", "rows"])

        for b in batches:
            done = []
            for i, own, x in zip(*(b.column(c).to_pylist() for c in ("id", "label", "x")), strict=True):
                if held and (own != label or len(held) == LEAF):
                    done.append(leaf())
                    held = []
                label = own
                held.append((i, x))
            if done:
                yield record(done)
        if held:
            yield record([leaf()])

    leaves = dealt.select("id", "label", "x").mapInArrow(run, "label long, ids binary, low binary, high binary, rows binary")
    return common.written(leaves.select(F.spark_partition_id().alias("slab"), "*"))


def directory(leaves: DataFrame) -> DataFrame:
    """slab, label, low, high of each label of each slab, and chunk, the number of a group of some BOXES of them; a written table."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        low, high = matrix(own.column("low")).min(axis=0), matrix(own.column("high")).max(axis=0)
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int32()), "label": [key[1].as_py()], "low": [low.tobytes()], "high": [high.tobytes()]})

    boxes = common.written(leaves.select("slab", "label", "low", "high").groupBy("slab", "label").applyInArrow(run, "slab int, label long, low binary, high binary"))
    return boxes.withColumn("chunk", F.pmod(F.xxhash64("slab", "label"), F.lit(max(1, -(-boxes.count() // BOXES)))).cast("int"))


def reached(boxes: DataFrame, asks: DataFrame) -> DataFrame:
    """ask, slab, bound (the greatest score that the slab may have in the window) where boxes don't rule a slab out; a written table.

    Blocks of queries meet blocks of boxes.
    """
    chunks, shares = boxes.agg(F.max("chunk")).first()[0], max(1, -(-asks.count() // ASKS))
    if chunks is None:
        return asks.sparkSession.createDataFrame([], "ask long, slab int, bound double")
    to = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n))).alias(name)
    left = boxes.select("chunk", to(shares - 1, "share"), "slab", "label", "low", "high")
    right = asks.select(to(chunks, "chunk"), F.pmod(F.xxhash64("ask"), F.lit(shares)).cast("int").alias("share"), *asks.columns)

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        low, high = matrix(own.column("low")), matrix(own.column("high"))
        slabs, labels = own.column("slab").to_numpy(), own.column("label").to_numpy()
        parts = []
        for begin in range(0, asked.num_rows if len(slabs) else 0, AT_ONCE):
            a = asked.slice(begin, AT_ONCE)
            least, most = bounds(matrix(a.column("x")), low, high)
            ok = (labels == a.column("label").to_numpy()[:, None]) == a.column("same").to_numpy(zero_copy_only=False)[:, None]
            floor, ceiling = (a.column(c).to_numpy()[:, None] for c in ("least", "most"))
            i, j = np.nonzero(ok & (most >= floor) & (least <= ceiling))
            parts.append((a.column("ask").to_numpy()[i], slabs[j], np.minimum(most, ceiling)[i, j]))
        kinds = (np.int64, np.int32, np.float64)
        return pa.table({c: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kinds[k]) for k, c in enumerate(("ask", "slab", "bound"))})

    met = left.groupBy("chunk", "share").cogroup(right.groupBy("chunk", "share")).applyInArrow(run, "ask long, slab int, bound double")
    return common.written(met.groupBy("ask", "slab").agg(F.max("bound").alias("bound")))


class Best:
    """The k best rows so far of each query: greatest score first, then least id."""

    def __init__(self, k: np.ndarray, least: np.ndarray):
        self.k, self.floor = k, least.copy()
        self.ask, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if not parts:
            return
        ask, score, own = (np.concatenate([mine, *[p[n] for p in parts]]) for n, mine in enumerate((self.ask, self.score, self.id)))
        order = np.lexsort((own, -score, ask))
        ask, score, own = ask[order], score[order], own[order]
        first = np.flatnonzero(np.append(True, ask[1:] != ask[:-1])) if len(ask) else np.zeros(0, np.int64)
        turn = np.arange(len(ask)) - np.repeat(first, np.diff(np.append(first, len(ask))))
        stay = turn < self.k[ask]
        last = turn == self.k[ask] - 1
        self.floor[ask[last]] = np.maximum(self.floor[ask[last]], score[last])
        self.ask, self.score, self.id = ask[stay], score[stay], own[stay]


def search(leaves: pa.Table, asked: pa.Table) -> tuple[pa.Table, int]:
    """The k best rows of one slab for each query, within its window and not below its least score; and how many pairs of query and leaf were looked at.

    The leaves of a query are taken by their bound, in turns of one, two, four and so on, until their bound is below the k-th score.
    """
    low, high = matrix(leaves.column("low")), matrix(leaves.column("high"))
    labels, width = leaves.column("label").to_numpy(), low.shape[1] if len(low) else 0
    points = [np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width) for x in leaves.column("rows")] if width else [np.zeros((len(x.as_buffer()) // 8, 0)) for x in leaves.column("ids")]
    ids = [np.frombuffer(x.as_buffer(), np.int64) for x in leaves.column("ids")]
    out, looked = [], 0
    for begin in range(0, asked.num_rows, AT_ONCE):
        a = asked.slice(begin, AT_ONCE)
        x, same = matrix(a.column("x"), width), a.column("same").to_numpy(zero_copy_only=False)
        own, anchor, most = (a.column(c).to_numpy() for c in ("label", "anchor", "most"))
        best = Best(a.column("k").to_numpy().astype(np.int64), a.column("least").to_numpy())
        under, over = bounds(x, low, high)
        ok = ((labels == own[:, None]) == same[:, None]) & (under <= most[:, None])
        reach = np.where(ok, np.minimum(over, most[:, None]), -INF)
        order = np.argsort(-reach, axis=1, kind="stable")
        at, step = 0, 1
        while at < len(labels):
            these = order[:, at : at + step]
            bound = np.take_along_axis(reach, these, axis=1)
            i, j = np.nonzero((bound >= best.floor[:, None]) & (bound > -INF))
            if not len(i):
                break
            leaf, found = these[i, j], []
            looked += len(leaf)
            by = np.argsort(leaf, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                n, q = leaf[group[0]], i[group]
                scores = products(x[q], points[n])
                good = (scores >= best.floor[q, None]) & (scores <= most[q, None]) & ((ids[n] != anchor[q, None]) | ~same[q, None])
                r, c = np.nonzero(good)
                if len(r):
                    found.append((q[r], scores[r, c].astype(np.float64) if scores.dtype != object else scores[r, c], ids[n][c]))
            best.add(found)
            at, step = at + step, 2 * step
        out.append((a.column("ask").to_numpy()[best.ask], best.score, best.id))
    kinds = (np.int64, np.float64, np.int64)
    columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, kinds[k]) for k in range(3)]
    return pa.table({c: v.astype(kinds[k]) for k, (c, v) in enumerate(zip(("ask", "score", "id"), columns, strict=True))}), looked


def visited(leaves: DataFrame, asks: DataFrame, slabs: DataFrame) -> DataFrame:
    """FOUND of the queries (asks) in the slabs (ask, slab): a slab meets blocks of at most some ASKS of its queries."""
    shares = slabs.groupBy("slab").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("shares"))
    dealt = slabs.select("ask", "slab").join(shares, "slab").withColumn("share", F.pmod(F.xxhash64("ask"), F.col("shares")).cast("int"))
    right = asks.join(dealt.select("ask", "slab", "share"), "ask")
    left = leaves.join(shares, "slab").select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        return search(own, asked)[0]

    return left.groupBy("slab", "share").cogroup(right.groupBy("slab", "share")).applyInArrow(run, FOUND)


def top(found: DataFrame, asks: DataFrame) -> DataFrame:
    """ask, score, id, rank: the k best rows of each query."""
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id")).alias("rank")
    return found.join(asks.select("ask", "k"), "ask").select("ask", "score", "id", "k", rank).where("rank <= k").select("ask", "score", "id", "rank")


def best(leaves: DataFrame, boxes: DataFrame, asks: DataFrame) -> DataFrame:
    """ask, score, id, rank: the k best rows of each query within its window [least, most], of its own label or of all others; a written table.

    Every query first visits the slab of the greatest bound; then, with its k-th score as its least one, those that their bounds don't rule out.
    """
    slabs = reached(boxes, asks)
    first = common.written(slabs.groupBy("ask").agg(F.max_by("slab", F.struct("bound", "slab")).alias("slab")))
    found = common.written(visited(leaves, asks, first))
    kth = top(found, asks).join(asks.select("ask", "k"), "ask").where("rank = k").select("ask", F.col("score").alias("kth"))
    raised = asks.join(kth, "ask", "left").withColumn("least", F.greatest("least", F.coalesce("kth", F.lit(-INF)))).select(*asks.columns)
    raised = common.written(raised)
    rest = slabs.join(first, ["ask", "slab"], "left_anti").join(raised.select("ask", "least"), "ask").where("bound >= least").select("ask", "slab")
    more = visited(leaves, raised, common.written(rest))
    return common.written(top(found.union(more), asks))


def as_long(column: str) -> Column:
    """A whole double as a long; beyond its bounds the bound."""
    return F.when(F.col(column) >= float(LONG[1]), F.lit(LONG[1])).when(F.col(column) <= float(LONG[0]), F.lit(LONG[0])).otherwise(F.expr(f"try_cast({column} AS BIGINT)"))


def mined(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), relabel: Column | None = None, slab: int = SLAB) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`. Scores are inner products of the floored vectors; more comes
    first, of equal ones the least vec_id. An anchor's positives are its first other rows (of another vec_id) of
    its label, its negatives to each of them the first rows of other labels with
    window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score. Rows that take no part: see usable().
    Repeated ids are rows of their own, as positives, negatives and anchors; equal rows tie. Scores beyond 53 bits are
    compared as doubles, and end at the bounds of a long. An anchor without positives or negatives has no row; an
    empty table has none. Other columns are left out.
    """
    rows = usable(vectors, relabel)
    axes = widest(rows)
    leaves = packed(as_rows(few_copies(rows, max(positives, negatives)), axes), slab)
    boxes = directory(leaves)
    anchors = as_rows(rows.where(F.col("id") % every == 0), axes)
    asks = anchors.select(F.col("row").alias("ask"), F.col("id").alias("anchor"), "label", F.lit(True).alias("same"), F.lit(positives).alias("k"), F.lit(-INF).alias("least"), F.lit(INF).alias("most"), "x")
    near = best(leaves, boxes, common.written(asks)).select(F.col("ask").alias("row"), F.col("id").alias("positive_id"), "score", F.col("rank").alias("turn"))
    # Positives of equal scores have one window.
    whole = F.when(F.abs("score") < EXACT, F.col("score")).cast("decimal(38,0)")
    low, high = (F.coalesce(f(whole * w / 100).cast("double"), F.col("score") * (w / 100)) for f, w in ((F.ceil, window[0]), (F.floor, window[1])))
    windows = near.select("row", "score").distinct().select("row", "score", low.alias("least"), high.alias("most")).where("least <= most")
    windows = common.written(windows.withColumn("ask", F.monotonically_increasing_id()))
    asks = windows.join(anchors.select("row", F.col("id").alias("anchor"), "label", "x"), "row").select("ask", "anchor", "label", F.lit(False).alias("same"), F.lit(negatives).alias("k"), "least", "most", "x")
    far = best(leaves, boxes, common.written(asks)).select("ask", F.col("score").alias("negative"), F.col("id").alias("negative_id"), "rank")
    pairs = near.join(windows.select("ask", "row", "score"), ["row", "score"]).join(far, "ask").join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", as_long("score").alias("positive_score"), as_long("negative").alias("negative_score"))


def seventh() -> Column:
    """The label of the registered query: that of every seventh id is moved on by one of ten."""
    return F.when(F.col("id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))


def oracle() -> str:
    """The same rows in SQL, from all pairs of anchors and rows."""
    return """
WITH raw AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
good AS (SELECT row_number() OVER () AS r, id, label, x FROM raw WHERE len(list_filter(e, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pairs AS (SELECT a.r, a.id AS anchor_id, b.r AS br, b.id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM good a, good b WHERE a.id % 100 = 0 AND a.id <> b.id),
positives AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id, br) AS turn FROM pairs WHERE same),
met AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.br ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN pairs n ON p.r = n.r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score WHERE p.turn <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 10
"""

"""Near-duplicates of documents by fast similarity sketching, banding and exact verification.

A set is sketched in rounds: in each of the first COORDINATES rounds every element falls into a hashed bin with a
hashed value, in the following ones all elements fall into one bin after another, and a coordinate keeps the least
value of the earliest round that reached it. So every coordinate fills, and the share of equal coordinates of two sets
concentrates about their similarity. Bands of equal coordinates propose links, whole sets confirm them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachflow.llm import common
from reachflow.operators.components import connected_components
from reachflow.sources.scratch import bucketed

WORDS = 5
#: 32 bands of 5: two sets of similarity 0.85 meet in no band with a probability of 7e-9, of 0.8 with 3e-6.
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
SIMILARITY = 85
#: Bytes and number of the sets of a block, of which one side of a tile is held at a time, and number of those compared with one pivot.
BLOCK_BYTES, BLOCK_SETS, STAR_SETS = 8_000_000, 512, 128
#: Sets compared and shared elements multiplied at once.
ROWS_AT_ONCE, COLUMNS = 256, 8192
#: Ids of so many documents that share a bucket are broadcast.
MOST_BROADCAST = 2_000_000
#: Rows of equal texts take their class in so many shares.
SALTS = 16
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = np.uint64(0xD6E8FEB86659FD93)
SEEDS = common.mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TURN = np.uint64(32)


def chained(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences of words: each word's hash goes through the finaliser with all before it."""
    out = np.zeros(len(words[0]), np.uint64)
    for word in words:
        out = common.mixed(out * STEP + word)
    return out


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles.

    Texts are lower-cased in A-Z and split at ASCII white space; fewer words than a shingle has make one shingle of
    the whole sequence, no words the empty set.
    """
    data, begins = common.joined(texts)
    data = LOWER[data]
    starts, hashes = common.word_hashes(data, ~SPACE[data])
    first = np.searchsorted(starts, begins)
    full = np.zeros(0, np.uint64)
    if len(hashes) >= words:
        full = chained([hashes[j : len(hashes) - words + 1 + j] for j in range(words)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            out.append(common.mixed(chained([hashes[k : k + 1] for k in range(a, b)]) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(elements: np.ndarray) -> np.ndarray:
    """The COORDINATES values of a set with elements; rounds are taken in blocks, as a later one changes nothing."""
    t, rounds = COORDINATES, 2 * COORDINATES
    out = np.full(t, np.iinfo(np.uint64).max)
    at, step = 0, min(t, max(1, 800 // len(elements)))
    while at < rounds:
        till = min(at + step, t if at < t else rounds)
        x = common.mixed((elements[None, :] + SEEDS[at:till, None]).reshape(-1))
        turn = np.repeat(np.arange(at, till, dtype=np.uint64), len(elements))
        places = (((x >> TURN) * np.uint64(t)) >> TURN).astype(np.int64) if at < t else turn.astype(np.int64) - t
        np.minimum.at(out, places, (turn << TURN) | (x & np.uint64(0xFFFFFFFF)))
        if out.max() < np.iinfo(np.uint64).max:
            break
        at = till
    return out


_BAND_SEED = SEEDS[:BANDS]
_BAND_TIMES = common.powers(ROWS, 0xA0761D6478BD642F)


def bands(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, which holds the band's number too."""
    return common.mixed((coordinates.reshape(BANDS, ROWS) * _BAND_TIMES).sum(axis=1, dtype=np.uint64) + _BAND_SEED)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (fingerprints of the set), bands (null for an empty set) of every row."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.slices(batches, "text"):
            n, fp1, fp2, keys = [], [], [], []
            for s in shingle_sets(texts):
                n.append(len(s))
                for into, value in zip((fp1, fp2), fingerprints(s), strict=True):
                    into.append(value)
                keys.append(bands(sketch(s)).view(np.int64).tolist() if len(s) else None)
            yield pa.record_batch([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of a set's elements."""
    return int(common.mixed(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(common.mixed(s ^ common.MIX1)).view(np.int64)) if len(s) else 0


def set_table(texts: DataFrame) -> DataFrame:
    """doc, set (binary, sorted little-endian 64-bit hashes) of the rows (text, node, fp1, fp2) whose set has the fingerprints."""
    common.small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in common.slices(batches, "text"):
            sets = shingle_sets(own)
            good = [fingerprints(s) == f for s, f in zip(sets, zip(rows.column("fp1").to_pylist(), rows.column("fp2").to_pylist(), strict=True), strict=True)]
            part = pa.record_batch([rows.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "set"])
            yield part.filter(pa.array(good, pa.bool_()))

    return texts.select("text", "node", "fp1", "fp2").mapInArrow(run, "doc long, set binary")


def elements(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of all sets, the number of the set that each is of, and the sets' sizes."""
    sizes = np.array([len(x) // 8 for x in sets], np.int64)
    return np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(len(sets)), sizes), sizes


def intersections(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sizes of the intersections of all sets of a (rows) and b (columns), as products of their incidence matrices."""
    ea, ra, _ = elements(a)
    eb, rb, _ = elements(b)
    shared = np.intersect1d(np.unique(ea), np.unique(eb), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, len(shared), COLUMNS):
        part = shared[i : i + COLUMNS]
        sides = []
        for e, r, n in ((ea, ra, len(a)), (eb, rb, len(b))):
            at = np.minimum(np.searchsorted(part, e), len(part) - 1)
            here = np.flatnonzero(part[at] == e)
            m = np.zeros((n, len(part)), np.float32)
            m[r[here], at[here]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links (i, j) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def comparer(similarity: int):
    """A task's work on rows (tile, side, doc, set) sorted by tile and side: the links that connect what confirmed pairs connect.

    Of a tile, the sets of side 0 are held; those of side 1 stream by and are compared with them, those of side 2 are
    held too and compared with each other.
    """

    def confirmed(a: tuple[np.ndarray, list[bytes]], b: tuple[np.ndarray, list[bytes]]) -> pa.RecordBatch:
        docs = np.concatenate((a[0], b[0]))
        na, nb = (np.array([len(x) // 8 for x in side[1]]) for side in (a, b))
        found = []
        for i in range(0, len(na), ROWS_AT_ONCE):
            for j in range(0, len(nb), ROWS_AT_ONCE):
                one, two = slice(i, i + ROWS_AT_ONCE), slice(j, j + ROWS_AT_ONCE)
                least, most = np.minimum(na[one][:, None], nb[two]), np.maximum(na[one][:, None], nb[two])
                if not (100 * least >= similarity * most).any():
                    continue
                both = intersections(a[1][one], b[1][two])
                x, y = np.nonzero(100 * both >= similarity * (na[one][:, None] + nb[two] - both))
                found.append((x + i, y + j + len(na)))
        x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        label = forest(len(docs), x, y)
        moved = np.flatnonzero(label != np.arange(len(docs)))
        return pa.record_batch([pa.array(docs[moved]), pa.array(docs[label[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, whole = None, ([], []), False
        for rows, sets in common.slices(batches, "set"):
            tiles, sides, docs = (rows.column(c).to_pylist() for c in ("tile", "side", "doc"))
            i = 0
            while i < len(docs):
                if tiles[i] != tile:
                    if whole:
                        yield confirmed(*[(np.array(held[0]), held[1])] * 2)
                    tile, held, whole = tiles[i], ([], []), False
                j = i
                while j < len(docs) and tiles[j] == tile and sides[j] == sides[i]:
                    j += 1
                if sides[i] == 1:
                    if held[0]:
                        yield confirmed((np.array(held[0]), held[1]), (np.array(docs[i:j]), sets[i:j]))
                else:
                    held[0].extend(docs[i:j]), held[1].extend(sets[i:j])
                    whole |= sides[i] == 2
                i = j
        if whole:
            yield confirmed(*[(np.array(held[0]), held[1])] * 2)

    return run


def confirmed_links(placed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """a, b: links confirmed within the tiles of placed (tile, side, doc), each row with its set; a written table."""
    rows = sets.join(placed.hint("merge"), "doc").select("tile", "side", "doc", "set")
    dealt = rows.repartition("tile").sortWithinPartitions("tile", "side")
    return common.narrow(dealt.mapInArrow(comparer(similarity), "a long, b long").distinct())


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component of all nodes that labels or links know, after the links join what labels tell apart; a written table."""
    if labels is None:
        return connected_components(links)
    named = links
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        named = named.join(own, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    joined = connected_components(named, "c_a", "c_b").select(F.col("node").alias("old"), F.col("component").alias("new"))
    every = labels.union(named.select("a", "c_a")).union(named.select("b", "c_b")).distinct()
    return common.narrow(every.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")))


def distinct_buckets(met: DataFrame) -> DataFrame:
    """met (bucket, doc, n) with one bucket of those that hold the same documents."""
    sums = met.groupBy("bucket").agg(F.count("*").alias("k"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("s1"), F.sum(F.xxhash64("doc", F.lit(1)).cast("decimal(20,0)")).alias("s2"))
    return met.join(sums.groupBy("k", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "k"), "bucket")


def shares_of(elements: Column, sets: Column, most_sets: int) -> Column:
    """How many blocks so many sets of so many elements in total make."""
    return F.greatest(F.ceil(elements * 8 / BLOCK_BYTES), F.ceil(sets / most_sets)).cast("int")


def linked(docs: DataFrame, classes: DataFrame, met: DataFrame, similarity: int) -> DataFrame:
    """node, component of the classes that confirmed links connect; met (bucket, doc, n): which classes meet in a bucket, with n elements."""
    live = common.narrow(distinct_buckets(met))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = live.groupBy(F.col("doc").alias("node")).agg(F.max("n").alias("n"))
    asked = common.narrow(asked.join(classes.select("node", "rep", "fp1", "fp2"), "node").select(F.col("rep").alias("doc_id"), "node", "fp1", "fp2", "n"))
    size = asked.agg(F.count("*"), F.sum("n")).first()
    # Some 40 bytes a class are broadcast up to a size; beyond it the texts are shuffled to them.
    texts = texts.join(F.broadcast(asked) if size[0] <= MOST_BROADCAST else asked.hint("merge"), "doc_id")
    buckets = common.tasks_for(8 * size[1])  # bucketed by document, the sets stay where they are in all the joins below
    sets = bucketed(set_table(texts).repartition(buckets, "doc").groupBy("doc").agg(F.min("set").alias("set")), "doc", buckets)
    labels, before, turn = None, None, 0
    while True:
        state = live if labels is None else live.join(labels.withColumnRenamed("node", "doc"), "doc", "left")
        state = state.withColumn("class", F.coalesce("component", "doc") if labels is not None else F.col("doc"))
        # The largest class of each bucket, and one member of it; another one in each round.
        pick = F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), F.col("doc").alias("doc"), F.col("n").alias("n"))).alias("pick")
        classes = state.groupBy("bucket", "k", "class").agg(F.count("*").alias("size"), pick)
        largest = classes.groupBy("bucket", "k").agg(F.max(F.struct("size", -F.col("class"), "pick")).alias("top"))
        # A bucket of two needs one comparison, whatever it says.
        largest = largest.where("top.size < k" + (" and k > 2" if turn else ""))
        top = largest.select("bucket", (-F.col("top.col2")).alias("top"), F.col("top.pick.doc").alias("pivot"), F.col("top.pick.n").alias("pivot_n"))
        state = common.narrow(state.select("bucket", "k", "doc", "n", "class").join(top, "bucket"))
        rest = state.where("class <> top")
        open_ = rest.count()
        if not open_ or (before is not None and 2 * open_ > before):
            break
        before, turn = open_, turn + 1
        alike = 100 * F.least("n", "pivot_n") >= similarity * F.greatest("n", "pivot_n")  # other sizes can't be linked
        pairs = common.narrow(rest.where(alike).select("doc", "pivot", "n").distinct())
        shares = pairs.groupBy("pivot").agg(shares_of(F.sum("n"), F.count("*"), STAR_SETS).alias("shares"))
        pairs = pairs.join(shares, "pivot").select("doc", "pivot", F.pmod(F.xxhash64("doc"), F.col("shares")).alias("share"))
        tile = F.struct("pivot", "share").alias("tile")
        stars = pairs.select(tile, F.lit(1).alias("side"), "doc").union(pairs.select("pivot", "share").distinct().select(tile, F.lit(0), F.col("pivot")))
        labels = relabelled(labels, confirmed_links(stars, sets, similarity))
        live = state.select("bucket", "k", "doc", "n")
    if open_:
        # What is left of each bucket, against itself and against its largest class.
        sides = ((F.col("class") != F.col("top"), "n_rest"), (F.col("class") == F.col("top"), "n_top"))
        sums = state.groupBy("bucket").agg(*[shares_of(F.sum(F.when(own, F.col("n"))), F.count_if(own), BLOCK_SETS).alias(name) for own, name in sides])
        rows = state.join(sums, "bucket").withColumn("is_top", F.col("class") == F.col("top"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), F.when(F.col("is_top"), F.col("n_top")).otherwise(F.col("n_rest"))).cast("int"))
        to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")  # noqa: E731
        tile = F.struct("bucket", "kind", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        within = rows.where("not is_top").select("bucket", F.lit(0).alias("kind"), "doc", "own", to("n_rest")).select(tile.alias("tile"), side.alias("side"), "doc")
        across = F.struct("bucket", F.lit(1).alias("kind"), F.col("r").alias("i"), F.col("t").alias("j")).alias("tile")
        held = rows.where("not is_top").select("bucket", "doc", F.col("own").alias("r"), to("n_top").alias("t")).select(across, F.lit(0).alias("side"), "doc")
        passing = rows.where("is_top").select("bucket", "doc", to("n_rest").alias("r"), F.col("own").alias("t")).select(across, F.lit(1).alias("side"), "doc")
        labels = relabelled(labels, confirmed_links(within.union(held).union(passing), sets, similarity))
    return labels


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: linked documents have the least doc_id they reach.

    Documents of equal sets are one class, represented by a row of its least id. Classes that meet in a band's bucket are
    compared on their whole sets; no bucket has a cap.
    Rows with an empty set are alone; rows without an id are linked with nothing, have no component and are kept.
    Rows that repeat an id are one document: what any of their texts is linked with is linked with all of them. A row whose
    own set is empty is alone even so. Other columns are left out.
    """
    sk = common.written(sketches(docs))
    linkable, keys = sk.where("n_shingles > 0 and doc_id is not null"), ["fp1", "fp2", "n_shingles"]
    classes = linkable.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    classes = common.written(classes.hint("rebalance").withColumn("node", F.monotonically_increasing_id()))
    reps = linkable.join(classes.select(F.col("rep").alias("doc_id"), *keys, "node"), ["doc_id", *keys])
    dealt = reps.select(F.col("node").alias("doc"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("bucket")
    met = common.narrow(dealt.join(shared, "bucket", "left_semi"))
    met = common.narrow(met.groupBy("bucket", "doc").agg(F.max("n").alias("n")))  # rows may repeat; by itself, so that a large bucket is split
    labels = None if met.isEmpty() else linked(docs, classes, met, similarity)
    # Ids with texts of several sets link their classes.
    one = F.struct(*keys)
    odd = common.narrow(linkable.groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("doc_id"))
    if not odd.isEmpty():
        several = linkable.join(odd, "doc_id", "left_semi").select("doc_id", *keys).distinct().join(classes.select(*keys, "node"), keys)
        first = several.groupBy("doc_id").agg(F.min("node").alias("a"))
        labels = relabelled(labels, common.narrow(several.join(first, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()))
    # Only rows of classes with another least id than their own need it; most rows represent themselves.
    known = classes.select(*keys, "node", "rep", "size")
    if labels is not None:
        known = known.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = known.groupBy("component").agg(F.min("rep").alias("least"))
        known = known.join(least, "component")
    else:
        known = known.withColumn("least", F.col("rep"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = known.where("size > 1 or least <> rep").select(*keys, "least", salt)
    own = sk.select("doc_id", *keys, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    result = own.where("n_shingles > 0 and doc_id is not null").join(salted, [*keys, "salt"], "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    alone = own.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def oracle(similarity: int = SIMILARITY) -> str:
    """The rows of near_duplicates() in SQL, from the words of all shingles that two documents share; ids must be distinct and not null."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.e = b.e AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {similarity} * greatest(a.n, b.n)
  GROUP BY x, y, a.n, b.n HAVING 100 * count(*) >= {similarity} * (a.n + b.n - count(*))),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
least_ AS (SELECT x AS doc_id, min(y) AS lo FROM reached GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(lo, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(lo, doc_id)) AS kept FROM sets LEFT JOIN least_ USING (doc_id)
"""


def kept(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps; rows that repeat a kept id stay with it."""
    name = common.free(docs.columns, "gone_id")
    gone = near_duplicates(docs, similarity).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")

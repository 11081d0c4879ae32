"""Text quality by an interpolated modified Kneser-Ney model of character n-grams.

An n-gram is a string of ORDER code points of any script, so that the tables grow with the corpus. Documents are
packed once into blocks, some compressed rows of a bucketed table each; a block names each of its n-grams once, in a row of
its own, however often it occurs. The counts of all orders, their contexts and the n-grams that blocks ask for are tables joined in shards of equal
n-grams and contexts; the probabilities go back to the blocks, where each document gets the perplexity of its whole
text. No table passes through the driver, and the texts are never shuffled.

Limits for each language decide: quantiles of the perplexity, on both sides, and of how often words repeat one of the
NEAR words before them, which few characters don't show. They are taken from trusted texts that the counts leave out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reachflow.llm import common
from reachflow.sources.scratch import bucketed

ORDER = 4
#: A block holds texts of about so many bytes, and so many rows at most.
BLOCK_BYTES, BLOCK_ROWS = 14_000_000, 50_000
#: Where whole rows travel in the blocks, as in kept(), they are smaller.
ROW_BLOCK_BYTES = 4_000_000
#: Texts of about so many bytes are looked at at once.
LINE_BYTES = 250_000
#: Trusted documents whose crc32(doc_id) mod FOLDS is 0 give the limits, the others the counts.
FOLDS = 5
#: The limits are the QUANTILE of the greatest and the least perplexities and of the repetitions.
QUANTILE, ACCURACY, ERROR = 0.998, 10_000, 3.0
#: A language's quantiles are mixed with those of all texts, which weigh as much as so many texts of the language.
POOLED = 20
#: So many words before a word are looked at for it; the prior repeats and words that keep short texts from extremes.
NEAR, PRIOR = 4, (1, 20)
#: Limits of so many languages are broadcast (some 50 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 20_000
TIMES = common.powers(ORDER, 0xD1342543DE82EF95)
#: A block's texts travel in rows of about so many bytes, before compression, and its n-grams are sent on so many at a time.
PART_BYTES, GRAM_ROWS = 1_000_000, 50_000
#: A task that counts passes its sums on beyond so many n-grams.
MOST_HELD = 400_000
BLOCKS = "block long, begin int, ids array<long>, rows binary, gram string"


def keys(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of the n-grams whose k-th code points are in the k-th column; they tell n-grams of one block apart."""
    return common.mixed(sum(c.astype(np.uint64) * TIMES[k] for k, c in enumerate(columns)))


class Line:
    """Texts as one line of code points: ORDER - 1 boundaries (code point 0) before each and one behind it."""

    def __init__(self, texts: list[bytes]):
        wide = [t.decode("utf-8", "replace").encode("utf-32-le") for t in texts]
        self.sizes = np.array([len(w) // 4 for w in wide], np.int64)
        room = self.sizes + ORDER
        self.points = np.zeros(int(room.sum()) + ORDER - 1, np.uint32)
        begins = np.cumsum(room) - room
        self.points[common.run_positions(begins + ORDER - 1, self.sizes)] = np.frombuffer(b"".join(wide), "<u4")
        #: Where each n-gram begins; a text has one for each code point and one for its end.
        self.at = common.run_positions(begins, self.sizes + 1)
        self.text = np.repeat(np.arange(len(texts)), self.sizes + 1)
        self.key = keys([self.points[self.at + k] for k in range(ORDER)])

    def strings(self, which: np.ndarray) -> list[str]:
        square = self.points[self.at[which][:, None] + np.arange(ORDER)]
        whole = square.tobytes().decode("utf-32-le")
        return [whole[i : i + ORDER] for i in range(0, len(whole), ORDER)]


def keys_of(grams: list[str]) -> np.ndarray:
    square = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
    return keys([square[:, k] for k in range(ORDER)])


class Tally:
    """Distinct n-grams of a block with how often each occurs."""

    def __init__(self):
        self.key, self.n, self.grams = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, texts: list[bytes]) -> None:
        begin = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= LINE_BYTES or i == len(texts) - 1:
                self.add_line(Line(texts[begin : i + 1]))
                begin, size = i + 1, 0

    def add_line(self, line: Line) -> None:
        key, first, n = np.unique(line.key, return_index=True, return_counts=True)
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == key[inside]
        self.n[at[known]] += n[known]
        fresh = ~known
        self.grams = np.insert(self.grams, at[fresh], np.array(line.strings(first[fresh]), object))
        self.n, self.key = np.insert(self.n, at[fresh], n[fresh]), np.insert(self.key, at[fresh], key[fresh])


def repetition(texts: list[bytes]) -> np.ndarray:
    """How large a part of each text's words (between blanks) repeat one of the NEAR words before them, with the prior."""
    data, begins = common.joined(texts)
    starts, word = common.word_hashes(data, data > 32)
    text = np.searchsorted(begins, starts, "right") - 1
    again = np.zeros(len(word), bool)
    for k in range(1, NEAR + 1):
        again[k:] |= (word[k:] == word[:-k]) & (text[k:] == text[:-k])
    n, repeats = (np.bincount(x, minlength=len(texts)) for x in (text, text[again]))
    return (repeats + PRIOR[0]) / (n + PRIOR[1])


def to_bytes(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        for p in parts:
            stream.write_batch(p)
    return sink.getvalue().to_pybytes()


def from_bytes(rows: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(rows) as stream:
        yield from stream


class Blocks:
    """The rows of docs, with all their columns, packed into blocks; k_id, k_lang and k_text are what is judged.

    Rows keep their place in their block. A null text counts as empty.
    """

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
        common.small_batches(docs.sparkSession)
        self.docs = docs
        self.id, self.lang, self.text = (common.free(docs.columns, x) for x in ("k_id", "k_lang", "k_text"))
        own = isinstance(docs.schema["text"].dataType, StringType)
        if own:
            self.text = "text"
        added = [F.col("doc_id").cast("long").alias(self.id), F.col("lang").cast("string").alias(self.lang), *([] if own else [F.col("text").cast("string").alias(self.text)])]
        id_name, text_name = self.id, self.text

        names = ["block", "begin", "ids", "rows", "gram"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            new = lambda: (uuid.uuid4().int >> 65, 0, 0, Tally())
            block, begin, size, tally = new()
            held, held_size = [], 0

            def part() -> pa.RecordBatch:
                ids = [x for h in held for x in h.column(id_name).to_pylist()]
                columns = [pa.array([block], pa.int64()), pa.array([begin], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([to_bytes(held)], pa.binary()), pa.nulls(1, pa.string())]
                return pa.record_batch(columns, names)

            def grams() -> Iterator[pa.RecordBatch]:
                for i in range(0, len(tally.grams), GRAM_ROWS):
                    own = pa.array(tally.grams[i : i + GRAM_ROWS].tolist(), pa.string())
                    n = len(own)
                    yield pa.record_batch([pa.array(np.full(n, block), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary()), own], names)

            for rows, texts in common.slices(batches, text_name, LINE_BYTES):
                held.append(rows)
                tally.add(texts)
                added = sum(map(len, texts))
                held_size, size = held_size + added, size + added
                count = sum(h.num_rows for h in held)
                full = size >= block_bytes or begin + count >= BLOCK_ROWS
                if full or held_size >= PART_BYTES:
                    yield part()
                    held, held_size, begin = [], 0, begin + count
                if full:
                    yield from grams()
                    block, begin, size, tally = new()
            if held:
                yield part()
            yield from grams()

        total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        # Block numbers are random: what follows reads the written table, so that they are drawn once.
        self.buckets = max(1, -(-total // block_bytes))
        self.table = bucketed(docs.select(*docs.columns, *added).mapInArrow(run, BLOCKS), "block", self.buckets)
        self.texts, self.grams = self.table.where("rows is not null"), self.table.where("gram is not null").select("block", "gram")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and more, from the counts of counts."""
    found = {r["n"]: r["m"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("m")).collect()}  # four rows
    n1, n2, n3, n4 = (float(found.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1))


def model(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """gram, logp (natural logarithm) of every asked n-gram (gram) under the counts (gram, n), a written table.

    Each order's table is joined with its contexts and with the order below on shards of equal n-grams. An unseen
    context passes the lower order's probability on. Below single characters stands the uniform distribution over those
    counted and one more for all others.
    """
    tables = [counts]
    for _ in range(ORDER - 1):  # continuation counts: how many characters come before
        tables.append(common.narrow(tables[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))))
    wanted = common.narrow(asked.select("gram").distinct())
    below, uniform = None, 1.0 / (tables[-1].count() + 1)
    for order in range(1, ORDER + 1):
        own = tables[ORDER - order]
        d1, d2, d3 = discounts(own)
        these = wanted if order == ORDER else wanted.select(F.expr(f"substring(gram, {ORDER - order + 1})").alias("gram")).distinct()
        context = F.expr(f"substring(gram, 1, {order - 1})").alias("context")
        contexts = own.groupBy(context).agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count_if(F.col("n") > 2).alias("n3"))
        rows = these.join(own, "gram", "left").select("gram", context, F.coalesce("n", F.lit(0)).alias("n")).join(contexts, "context", "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(uniform))
        else:
            rows = rows.withColumn("tail", F.expr("substring(gram, 2)")).join(below.withColumnRenamed("gram", "tail"), "tail").withColumnRenamed("p", "lower")
        off = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        p = (F.greatest(F.col("n") - off, F.lit(0.0)) + (d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) * F.col("lower")) / F.col("total")
        below = common.narrow(rows.select("gram", F.when(F.col("total").isNull(), F.col("lower")).otherwise(p).alias("p")))
    return below.select("gram", F.log("p").alias("logp"))


def good_ids(labels: DataFrame) -> DataFrame:
    """good_id: documents that a label calls good and none calls bad: all of them, so that the model grows with the corpus."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("good_id"))
    return known.agg(F.min("quality").alias("q")).where("q = 1").select("good_id")


def marked(blocks: Blocks, labels: DataFrame) -> DataFrame:
    """block, counted, held: the places of a block's trusted rows that are counted, and of those that give the limits."""
    places = blocks.texts.select("block", "begin", F.posexplode("ids").alias("at", "id")).select("block", (F.col("begin") + F.col("at")).alias("place"), "id")
    good = places.join(good_ids(labels), F.col("id") == F.col("good_id")).withColumn("out", common.crc_mod(F.col("id"), FOLDS) == 0)
    return good.groupBy("block").agg(F.collect_list(F.when(~F.col("out"), F.col("place"))).alias("counted"), F.collect_list(F.when(F.col("out"), F.col("place"))).alias("held"))


def counted(blocks: Blocks, marks: DataFrame) -> DataFrame:
    """gram, n: how often each n-gram occurs in the counted texts; a block adds up its own before the shuffle."""
    text_name = blocks.text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def sums() -> pa.RecordBatch:
            return pa.record_batch([pa.array(tally.grams.tolist(), pa.string()), pa.array(tally.n)], ["gram", "n"])

        for batch in batches:
            for rows, begin, places in zip(batch.column("rows"), batch.column("begin").to_pylist(), batch.column("counted").to_pylist(), strict=True):
                these = set(places)
                for part, texts in common.slices(from_bytes(rows.as_buffer()), text_name, LINE_BYTES):
                    own = [t for i, t in enumerate(texts) if begin + i in these]
                    begin += part.num_rows
                    if own:
                        tally.add(own)
                if len(tally.n) >= MOST_HELD:
                    yield sums()
                    tally = Tally()
        yield sums()

    rows = blocks.texts.select("block", "begin", "rows").join(marks.where("size(counted) > 0").select("block", "counted").hint("shuffle_hash"), "block")
    return rows.select("rows", "begin", "counted").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def scored(blocks: Blocks, marks: DataFrame, probabilities: DataFrame) -> DataFrame:
    """block, place, doc_id, lang, n_symbols, perplexity, repetition, held of every row.

    Empty texts have the perplexity of the one boundary that ends them.
    """
    id_name, lang_name, text_name = blocks.id, blocks.lang, blocks.text

    def score(packed: pa.Table, known: pa.Table) -> pa.Table:
        key = keys_of(known.column("gram").to_pylist())
        order = np.argsort(key)
        key, logp, parts = key[order], known.column("logp").to_numpy()[order], []
        for block, begin, rows, places in zip(*(packed.column(c).to_pylist() for c in ("block", "begin")), packed.column("rows"), packed.column("held").to_pylist(), strict=True):
            held = set(places or ())
            for part, texts in common.slices(from_bytes(rows.as_buffer()), text_name, LINE_BYTES):
                line, n = Line(texts), len(texts)
                total = np.bincount(line.text, logp[np.searchsorted(key, line.key)], minlength=n)
                columns = [pa.array(np.full(n, block)), pa.array(np.arange(begin, begin + n), pa.int32()), part.column(id_name), part.column(lang_name), pa.array(line.sizes), pa.array(np.exp(-total / (line.sizes + 1))), pa.array(repetition(texts)), pa.array([begin + i in held for i in range(n)])]
                parts.append(pa.record_batch(columns, ["block", "place", "doc_id", "lang", "n_symbols", "perplexity", "repetition", "held"]))
                begin += n
        return pa.Table.from_batches(parts)

    # A block's probabilities go to its task as sorted rows, which spill, not as one collected value on the heap.
    known = blocks.grams.join(probabilities, "gram").select(F.col("block").alias("asking"), "gram", "logp")
    rows = blocks.texts.select("block", "begin", "rows").join(marks.select("block", "held").hint("shuffle_hash"), "block", "left")
    return rows.groupBy("block").cogroup(known.groupBy("asking")).applyInArrow(score, "block long, place int, doc_id long, lang string, n_symbols long, perplexity double, repetition double, held boolean")


def with_limits(scores: DataFrame) -> DataFrame:
    """The scores with high, low (perplexity) and again (repetition), the limits of each row's language.

    They are quantiles q of the held-out trusted texts, each moved to q + (q - median) * ERROR / sqrt(n), which allows for
    the error of a quantile of n texts and vanishes with more of them. Those of a language and of all are mixed:
    (n * own + POOLED * all) / (n + POOLED). Languages without trusted texts, null too, have those of all; without
    any at all there is no limit.
    """
    ranked = scores.where("held and n_symbols > 0")
    cuts = [F.percentile_approx(c, [q, 0.5], ACCURACY).alias(name) for c, q, name in (("perplexity", QUANTILE, "high"), ("perplexity", 1 - QUANTILE, "low"), ("repetition", QUANTILE, "again"))]
    names = ("high", "low", "again")
    moved = [(F.col(x)[0] + (F.col(x)[0] - F.col(x)[1]) * ERROR / F.sqrt("n")).alias(x) for x in names]
    whole = ranked.agg(*cuts, F.count("*").alias("n")).select(*moved).first()
    pooled = dict(zip(names, (float("inf"), 0.0, float("inf")), strict=True)) if whole["high"] is None else whole.asDict()
    own = ranked.where("lang is not null").groupBy("lang").agg(*cuts, F.count("*").alias("n")).select("lang", "n", *moved)
    mixed = [((F.col("n") * F.col(x) + POOLED * F.lit(pooled[x])) / (F.col("n") + POOLED)).alias(f"l_{x}") for x in names]
    limits = common.narrow(own.select(F.col("lang").alias("l_lang"), *mixed))
    if limits.count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    out = scores.join(limits, F.col("lang") == F.col("l_lang"), "left")
    return out.select(*scores.columns, *[F.coalesce(f"l_{x}", F.lit(pooled[x])).alias(x) for x in names])


GOOD = "n_symbols > 0 and perplexity <= high and perplexity >= low and repetition <= again"


def fitted(docs: DataFrame, labels: DataFrame, block_bytes: int) -> tuple[Blocks, DataFrame]:
    """The packed rows and every row's score and limits."""
    blocks = Blocks(docs, block_bytes)
    marks = common.narrow(marked(blocks, labels))
    counts = common.narrow(counted(blocks, marks))
    probabilities = model(counts, blocks.grams)
    return blocks, with_limits(common.written(scored(blocks, marks, probabilities).coalesce(max(8, -(-blocks.buckets * block_bytes // (3 * BLOCK_BYTES))))))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold (the greatest perplexity), kept of every row.

    Null texts count as empty; empty texts are not kept. Languages without trusted texts, null too, take the limits of
    all trusted texts; without any trusted text everything with text is kept. Other columns are left out; repeated rows
    are judged each, alike.
    """
    scores = fitted(docs.select("doc_id", "lang", "text"), labels, BLOCK_BYTES)[1]
    return scores.select("doc_id", "lang", "n_symbols", "perplexity", F.col("high").alias("threshold"), F.expr(GOOD).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that judged() keeps; each row is judged by itself, ids may repeat."""
    blocks, scores = fitted(docs, labels, ROW_BLOCK_BYTES)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, begin, places in zip(batch.column("rows"), batch.column("begin").to_pylist(), batch.column("places").to_pylist(), strict=True):
                these = np.sort(np.array(places))
                for part in from_bytes(rows.as_buffer()):
                    own = these[np.searchsorted(these, begin) : np.searchsorted(these, begin + part.num_rows)] - begin
                    begin += part.num_rows
                    yield pa.record_batch(part.take(pa.array(own)).columns[: len(columns)], columns)

    stay = scores.where(GOOD).groupBy("block").agg(F.collect_list("place").alias("places"))
    return blocks.texts.select("block", "begin", "rows").join(stay.hint("shuffle_hash"), "block").select("rows", "begin", "places").mapInArrow(run, docs.schema)

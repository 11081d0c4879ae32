"""Tokens of texts by a finite automaton whose runs compose.

What a piece of a text does to the automaton is a map from the state before it to the state behind it. Pieces are run apart from
all states, their maps are composed along the text, and every piece is then cut into tokens from its own state: a very long
text is lexed by many tasks. Within a task the same is done with short chunks, so that whole arrays of chunks advance together.

A token is trivia (space, comments), a word, a number, a string, a bracket, or punctuation, of which the longest operators
are one token. Strings stand in double quotes, with backslash escapes, and may hold line ends; block comments nest up to DEPTH.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachflow.functions.text import SLICE_BYTES, numbers_within, slices
from reachflow.sources.scratch import written

#: A piece is a row of its own; a chunk advances in one lane of an array.
PIECE_BYTES, CHUNK_BYTES = 1_000_000, 1_024
DEPTH = 8
#: Operators that are one token.
OPERATORS = ("==", "=>", "<=", "<<", "<-", ">=", ">>", "!=", "+=", "-=", "->", "*=", "/=", "%=", "^=", "&=", "&&", "|=", "||", "..", "::", "<<=", ">>=", "...", "..=")
TRIVIA = ("space", "comment")
KINDS = ("space", "comment", "word", "number", "string", "unterminated", "open", "close", "comma", "punctuation")
QUIET = [KINDS.index(k) for k in TRIVIA]
TOKENS = "source_id long, i long, start long, end long, kind string, spacing string, text string"


class Grammar:
    """The automaton: step[state, class] is the next state and cut[state, class] whether a token begins with this byte."""

    def __init__(self):
        own = sorted({c for o in OPERATORS for c in o})
        classes = ["space", "line", "letter", "digit", "quote", "back", "comma", "open", "close", "other", *own]
        self.class_of = np.full(256, classes.index("other"), np.uint8)
        for name, values in (("space", b" \t\r\x0b\x0c"), ("line", b"\n"), ("digit", b"0123456789"), ("quote", b'"'), ("back", b"\\"), ("comma", b","), ("open", b"([{"), ("close", b")]}")):
            self.class_of[list(values)] = classes.index(name)
        self.class_of[[*range(65, 91), *range(97, 123), 95, *range(128, 256)]] = classes.index("letter")
        for c in own:
            self.class_of[ord(c)] = classes.index(c)
        prefixes = sorted({o[:n] for o in OPERATORS for n in range(1, len(o))} | set(own), key=lambda p: (len(p), p))
        names = ["start", "space", "word", "number", "string", "escape", "quoted", "open", "close", "comma", "final", "line", "ended", *prefixes]
        names += [f"{x}{d}" for d in range(1, DEPTH + 1) for x in ("block", "star", "slash")]
        at = {n: k for k, n in enumerate(names)}
        first = {"space": "space", "line": "space", "letter": "word", "digit": "number", "quote": "string", "comma": "comma", "open": "open", "close": "close", "back": "final", "other": "final"} | {c: c for c in own}
        on: dict[tuple[str, str], str] = {("space", "space"): "space", ("space", "line"): "space"}
        on |= {(a, b): a for a in ("word", "number") for b in ("letter", "digit")}
        on |= {("string", c): {"quote": "quoted", "back": "escape"}.get(c, "string") for c in classes} | {("escape", c): "string" for c in classes}
        on |= {("line", c): "line" for c in classes if c != "line"}
        on |= {(p, c): p + c if p + c in prefixes else "final" for p in prefixes for c in own if p + c in prefixes or p + c in OPERATORS}
        on |= {("/", "/"): "line", ("/", "*"): "block1"}
        for d in range(1, DEPTH + 1):
            block, star, slash = f"block{d}", f"star{d}", f"slash{d}"
            for c in classes:
                on[block, c] = {"*": star, "/": slash}.get(c, block)
                on[star, c] = {"*": star, "/": f"block{d - 1}" if d > 1 else "ended"}.get(c, block)
                on[slash, c] = {"*": f"block{min(d + 1, DEPTH)}", "/": slash}.get(c, block)
        self.step = np.array([[at[on.get((n, c), first[c])] for c in classes] for n in names], np.uint8)
        self.cut = np.array([[(n, c) not in on for c in classes] for n in names], bool)
        kind = {n: n for n in ("space", "word", "number", "open", "close", "comma")} | {"start": "space", "quoted": "string", "string": "unterminated", "escape": "unterminated", "line": "comment", "ended": "comment"}
        self.kind = np.array([KINDS.index(kind.get(n, "unterminated" if n[-1].isdigit() else "punctuation")) for n in names], np.uint8)
        self.states = len(names)


RULES = Grammar()


class Chunks:
    """Texts (or pieces) cut into chunks of at most CHUNK_BYTES, a column of classes for each chunk."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-self.sizes // CHUNK_BYTES)
        self.text = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.begin = np.repeat(np.cumsum(self.sizes) - self.sizes, counts) + within * CHUNK_BYTES
        self.size = np.minimum(CHUNK_BYTES, np.repeat(self.sizes, counts) - within * CHUNK_BYTES)
        self.is_first = within == 0
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.height = int(self.size.max()) if len(self.size) else 0
        square = np.full((len(self.text), self.height), 255, np.uint8)
        square[np.arange(self.height) < self.size[:, None]] = RULES.class_of[self.data]
        self.classes = np.ascontiguousarray(square.T)

    def maps(self) -> np.ndarray:
        """The state behind each chunk (rows) for each state before it (columns); states that have met go on as one."""
        n, s = len(self.text), RULES.states
        lane = np.arange(n * s)  # which lane each chunk and state is on
        chunk, state = np.repeat(np.arange(n), s), np.tile(np.arange(s, dtype=np.uint8), n)
        for t in range(self.height):
            c = self.classes[t][chunk]
            live = c != 255
            state = np.where(live, RULES.step[state, np.where(live, c, 0)], state)
            if t in (0, 1, 3, 15, 63, 255):
                _, at, back = np.unique(chunk * s + state, return_index=True, return_inverse=True)
                chunk, state, lane = chunk[at], state[at], back[lane]
        return state[lane].reshape(n, s)

    def states(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state at each byte of all texts, and whether a token begins there; before: the state before each text."""
        maps, now, start = None if self.is_first.all() else self.maps(), 0, np.zeros(len(self.text), np.uint8)
        for k, (t, is_first) in enumerate(zip(self.text.tolist(), self.is_first.tolist(), strict=True)):
            start[k] = now = before[t] if is_first else maps[k - 1, now]
        out, cut = np.zeros((self.height, len(self.text)), np.uint8), np.zeros((self.height, len(self.text)), bool)
        state = start
        for t in range(self.height):
            c = np.minimum(self.classes[t], RULES.step.shape[1] - 1)  # behind a chunk's end it doesn't matter
            cut[t] = RULES.cut[state, c]
            state = out[t] = RULES.step[state, c]
        real = np.arange(self.height) < self.size[:, None]
        return out.T[real], cut.T[real]


def piece_map(text: bytes) -> bytes:
    """The state behind a text for each state before it."""
    now = np.arange(RULES.states)
    for m in Chunks([text]).maps():
        now = m[now]
    return now.astype(np.uint8).tobytes()


def cut_texts(texts: list[bytes], before: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, i, start, end, kind, and whether it continues a token begun before: every token of the texts, in order.

    Positions are within the text; i counts the tokens that begin in it. A text's bytes before its first cut are a continued token.
    """
    chunks = Chunks(texts)
    states, cut = chunks.states(before)
    begins = np.cumsum(chunks.sizes) - chunks.sizes
    heads = begins[chunks.sizes > 0]
    edge = cut.copy()
    edge[heads] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(cut))[: len(start)].astype(np.int64)
    text = np.searchsorted(begins + chunks.sizes, start, "right")
    continued = ~cut[start]
    fresh = np.cumsum(~continued)
    first = np.searchsorted(start, begins)
    before_text = np.append(0, fresh)[first]
    return text, fresh - 1 - before_text[text], start - begins[text], end - begins[text], RULES.kind[states[end - 1]] if len(end) else np.zeros(0, np.uint8), continued


def start_states(pieces: DataFrame) -> DataFrame:
    """source_id, piece, state: the state before each piece of the texts of several pieces (source_id, piece, body)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "body"):
            yield pa.record_batch([rows.column("source_id"), rows.column("piece"), pa.array([piece_map(t) for t in texts], pa.binary())], ["source_id", "piece", "map"])

    def along(own: pa.Table) -> pa.Table:
        order = np.argsort(own.column("piece").to_numpy())
        now, states, maps = 0, [], own.column("map").to_pylist()
        for k in order.tolist():
            states.append(now)
            now = maps[k][now]
        return pa.table({"source_id": own.column("source_id").take(pa.array(order)), "piece": own.column("piece").take(pa.array(order)), "state": pa.array(states, pa.int32())})

    maps = pieces.select("source_id", "piece", "body").mapInArrow(one, "source_id long, piece int, map binary")
    return maps.groupBy("source_id").applyInArrow(along, "source_id long, piece int, state int")


def spacing() -> Column:
    """How a token stands to the next one (following): alone before trivia or the end, joint before punctuation, else hidden."""
    return F.when(F.col("following").isNull() | F.col("following").isin(*TRIVIA), "alone").when(F.col("following") == "punctuation", "joint").otherwise("hidden")


def tokens(sources: DataFrame, piece_bytes: int = PIECE_BYTES, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """source_id, i, start, end, kind, spacing, text of every token of sources (source_id, text), trivia too, or of those of some kinds.

    i counts a text's tokens from 0; start and end are byte offsets. spacing is alone before trivia or the end of the text,
    joint before punctuation, hidden before other tokens. A null or empty text has no tokens. Ids must be distinct and not null.
    """
    body = F.col("text").cast("string").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(F.col("text").cast("string")) / piece_bytes)).cast("int")
    cut = lambda k: F.struct(k.alias("piece"), F.substring("body", k * piece_bytes + 1, F.lit(piece_bytes)).alias("body"))
    rows = sources.where("text is not null").select(F.col("source_id").cast("long").alias("source_id"), body.alias("body"), n.alias("n"))
    short, long = rows.where("n = 1"), rows.where("n > 1")
    pieces = long.select("source_id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), cut)).alias("p")).select("source_id", "n", "p.piece", "p.body")

    asked = [k for k, name in enumerate(KINDS) if name in kinds]

    def run(batches: Iterator[pa.RecordBatch], several: bool = False) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "body"):
            own, i, start, end, kind, continued = cut_texts(texts, part.column("state").to_numpy())
            last = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
            # The kind of a piece's last token may change in the next piece, and so may what the token before it is followed by.
            edge = last | np.append(last[1:], False) if several else last
            following = np.append(kind[1:], 0)[: len(kind)].astype(np.int8)
            names = pa.array(KINDS)
            flat = b"".join(texts)
            offset = np.cumsum([0, *map(len, texts)])[own] + start if len(own) else np.zeros(0, np.int64)
            offsets = np.append(offset, len(flat)).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)])
            take, ahead = pa.array(own), part.column("piece").to_numpy()[own].astype(np.int64) * piece_bytes
            columns = [part.column("source_id").take(take), part.column("piece").take(take), pa.array(i, pa.int64()), pa.array(start + ahead), pa.array(end + ahead)]
            columns += [names.take(pa.array(kind)), names.take(pa.array(following, mask=edge)), words, pa.array(continued), pa.array(edge)]
            cuts = pa.record_batch(columns, ["source_id", "piece", "i", "start", "end", "kind", "following", "body", "continued", "edge"])
            # Other kinds leave no row; pieces keep theirs, of which what goes on is put together.
            yield cuts if several or len(asked) == len(KINDS) else cuts.filter(pa.array(np.isin(kind, asked)))

    schema = "source_id long, piece int, i long, start long, end long, kind string, following string, body binary, continued boolean, edge boolean"
    whole = short.select("source_id", F.lit(0).alias("piece"), "body", F.lit(0).alias("state")).mapInArrow(run, schema)
    out = [F.col(c) for c in ("source_id", "i", "start", "end", "kind")] + [spacing().alias("spacing"), F.col("body").cast("string").alias("text")]
    pieces = written(pieces)
    if pieces.isEmpty():
        return whole.select(*out)
    cuts = written(pieces.join(start_states(pieces), ["source_id", "piece"]).select("source_id", "piece", "body", "state").mapInArrow(lambda batches: run(batches, True), schema))
    # Tokens that begin in earlier pieces of the text.
    counts = cuts.groupBy("source_id", "piece").agg(F.count_if(~F.col("continued")).alias("c"))
    before = counts.select("source_id", "piece", (F.sum("c").over(Window.partitionBy("source_id").orderBy("piece")) - F.col("c")).alias("before"))
    numbered = cuts.join(before, ["source_id", "piece"]).withColumn("i", F.col("i") + F.col("before"))
    # What goes on in the next piece is put together: the parts of one token have one number.
    parts = numbered.where("continued or edge")
    whole_body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "body"))), lambda p: F.hex(p["body"])), "")
    joined = written(parts.groupBy("source_id", "i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("kind", "start").alias("kind"), F.unhex(whole_body).alias("body")))
    heads = numbered.where("not continued and not edge and i = before").select("source_id", "start", "kind").union(joined.select("source_id", "start", "kind"))
    joined = joined.join(heads.select("source_id", F.col("start").alias("end"), F.col("kind").alias("following")), ["source_id", "end"], "left")
    of_pieces = numbered.where("not continued and not edge").select(*out).union(joined.select(*out))
    return whole.select(*out).union(of_pieces if len(asked) == len(KINDS) else of_pieces.where(F.col("kind").isin(*kinds)))


def bracket_levels(tokens: DataFrame) -> DataFrame:
    """The brackets and commas of tokens with level, how many brackets are open inside of them (at a bracket: with itself)."""
    rows = tokens.where(F.col("kind").isin("open", "close", "comma")).select("source_id", "start", "end", "kind", "text")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    running = F.sum(step).over(Window.partitionBy("source_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("level", (running + (F.col("kind") == "close").cast("int")).cast("long"))


def unbalanced(levels: DataFrame) -> DataFrame:
    """source_id, start, text: brackets of bracket_levels() that have no partner of their shape.

    Of one level, opening and closing brackets take turns; a text is balanced if that holds for all its levels.
    """
    turns = Window.partitionBy("source_id", "level").orderBy("start")
    rows = levels.where("kind <> 'comma'").select("*", F.lag("text").over(turns).alias("before"), F.lead("text").over(turns).alias("after"))
    closing = F.translate("text", "([{", ")]}")
    opening = F.translate("text", ")]}", "([{")
    bad = F.when(F.col("kind") == "open", ~F.col("after").eqNullSafe(closing)).otherwise(~F.col("before").eqNullSafe(opening))
    return rows.where(bad).select("source_id", "start", "text")


def segments(levels: DataFrame) -> DataFrame:
    """source_id, list_start, n, start, end, previous, following: what stands between the commas of each bracket, from 0.

    A list begins at list_start, its opening bracket; previous and following are where the commas beside a segment start, or
    null. Lists stand within lists; a text with brackets that have no partner has none.
    """
    level = Window.partitionBy("source_id", "level").orderBy("start")
    bracket = F.when(F.col("kind") != "comma", F.col("text"))
    before = F.last(bracket, ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, -1))
    rows = levels.select("*", before.alias("before"), F.row_number().over(level).alias("place"), F.lead("start").over(level).alias("next"), F.lead("kind").over(level).alias("next_kind"))
    # A text is balanced if brackets take turns at each level, as seen from the latter of two, and as many close as open.
    bad = F.when(F.col("kind") == "close", ~F.col("before").eqNullSafe(F.translate("text", ")]}", "([{"))).when(F.col("kind") == "open", F.coalesce(F.col("before").isin(*"([{"), F.lit(False))).otherwise(False)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    text = Window.partitionBy("source_id")
    opening = F.last(F.when(F.col("kind") == "open", F.struct("start", "place")), ignorenulls=True).over(level)
    # All windows keep to one exchange and, but for the levels, to one order.
    rows = rows.select("*", opening.alias("opening"), F.max(bad).over(text).alias("broken"), F.sum(step).over(text).alias("open"))
    rows = rows.where("not broken and open = 0 and level > 0 and kind <> 'close'")
    n = (F.col("place") - F.col("opening.place")).cast("int")
    return rows.select("source_id", F.col("opening.start").alias("list_start"), n.alias("n"), F.col("end").alias("start"), F.col("next").alias("end"), F.when(F.col("kind") == "comma", F.col("start")).alias("previous"), F.when(F.col("next_kind") == "comma", F.col("next")).alias("following"))


def identities(texts: list[bytes]) -> list[list[tuple[str, bytes]]]:
    """Kind and bytes of each text's tokens but trivia."""
    out: list[list[tuple[str, bytes]]] = [[] for _ in texts]
    for text, _, start, end, kind, _ in zip(*(x.tolist() for x in cut_texts(texts, np.zeros(len(texts), np.uint8))), strict=True):
        if KINDS[kind] not in TRIVIA:
            out[text].append((KINDS[kind], texts[text][start:end]))
    return out


def neighbourhoods(tokens: DataFrame, deletions: DataFrame) -> DataFrame:
    """source_id, deletion_id, cuts, left, right, kinds, texts: the window of two tokens on each side of each deletion.

    deletions (source_id, deletion_id, start, end) are byte ranges. cuts: whether a token, not trivia, lies across an end
    of it. left and right are the bytes of the window before and behind the deletion, kinds and texts its tokens.
    """
    text = tokens.select("source_id", F.col("start").alias("at"), F.lit(1).alias("turn"), "end", "kind", "text")
    ends = deletions.select("source_id", "deletion_id", F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    ends = ends.select("*", F.posexplode(F.array(F.col("d_start"), F.col("d_end"))).alias("side", "at")).withColumn("turn", F.lit(0))
    # Dealt by source once: all that follows keeps to it. An end stands before the token that begins there.
    events = text.unionByName(ends, allowMissingColumns=True)
    real = (F.col("turn") == 1) & ~F.col("kind").isin(*TRIVIA)
    order = Window.partitionBy("source_id").orderBy("at", "turn")
    placed = events.withColumn("real", real).withColumn("place", F.sum(F.col("real").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A token goes with the trivia behind it and the ends that lie before the next one; what is before the first token has place 0.
    one = F.max(F.when(F.col("real"), F.struct(F.col("at").alias("start"), "end", "kind", "text"))).alias("one")
    behind = F.array_sort(F.collect_list(F.when((F.col("turn") == 1) & ~F.col("real"), F.struct("at", "text"))))
    cut = F.collect_list(F.when(F.col("turn") == 0, F.struct("deletion_id", "d_start", "d_end", "side"))).alias("ends")
    own = placed.groupBy("source_id", "place").agg(one, F.array_join(F.transform(behind, lambda t: t["text"]), "").alias("behind"), cut)
    along = Window.partitionBy("source_id").orderBy("place")
    near = {"l": F.when(F.col("one").isNotNull(), F.struct(F.lag("one").over(along).alias("b"), F.when(F.lag("one").over(along).isNotNull(), F.lag("behind").over(along)).alias("b_behind"), F.col("one"), F.col("behind")))}
    near["r"] = F.struct(F.lead("one").over(along).alias("one"), F.lead("behind").over(along).alias("behind"), F.lead("one", 2).over(along).alias("after"), F.col("behind").alias("ahead"))
    met = own.select("source_id", "ends", *[c.alias(n) for n, c in near.items()]).select("source_id", F.explode("ends").alias("e"), "l", "r").select("source_id", "e.*", "l", "r")
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    rows = met.groupBy("source_id", "deletion_id", "d_start", "d_end").agg(pick("l", 0).alias("l"), pick("r", 1).alias("r"), pick("l", 1).alias("inner"))
    cuts = F.coalesce(F.col("l.one.end") > F.col("d_start"), F.lit(False)) | F.coalesce(F.col("inner.one.end") > F.col("d_end"), F.lit(False))
    said = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    # The trivia beside the deletion, as far as the deletion leaves it; at an end of the text it is that of the only neighbour.
    rest = F.when(F.col("l").isNull(), F.lit(b"")).otherwise(F.substring(said("l.behind"), F.lit(1), (F.col("d_start") - F.col("l.one.end")).cast("int")))
    left = F.concat(said("l.b.text"), said("l.b_behind"), said("l.one.text"), rest)
    gap = (F.col("r.one.start") - F.col("d_end")).cast("int")
    head = F.when(F.col("r.one").isNull(), F.lit(b"")).otherwise(F.substring(said("r.ahead"), F.octet_length("r.ahead") - gap + 1, gap))
    right = F.concat(head, said("r.one.text"), F.when(F.col("r.one").isNull(), F.lit(b"")).otherwise(said("r.behind")), said("r.after.text"))
    names = ("l.b", "l.one", "r.one", "r.after")
    kept = lambda what: F.array_compact(F.array(*[F.col(f"{n}.{what}") for n in names]))
    return rows.select("source_id", "deletion_id", cuts.alias("cuts"), left.alias("left"), right.alias("right"), kept("kind").alias("kinds"), kept("text").alias("texts"))


def disturbing(tokens: DataFrame, deletions: DataFrame) -> DataFrame:
    """source_id, deletion_id: the deletions that change a token beside them, by gluing, splitting or swallowing it.

    The window of two tokens on each side is lexed again without the deletion and must give the same tokens. A deletion
    that cuts a token changes it. Trivia may go and come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [a + b for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
            want = [list(zip(k, (t.encode() for t in own), strict=True)) for k, own in zip(batch.column("kinds").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
            bad = [c or a != w for c, a, w in zip(batch.column("cuts").to_pylist(), identities(texts), want, strict=True)]
            yield pa.record_batch([batch.column("source_id"), batch.column("deletion_id"), pa.array(bad, pa.bool_())], ["source_id", "deletion_id", "bad"])

    windows = neighbourhoods(tokens, deletions)
    kind = windows.schema["deletion_id"].dataType.simpleString()
    return windows.mapInArrow(run, f"source_id long, deletion_id {kind}, bad boolean").where("bad").select("source_id", "deletion_id")


def changed(texts: list[bytes], tokens: tuple[np.ndarray, ...], deletions: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each deletion of texts disturbs a token beside it, as disturbing() has it, by arrays.

    tokens are columns text, start, end, kind of every token, in order; deletions are columns text, start, end.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    flat, begins = b"".join(texts), np.cumsum(sizes) - sizes
    text, start, end, kind = (c[~np.isin(tokens[3], QUIET)] for c in tokens)
    start, end = begins[text] + start, begins[text] + end
    d_text, d_start, d_end = deletions[0], begins[deletions[0]] + deletions[1], begins[deletions[0]] + deletions[2]
    # Tokens low to high of a text; one before the deletion, one that begins before its end, one behind it.
    low, high = np.searchsorted(text, d_text), np.searchsorted(text, d_text, "right")
    one, inner = np.searchsorted(start, d_start) - 1, np.searchsorted(start, d_end) - 1
    behind = inner + 1
    ends, starts = np.append(end, 0), np.append(start, 0)  # a place of -1 or behind the last is not looked at
    bad = ((one >= low) & (ends[one] > d_start)) | ((inner >= low) & (ends[inner] > d_end))
    # The window: two tokens before, of which the trivia that follow belong to them, and two behind.
    left = np.where(one < low, d_start, starts[np.maximum(one - 1, low).clip(0, len(start))])
    last = ends[(behind + 1).clip(0, len(start))]
    past = begins[d_text] + sizes[d_text]
    right = np.where(behind >= high, d_end, np.where(behind + 1 < high, last, past))
    width = d_start - left + right - d_end
    first, until = np.maximum(one - 1, low), np.minimum(behind + 2, high)
    # Windows of a like length go together, as the longest sets the steps of all, and no more than SLICE_BYTES of them.
    asked = np.flatnonzero(~bad & (width > 0))
    asked = asked[np.argsort(width[asked], kind="stable")]
    slots = np.searchsorted([64, CHUNK_BYTES], width[asked]) + 3 * (np.cumsum(width[asked]) // SLICE_BYTES)
    for few in np.split(asked, np.flatnonzero(np.diff(slots)) + 1) if len(asked) else []:
        spans = (left[few], d_start[few], d_end[few], right[few])
        bad[few] = _differ(flat, spans, (start, end, kind), (first[few], one[few] + 1, behind[few], until[few]))
    return bad


def _differ(flat: bytes, spans: tuple[np.ndarray, ...], tokens: tuple[np.ndarray, ...], places: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether flat[a:b] + flat[c:d] has other tokens, trivia left out, than those from p to q and from r to s; spans a, b, c, d, places p, q, r, s."""
    (a, b, c, _), (start, end, kind), (p, q, r, s) = spans, tokens, places
    windows = [flat[w:x] + flat[y:z] for w, x, y, z in zip(*(n.tolist() for n in spans), strict=True)]
    text, _, w_start, w_end, w_kind, _ = cut_texts(windows, np.zeros(len(windows), np.uint8))
    real = ~np.isin(w_kind, QUIET)
    text, w_start, w_end, w_kind = text[real], w_start[real], w_end[real], w_kind[real]
    before = np.maximum(q - p, 0)
    bad = np.bincount(text, minlength=len(windows)) != before + np.maximum(s - r, 0)
    # The k-th token of a window is held against the k-th that it should have.
    k, same = numbers_within(text), ~bad[text]
    text, k, w_start, w_end, w_kind = (x[same] for x in (text, k, w_start, w_end, w_kind))
    is_left = k < before[text]
    at = np.where(is_left, p[text] + k, r[text] + k - before[text])
    other = (kind[at] != w_kind) | (end[at] - start[at] != w_end - w_start)
    bad[text[other]] = True
    # A token of the same length at its own place has its own bytes.
    moved = ~other & (w_start + a[text] + np.where(is_left, 0, (c - b)[text]) != start[at])
    for t, w, x, y, z in zip(*(n[moved].tolist() for n in (text, w_start, w_end, start[at], end[at])), strict=True):
        bad[t] |= windows[t][w:x] != flat[y:z]
    return bad


def stays(texts: list[bytes], tokens: tuple[np.ndarray, ...], elements: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each element of the one list of each text has to stay, as repaired() has it, by arrays; elements are columns text, start, end, kept, in order."""
    text, start, end, kept = elements
    gone = np.flatnonzero(~kept)
    if not len(gone):
        return kept
    head = np.append(True, (np.diff(gone) > 1) | (np.diff(text[gone]) > 0))
    heads = np.flatnonzero(head)
    runs = text[gone[heads]], np.minimum.reduceat(start[gone], heads), np.maximum.reduceat(end[gone], heads)
    out = kept.copy()
    out[gone] = changed(texts, tokens, runs)[np.cumsum(head) - 1]
    return out


def within(sources: DataFrame, find: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    """Rows that find(texts, tokens) gives for the tokens of some texts, in the task that reads them: the place of a row's text, then its columns.

    sources (source_id, text): texts of one piece, see by_length(). schema has the names and types behind source_id. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            text, _, start, end, kind, _ = cut_texts(texts, np.zeros(len(texts), np.uint8))
            own, *columns = find(texts, (text, start, end, kind))
            yield pa.record_batch([part.column("source_id").take(pa.array(own)), *map(pa.array, columns)], ["source_id", *names])

    names = [c.split()[0] for c in schema.split(", ")]
    rows = sources.where("text is not null").select("source_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"source_id {rows.schema['source_id'].dataType.simpleString()}, {schema}")


def by_length(sources: DataFrame, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """The texts of one piece, which a task lexes whole; and those that are lexed by many tasks, None if there are none."""
    long = sources.where(F.octet_length("text") > piece_bytes)
    return sources.where(F.octet_length("text") <= piece_bytes), None if long.isEmpty() else long


def repaired(tokens: DataFrame, elements: DataFrame) -> DataFrame:
    """The elements of elements (source_id, list_id, i, start, end, kept) that have to stay, kept ones first: kept is true for all of them.

    Dropped elements beside each other go as one deletion, with what lies between. A deletion that disturbs a token beside
    it is taken back, all of its elements. Whether one disturbs follows from the tokens and its own range alone, and what
    is taken back bounds the other ranges as before, so that no second wave can find another one.
    """
    state = written(elements.select("source_id", "list_id", "i", "start", "end", "kept"))
    order = Window.partitionBy("source_id", "list_id").orderBy("i")
    dropped = state.withColumn("run", F.sum(F.col("kept").cast("long")).over(order)).where("not kept")
    runs = dropped.groupBy("source_id", "list_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    bad = disturbing(tokens, runs.withColumn("deletion_id", F.struct("list_id", "run"))).select("source_id", "deletion_id.list_id", "deletion_id.run")
    back = dropped.join(bad, ["source_id", "list_id", "run"], "left_semi").withColumn("kept", F.lit(True))
    return state.where("kept").unionByName(back.select(*state.columns))

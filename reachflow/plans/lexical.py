"""Queries over tokens: lexing, lists between brackets, deletions that disturb tokens, their repair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachflow.functions.text import numbers_within
from reachflow.operators import lexing
from reachflow.plans.registered import query
from reachflow.sources.relations import table
from reachflow.sources.scratch import written

_HIGH = r"[^\x00-\x7F]"
_STRING, _BLOCK = r'"(?:[^"\\]|\\[\x00-\x{10FFFF}])*"', r"/\*(?:[^*]|\*+[^*/])*\*+/"
_OPERATORS = "|".join("".join(rf"\{c}" for c in o) for o in sorted(lexing.OPERATORS, key=lambda o: (-len(o), o)))
_TOKEN = "|".join([r"[ \t\r\n\x0B\x0C]+", r"//[^\n]*", _BLOCK, r"/\*[\x00-\x{10FFFF}]*", _STRING, r'"[\x00-\x{10FFFF}]*', rf"(?:[0-9A-Za-z_]|{_HIGH})+", _OPERATORS, r"[\x00-\x7F]"])


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: The kind of a token t; block comments within block comments are not told apart here.
_KIND = rf"""CASE WHEN regexp_matches(t, '^[ \t\r\n\x0B\x0C]') THEN 'space' WHEN t LIKE '//%' OR regexp_full_match(t, {_quoted(_BLOCK)}) THEN 'comment' WHEN t LIKE '/*%' THEN 'unterminated'
  WHEN regexp_full_match(t, {_quoted(_STRING)}) THEN 'string' WHEN t LIKE '"%' THEN 'unterminated' WHEN regexp_matches(t, '^[0-9]') THEN 'number' WHEN regexp_matches(t, {_quoted(rf"^(?:[A-Za-z_]|{_HIGH})")}) THEN 'word'
  WHEN t IN ('(', '[', '{{') THEN 'open' WHEN t IN (')', ']', '}}') THEN 'close' WHEN t = ',' THEN 'comma' ELSE 'punctuation' END"""


def _tokens_sql(sources: str) -> str:
    """CTEs up to tokens (source_id, i, start, end, kind, spacing, t), from a query of source_id and text."""
    return f"""sources AS ({sources}), cut AS (SELECT source_id, regexp_extract_all(text, {_quoted(_TOKEN)}) AS ts FROM sources),
one AS (SELECT source_id, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS i FROM cut),
placed AS (SELECT *, CAST(sum(strlen(t)) OVER (PARTITION BY source_id ORDER BY i) AS BIGINT) AS e, {_KIND} AS kind FROM one),
tokens AS (SELECT source_id, i, e - strlen(t) AS s, e, kind, t, lead(kind) OVER (PARTITION BY source_id ORDER BY i) AS nk FROM placed)"""


_ROWS = "SELECT source_id, i, s AS start, e AS \"end\", kind, CASE WHEN nk IS NULL OR nk IN ('space', 'comment') THEN 'alone' WHEN nk = 'punctuation' THEN 'joint' ELSE 'hidden' END AS spacing FROM tokens"
_DOCUMENTS, _PAGES = "SELECT doc_id AS source_id, text FROM documents", "SELECT page_id AS source_id, html AS text FROM pages"


def _sources(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key, text = {"documents": ("doc_id", "text"), "pages": ("page_id", "html")}[name]
    return table(spark, sf_dir, name).select(F.col(key).alias("source_id"), F.col(text).alias("text"))


@query(f"WITH {_tokens_sql(_DOCUMENTS)} {_ROWS}")
def x8_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document, with its span, kind and spacing."""
    return lexing.tokens(_sources(spark, sf_dir, "documents")).drop("text")


@query(f"WITH {_tokens_sql(_PAGES)} {_ROWS}")
def x9_page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every raw page; tags within strings are no tokens."""
    return lexing.tokens(_sources(spark, sf_dir, "pages")).drop("text")


@query(f"WITH {_tokens_sql(_DOCUMENTS + ' UNION ALL SELECT -1 - page_id, html FROM pages')} SELECT source_id, sum(CASE WHEN kind IN ('space', 'comment') THEN 1 ELSE 0 END)::BIGINT AS trivia, count(*) AS n FROM tokens GROUP BY 1")
def x11_trivia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: how many tokens of each document and page are trivia."""
    both = _sources(spark, sf_dir, "documents").union(_sources(spark, sf_dir, "pages").select(-1 - F.col("source_id"), "text"))
    return lexing.tokens(both).groupBy("source_id").agg(F.count_if(F.col("kind").isin(*lexing.TRIVIA)).alias("trivia"), F.count("*").alias("n"))


#: Every document as a list of its lines, each a list of its words: brackets that nest, with commas between.
_LISTS = "SELECT doc_id AS source_id, '[{' || replace(replace(text, '. ', ', ('), chr(10), '}, {') || repeat(')', CAST((length(text) - length(replace(text, '. ', ''))) / 2 AS INT) % 3) || '}]' AS text FROM documents"
_LEVELS = """marks AS (SELECT source_id, s, e, kind, t, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY i) + CASE WHEN kind = 'close' THEN 1 ELSE 0 END AS level FROM tokens WHERE kind IN ('open', 'close', 'comma')),
turns AS (SELECT *, lead(t) OVER w AS after, lag(t) OVER w AS before FROM marks WHERE kind <> 'comma' WINDOW w AS (PARTITION BY source_id, level ORDER BY s)),
broken AS (SELECT source_id, s, t FROM turns WHERE CASE WHEN kind = 'open' THEN after IS DISTINCT FROM translate(t, '([{', ')]}') ELSE before IS DISTINCT FROM translate(t, ')]}', '([{') END)"""


_MARKS = ("open", "close", "comma")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("source_id"), F.expr("concat('[{', replace(replace(text, '. ', ', ('), chr(10), '}, {'), repeat(')', cast((length(text) - length(replace(text, '. ', ''))) / 2 as int) % 3), '}]')").alias("text"))


@query(f"WITH {_tokens_sql(_LISTS)}, {_LEVELS} SELECT source_id, s AS start, t AS text FROM broken")
def x8_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets without a partner of their shape in documents rewritten as lists of lists, many of them broken."""
    return lexing.unbalanced(lexing.bracket_levels(lexing.tokens(_lists(spark, sf_dir), kinds=_MARKS)))


@query(f"""WITH {_tokens_sql(_LISTS)}, {_LEVELS},
opens AS (SELECT o.source_id, o.level, o.s AS list_start, o.e, (SELECT min(c.s) FROM marks c WHERE c.source_id = o.source_id AND c.level = o.level AND c.kind = 'close' AND c.s > o.s) AS list_end FROM marks o WHERE o.kind = 'open' AND o.source_id NOT IN (SELECT source_id FROM broken)),
commas AS (SELECT o.source_id, o.list_start, o.list_end, o.e, list(m.s ORDER BY m.s) FILTER (m.s IS NOT NULL) AS cs FROM opens o LEFT JOIN marks m ON m.source_id = o.source_id AND m.level = o.level AND m.kind = 'comma' AND m.s > o.list_start AND m.s < o.list_end GROUP BY ALL)
SELECT source_id, list_start, n::INT AS n, CASE WHEN n = 0 THEN e ELSE cs[n] + 1 END AS start, coalesce(cs[n + 1], list_end) AS "end", CASE WHEN n > 0 THEN cs[n] END AS previous, cs[n + 1] AS following
FROM (SELECT *, unnest(range(coalesce(len(cs), 0) + 1)) AS n FROM commas)""")
def x10_list_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between the commas of every bracket of documents rewritten as lists of lists, with the commas beside."""
    return lexing.segments(lexing.bracket_levels(lexing.tokens(_lists(spark, sf_dir), kinds=_MARKS)))


def _space_elements(tokens: DataFrame) -> DataFrame:
    """The spaces of each text as elements of one list; every fifth and the one behind it are dropped."""
    i = F.row_number().over(Window.partitionBy("source_id").orderBy("start")) - 1
    spaces = tokens.where("kind = 'space'").select("source_id", F.lit(0).alias("list_id"), i.alias("i"), "start", "end")
    return spaces.withColumn("kept", F.col("i") % 5 > 0)


#: A window of six tokens on each side of a deleted space, lexed again.
_GLUED = rf"""spaces AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY i) - 1 AS k FROM (SELECT source_id, i, s, e, kind, list(t) OVER l AS lt, list(kind) OVER l AS lk, list(t) OVER r AS rt, list(kind) OVER r AS rk FROM tokens
  WINDOW l AS (PARTITION BY source_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY source_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) WHERE kind = 'space'),
glued AS (SELECT source_id, k, s, regexp_extract_all(array_to_string(coalesce(lt, []), '') || array_to_string(coalesce(rt, []), ''), {_quoted(_TOKEN)}) AS got, list_concat(coalesce(lt, []), coalesce(rt, [])) AS want FROM spaces WHERE k % 5 = 0),
bad AS (SELECT source_id, k, s FROM glued WHERE list_filter(got, lambda t: NOT regexp_matches(t, '^[ \t\r\n\x0B\x0C]|^//|^/\*')) <> list_filter(want, lambda t: NOT regexp_matches(t, '^[ \t\r\n\x0B\x0C]|^//|^/\*')))"""


def _spaces(tokens: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """text, start, end, i, kept: _space_elements() of some texts, by arrays."""
    text, start, end = (c[tokens[3] == lexing.KINDS.index("space")] for c in tokens[:3])
    i = numbers_within(text)
    return text, start, end, i, i % 5 > 0


def _disturbing(texts: list[bytes], tokens: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    text, start, end, i, kept = _spaces(tokens)
    text, start, end, i = (c[~kept] for c in (text, start, end, i))
    bad = lexing.changed(texts, tokens, (text, start, end))
    return [text[bad], i[bad].astype(np.int32)]


def _repaired(texts: list[bytes], tokens: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    text, start, end, _, kept = _spaces(tokens)
    n_kept = np.bincount(text[lexing.stays(texts, tokens, (text, start, end, kept))], minlength=len(texts))
    n = np.bincount(text, minlength=len(texts))
    own = np.flatnonzero(n)
    return [own, n_kept[own], n[own]]


@query(f"WITH {_tokens_sql(_DOCUMENTS)}, {_GLUED} SELECT source_id, k::INT AS deletion_id FROM bad")
def x6_disturbing_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which deletions of every fifth space of each document change a token beside them."""
    return disturbing_spaces(_sources(spark, sf_dir, "documents"))


def disturbing_spaces(sources: DataFrame, piece_bytes: int = lexing.PIECE_BYTES) -> DataFrame:
    short, long = lexing.by_length(sources, piece_bytes)
    found = lexing.within(short, _disturbing, "deletion_id int")
    if long is None:
        return found
    tokens = written(lexing.tokens(long, piece_bytes).select("source_id", "start", "end", "kind", "text"))
    deletions = _space_elements(tokens).where("not kept").select("source_id", F.col("i").alias("deletion_id"), "start", "end")
    return found.union(lexing.disturbing(tokens, deletions))


@query(f"WITH {_tokens_sql(_DOCUMENTS)}, {_GLUED} SELECT source_id, count(*) FILTER (k % 5 > 0 OR (source_id, k) IN (SELECT source_id, k FROM bad)) AS n_kept, count(*) AS n FROM spaces GROUP BY 1")
def e9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spaces of each document stay, if dropping every fifth must leave all other tokens as they are."""
    return repaired_spaces(_sources(spark, sf_dir, "documents"))


def repaired_spaces(sources: DataFrame, piece_bytes: int = lexing.PIECE_BYTES) -> DataFrame:
    short, long = lexing.by_length(sources, piece_bytes)
    found = lexing.within(short, _repaired, "n_kept long, n long")
    if long is None:
        return found
    tokens = written(lexing.tokens(long, piece_bytes).select("source_id", "start", "end", "kind", "text"))
    elements = _space_elements(tokens)
    kept = lexing.repaired(tokens, elements).groupBy("source_id").agg(F.count("*").alias("n_kept"))
    return found.union(elements.groupBy("source_id").agg(F.count("*").alias("n")).join(kept, "source_id", "left").select("source_id", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "n"))

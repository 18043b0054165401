"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document on its own. A bounded random sample gives every
rule's cost (seconds a row) and selectivity (share it rejects); rules are then
tried in descending order of rejections per cost, and a document that one rule
rejects is not shown to the later ones. The verdict does not depend on
the order, only the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RE, drop_table, materialize

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition measure.
WINDOW = 5
#: Rows of the sample that orders the rules.
SAMPLE_ROWS = 500
#: How often the cost of a rule is taken on each sampled row.
TURNS = 12
#: Thresholds of the rules.
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MAX_SYMBOLS_PER_100_WORDS = 20
MAX_UPPER_PERCENT = 50
MAX_EXCLAMATIONS_PER_100_WORDS = 30
MAX_DUPLICATE_LINE_PERCENT = 30
MAX_MEAN_WORD = 30
MIN_MEAN_WORD = 2


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body
    names it (a lambda variable is never replaced by its definition)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def removed(text: Column, characters: str) -> Column:
    """Code points of ``text`` that are in ``characters``."""
    marks = "".join(f"\\x{ord(c):02X}" for c in characters)
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{marks}]+", ""))).cast("long")


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_RE), "")


def word_characters(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of the window that starts at each word."""
    return F.when(
        F.size(words) > WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(words: Column, hashes: Column) -> Column:
    """Words under windows that occur again, where some hashes are equal.

    Start positions are sorted by hash (hash and position packed in one
    integer), and a start counts when the words of a neighbour's window in that
    order are equal to its own.
    """

    def counted(mask: Column) -> Column:
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

        def of_sorted(order: Column) -> Column:
            place = lambda k: F.get(order, k).bitwiseAND(mask).cast("int")
            same = lambda p, q: (F.get(hashes, p) == F.get(hashes, q)) & (F.slice(words, p + 1, WINDOW) == F.slice(words, q + 1, WINDOW))
            alike = lambda k, j: F.coalesce(same(place(k), place(j)), F.lit(False))
            again = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda k: alike(k, k + 1) | F.when(k > 0, alike(k, k - 1)).otherwise(F.lit(False)))
            return bound(F.sort_array(F.transform(again, place)), covered)

        return bound(packed, of_sorted)

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    bits = F.ceil(F.log2(F.size(words).cast("double") + 1)).cast("int") + 1
    return bound(F.pow(F.lit(2.0), bits).cast("long") - 1, counted)


def repeated_words(words: Column) -> Column:
    """Words that lie in a window found twice or more, first copies included.

    One expression over ``words``: texts whose window hashes all differ are
    done (equal windows have equal hashes), only the others are sorted.
    """
    none = F.lit(0).cast("long")
    return bound(_window_hashes(words), lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_covered(words, hashes)))


def _prepared(docs: DataFrame, *kept: Column) -> DataFrame:
    """``_text``, ``_words`` and ``_lines`` of every row beside ``kept``.

    ``_row`` numbers the rows. It is not deterministic, so Catalyst neither
    pushes a filter on what is derived from these columns below them nor puts
    their definitions in its place: each is computed once a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*kept, text.alias("_text"), word_array(text).alias("_words"), lines_with_words(text).alias("_lines"), F.monotonically_increasing_id().alias("_row"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the prepared columns and the measures of every whole text; null
    texts have no words and a null doc_id stays null."""
    return _prepared(docs, F.col("doc_id")).select(
        "doc_id",
        "_text",
        "_words",
        "_lines",
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        word_characters(F.col("_words")).alias("word_chars"),
        removed(F.col("_text"), SYMBOLS).alias("n_symbols"),
        duplicate_lines(F.col("_lines")).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects``: a predicate over ``_text``, ``_words`` and ``_lines``."""

    name: str
    rejects: Column


def base_rules(repeats: Column) -> list[Rule]:
    n = F.size("_words")
    return [Rule("few_words", n < MIN_WORDS), Rule("repeated_words", 100 * repeats > MAX_REPEATED_PERCENT * n)]


def default_rules(measured: bool = False) -> list[Rule]:
    """The rules; with ``measured`` they use the columns of :func:`measures`
    where those hold what a rule needs."""
    text, n = F.col("_text"), F.size("_words")
    of = lambda name, other: F.col(name) if measured else other
    letters = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    chars = of("word_chars", word_characters(F.col("_words")))
    return base_rules(of("n_repeat_words", repeated_words(F.col("_words")))) + [
        Rule("symbols", 100 * of("n_symbols", removed(text, SYMBOLS)) > MAX_SYMBOLS_PER_100_WORDS * n),
        Rule("shouting", 100 * letters(r"\p{Lu}+") > MAX_UPPER_PERCENT * letters(r"\p{L}+")),
        Rule("exclamations", 100 * removed(text, "!") > MAX_EXCLAMATIONS_PER_100_WORDS * n),
        Rule("duplicate_lines", 100 * of("n_dup_lines", duplicate_lines(F.col("_lines"))) > MAX_DUPLICATE_LINE_PERCENT * F.size("_lines")),
        Rule("word_length", (chars > MAX_MEAN_WORD * n) | (chars < MIN_MEAN_WORD * n)),
    ]


def order_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected), best rejection per cost first.

    The sample is drawn at random over the whole table, ``sample_rows`` of them
    on average and twice as many at most, and only sets the order. A rule's
    cost is what it adds to a job that evaluates each sampled row ``TURNS``
    times, so that starting a job does not count. On an empty table the given
    order stays. Null texts count as empty ones.
    """
    rules = rules or default_rules()
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = docs.select("text").sample(share, seed=5).limit(2 * sample_rows)
    sample = materialize(_prepared(drawn).drop("_row").repartition(max(1, min(8, docs.sparkSession.sparkContext.defaultParallelism))), "rule-sample")
    rows = sample.count()
    if not rows:
        drop_table(sample)
        return [(r, 0.0, 0.0) for r in rules]
    often = sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(TURNS))))

    def timed(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        n = often.agg(F.sum(F.when(rejects, 1).otherwise(0)).alias("n")).first()["n"]
        return time.perf_counter() - began, n / (rows * TURNS)

    empty = F.size("_words") < 0
    timed(empty)
    idle = timed(empty)[0]
    found = []
    for r in rules:
        seconds, rejected = timed(r.rejects)
        found.append((r, max(seconds - idle, 0.002) / (rows * TURNS), rejected))
    drop_table(sample)
    if any(rejected for _, _, rejected in found):
        found.sort(key=lambda x: -x[2] / x[1])
    return found


def verdict(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null where none does. The branches
    of one CASE are tried in turn: a row that a rule rejects is not shown to
    the later ones."""
    first, *others = [(r.rejects, F.lit(r.name)) for r in ordered]
    found = F.when(*first)
    for rejects, name in others:
        found = found.when(rejects, name)
    return found


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they are.

    Rules run in the sampled order, and no measure is computed for a row that
    an earlier rule rejects. Null and empty texts have no words and are
    rejected; repeated rows are judged alike and all stay; an empty table gives
    an empty one. Columns of any name are carried along untouched.
    """
    ordered = [r for r, _, _ in order_rules(docs, rules, sample_rows)]
    df = _prepared(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept"))
    df = df.select("_kept", "_row", verdict(ordered).alias("_verdict"))
    return df.where(F.col("_verdict").isNull() & (F.col("_row") >= 0)).select("_kept.*")


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The measures of every document with base_failed, kept and rejected_by.

    ``rejected_by`` names the first rule of the cascade that rejects (null if
    kept); which of several it names depends on the sampled order, ``kept``
    does not. ``kept`` is false wherever ``base_failed`` is true. Null and
    empty texts have no words and fail; repeated rows give repeated rows.
    """
    given = rules or default_rules()
    place = {r.name: k for k, (r, _, _) in enumerate(order_rules(docs, given, sample_rows))}
    ordered = sorted(rules or default_rules(measured=True), key=lambda r: place[r.name])
    df = measures(docs)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", base).withColumn("rejected_by", verdict(ordered)).where("_row >= 0")
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")


#: The same result in DuckDB, with plain definitions and no cascade.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0] AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, list_slice(ws, i, i + 4) AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
r AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words
            OR 100 * (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) > 50 * (length(t) - length(regexp_replace(t, '\p{L}', '', 'g')))
            OR 100 * (length(t) - length(replace(t, '!', ''))) > 30 * n_words
            OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars > 30 * n_words OR word_chars < 2 * n_words) AS kept
FROM f
"""

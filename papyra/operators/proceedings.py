"""Proceedings volumes: contents, volume titles, child papers, cleaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import match_key

CONTENTS = r"(?im)^#\s+(?:table of contents|contents)\s*$"


def volume_title(text: Column, fallback: Column) -> Column:
    """A first-level heading with 'Proceedings of', else the first that doesn't
    end in 'editors', else the fallback."""
    heads = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#\s+(.+)$"), F.lit(1)), lambda h: F.trim(h))
    named = F.filter(heads, lambda h: F.contains(F.lower(h), F.lit("proceedings of")))
    plain = F.filter(heads, lambda h: (h != "") & ~F.endswith(F.lower(h), F.lit("editors")))
    return F.coalesce(F.get(named, F.lit(0)), F.get(plain, F.lit(0)), fallback)


def contents_titles(text: Column) -> Column:
    """Titles of the contents: its paragraphs without page and author tails, up
    to the first paper (heading, authors, 'Abstract.')."""
    after = F.get(F.split(text, CONTENTS, 2), F.lit(1))
    block = F.get(F.split(after, r"(?m)^#\s+[^\n]+\n\n(?:[^\n]+\n)+\nAbstract\.", 2), F.lit(0))
    entries = F.transform(F.split(F.coalesce(block, F.lit("")), r"\n\s*\n"), lambda e: F.trim(F.regexp_replace(e, r"\s+", " ")))
    entries = F.filter(entries, lambda e: (e != "") & ~F.startswith(F.lower(e), F.lit("author index")))
    bare = F.transform(entries, lambda e: F.regexp_replace(F.regexp_replace(e, r"\s+\d+\s+[A-Z].*$", ""), r"^[ .]+|[ .]+$", ""))
    return F.filter(bare, lambda e: e != "")


def opening_lines(text: Column, n: int = 8) -> Column:
    return F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, n)


def closing_lines(text: Column, n: int = 6) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n)


def signals(papers: DataFrame) -> DataFrame:
    """paper_id and what speaks against a child being a paper of its own."""
    opening = opening_lines(F.col("md_text"), 12)
    some = lambda a, b, test: F.exists(F.slice(opening, a, b), test)
    rules = [
        ("missing_authors", F.coalesce(F.size("authors"), F.lit(0)) <= 0),
        ("missing_abstract", F.coalesce(F.col("abstract"), F.lit("")) == ""),
        ("missing_doi", F.coalesce(F.col("doi"), F.lit("")) == ""),
        ("discussion_title", F.startswith(F.lower("title"), F.lit("discussion of"))),
        ("comment_label", some(2, 3, lambda x: F.startswith(F.lower(x), F.lit("comment")))),
        ("reporter_line", some(1, 5, lambda x: F.contains(F.lower(x), F.lit("reporter")))),
        ("starts_with_numbered_section", some(1, 3, lambda x: x.rlike(r"^\d+[.)]"))),
    ]
    return papers.select("paper_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])).alias("signals"))


def without_headings(text: Column, headings: Column) -> Column:
    """Text without the heading lines that match one of the given ones."""
    keys = F.transform(headings, match_key)
    keep = lambda x: ~(x.rlike(r"^\s*#") & F.array_contains(keys, match_key(F.regexp_replace(x, r"^[\s#]+", ""))))
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


@F.pandas_udf(T.StructType().add("authors", T.ArrayType(T.StringType())).add("abstract", T.StringType()))
def chunk_front(chunk: pd.Series) -> pd.DataFrame:
    """Author lines (the paragraph under the heading) and the abstract (from its
    label to the next blank line or heading)."""
    import re

    def one(text: str | None) -> tuple[list[str], str]:
        paragraphs = [[x.strip() for x in p.split("\n") if x.strip()] for p in re.split(r"\n\s*\n", (text or "").strip())]
        paragraphs = [p for p in paragraphs if p]
        if paragraphs and paragraphs[0][0].startswith("#"):
            paragraphs[0] = paragraphs[0][1:]
            paragraphs = [p for p in paragraphs if p]
        authors: list[str] = []
        if paragraphs and not re.match(r"(?i)#*\s*abstract|#", paragraphs[0][0]):
            authors = [x for x in paragraphs[0] if not x.lower().startswith("comment")][:5]
        for i, p in enumerate(paragraphs):
            if m := re.match(r"(?i)#*\s*abstract\.?:?\s*(.*)", p[0]):
                body = [m[1], *p[1:]] if m[1] or len(p) > 1 else (paragraphs[i + 1] if i + 1 < len(paragraphs) else [])
                body = [x for x in body if x and not x.lower().startswith("keywords") and not x.startswith("#")]
                return authors, "\n".join(body)
        return authors, ""

    got = [one(t) for t in chunk]
    return pd.DataFrame({"authors": [g[0] for g in got], "abstract": [g[1] for g in got]})


def cleaned(papers: DataFrame, plan: DataFrame) -> DataFrame:
    """Papers after a plan (paper_id, action keep|drop|rename, title, headings)."""
    p = plan.select("paper_id", "action", F.col("title").alias("_title"), "headings")
    rows = papers.join(p, "paper_id", "left").where(F.coalesce("action", F.lit("keep")) != "drop")
    rows = rows.withColumn("title", F.when(F.col("action") == "rename", F.coalesce("_title", "title")).otherwise(F.col("title")))
    text = F.when(F.size("headings") > 0, without_headings(F.col("md_text"), F.col("headings"))).otherwise(F.col("md_text"))
    return rows.withColumn("md_text", text).drop("action", "_title", "headings")

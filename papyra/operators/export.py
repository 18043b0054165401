"""Reference lists: BibTeX, RIS and four Markdown styles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import last_name

#: Document types in BibTeX and RIS (fixed values).
BIBTEX_TYPES = {
    "journal-article": "article", "review": "article", "book-chapter": "inbook", "book": "book", "proceedings-article": "inproceedings", "conference-paper": "inproceedings", "thesis": "phdthesis", "dissertation": "phdthesis", "preprint": "misc",
    "document": "misc", "technical-report": "techreport", "manual": "manual", "lecture-notes": "misc", "standard": "misc", "white-paper": "misc", "presentation": "misc", "meeting-notes": "misc",
}
RIS_TYPES = {
    "journal-article": "JOUR", "review": "JOUR", "book-chapter": "CHAP", "book": "BOOK", "proceedings-article": "CONF", "conference-paper": "CONF", "thesis": "THES", "dissertation": "THES", "preprint": "UNPB",
    "document": "GEN", "technical-report": "RPRT", "manual": "MANSCPT", "lecture-notes": "GEN", "standard": "STAND", "white-paper": "RPRT", "presentation": "SLIDE", "meeting-notes": "GEN",
}


def _mapped(column: Column, values: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[column], F.lit(default))


def _has(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%#_])", r"\\$1")


def cite_key(last: Column, year: Column, title: Column) -> Column:
    """Latin letters of the family name, year, first title word with more than
    three of them."""
    bare = lambda c: F.regexp_replace(c, "[^a-zA-Z]", "")
    words = F.filter(F.transform(F.split(F.trim(F.coalesce(title, F.lit(""))), r"\s+"), bare), lambda w: F.length(w) > 3)
    name = F.when(_has(last), last).otherwise("Unknown")
    return F.concat(bare(name), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(F.initcap(F.lower(F.get(words, F.lit(0)))), F.lit("")))


def _family(records: DataFrame) -> Column:
    """The stored family name, else that of the first author."""
    first = F.coalesce(F.get("authors", F.lit(0)), F.lit(""))
    made = F.when(first != "", last_name(first))
    return F.coalesce(F.nullif(F.trim("first_author_lastname"), F.lit("")), made) if "first_author_lastname" in records.columns else made


#: Fields of an entry in their order, with the column and whether it is escaped
#: and put into braces of its own (fixed values).
BIBTEX_FIELDS = [
    ("title", "title", True, True), ("author", "authors", True, False), ("year", "year_text", False, False), ("journal", "journal", True, False), ("volume", "volume", False, False), ("number", "issue", False, False),
    ("pages", "pages", False, False), ("publisher", "publisher", True, False), ("issn", "issn", False, False), ("doi", "doi", False, False), ("abstract", "abstract", True, True),
]


def bibtex(records: DataFrame) -> DataFrame:
    """paper_id and entry. Needs authors (array), year_text, title, paper_type;
    every other field of ``BIBTEX_FIELDS`` is given if there is such a column.
    Null and blank fields are left out."""

    def field(name: str, column: str, escape: bool, braced: bool) -> Column:
        raw = F.array_join("authors", " and ") if column == "authors" else F.col(column).cast("string")
        value = escaped(raw) if escape else raw
        return F.when(_has(raw), F.concat(F.lit(f"  {name} = {{" + "{" * braced), value, F.lit("}" * braced + "},")))

    lines = F.array_compact(F.array(*[field(*f) for f in BIBTEX_FIELDS if f[1] in records.columns]))
    head = F.concat(F.lit("@"), _mapped(F.col("paper_type"), BIBTEX_TYPES, "article"), F.lit("{"), cite_key(_family(records), F.col("year_text"), F.col("title")), F.lit(","))
    return records.select("paper_id", F.array_join(F.concat(F.array(head), lines, F.array(F.lit("}"))), "\n").alias("entry"))


def ris(records: DataFrame) -> DataFrame:
    """paper_id and entry; columns as for :func:`bibtex`. Pages are a first and,
    after a dash, a last one; the DOI is given as an address too."""
    tag = lambda t, c: F.when(_has(c), F.concat(F.lit(f"{t}  - "), c.cast("string")))
    some = lambda *pairs: [tag(t, F.col(c)) for t, c in pairs if c in records.columns]
    dash = F.instr("pages", "-")
    first = F.when(dash > 0, F.trim(F.substring_index("pages", "-", 1))).otherwise(F.col("pages"))
    pages = [tag("SP", first), F.when(dash > 0, F.concat(F.lit("EP  - "), F.trim(F.substr("pages", dash + 1))))] if "pages" in records.columns else []
    address = [F.when(_has(F.col("doi")), F.concat(F.lit("UR  - https://doi.org/"), F.col("doi")))] if "doi" in records.columns else []
    tail = [*some(("PY", "year_text"), ("JO", "journal"), ("VL", "volume"), ("IS", "issue")), *pages, *some(("PB", "publisher"), ("SN", "issn"), ("DO", "doi")), *address, *some(("AB", "abstract")), F.lit("ER  -")]
    head = F.array(F.concat(F.lit("TY  - "), _mapped(F.col("paper_type"), RIS_TYPES, "GEN")), tag("TI", F.col("title")))
    lines = F.array_compact(F.concat(head, F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), F.array(*tail)))
    return records.select("paper_id", F.array_join(lines, "\n").alias("entry"))


def _initials(name: Column, mark: str, joint: str) -> Column:
    given = F.regexp_extract_all(F.regexp_replace(name, r"\s*\S+$", ""), F.lit(r"(\p{L})[\p{L}.'-]*"), F.lit(1))
    return F.array_join(F.transform(given, lambda g: F.concat(F.upper(g), F.lit(mark))), joint)


def _last_word(name: Column) -> Column:
    return F.regexp_extract(name, r"(\S+)$", 1)


def _inverted(name: Column, mark: str, joint: str, sep: str) -> Column:
    initials = _initials(name, mark, joint)
    return F.when(initials == "", _last_word(name)).otherwise(F.concat(_last_word(name), F.lit(sep), initials))


def _turned(name: Column) -> Column:
    """'Last, Given names'."""
    given = F.trim(F.regexp_replace(name, r"\S+$", ""))
    return F.when(given == "", _last_word(name)).otherwise(F.concat(_last_word(name), F.lit(", "), given))


def authors_apa(a: Column) -> Column:
    names = F.transform(a, lambda n: _inverted(n, ".", " ", ", "))
    n = F.size(a)
    return F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).when(n <= 3, F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", & "), F.element_at(names, -1))).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(", et al.")))


def authors_vancouver(a: Column) -> Column:
    names = F.transform(a, lambda n: _inverted(n, "", "", " "))
    return F.when(F.size(a) <= 6, F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, 1, 6), ", "), F.lit(", et al")))


def authors_chicago(a: Column) -> Column:
    n, first = F.size(a), _turned(F.get(a, F.lit(0)))
    rest = F.slice(a, 2, F.greatest(n - 2, F.lit(0)))
    many = F.concat_ws(", ", first, F.when(n > 2, F.array_join(rest, ", ")))
    return F.when(n == 0, "").when(n == 1, first).when(n <= 3, F.concat(many, F.lit(", and "), F.element_at(a, -1))).otherwise(F.concat(first, F.lit(", et al.")))


def authors_mla(a: Column) -> Column:
    n, first = F.size(a), _turned(F.get(a, F.lit(0)))
    return F.when(n == 0, "").when(n == 1, first).when(n == 2, F.concat(first, F.lit(", and "), F.get(a, F.lit(1)))).otherwise(F.concat(first, F.lit(", et al.")))


def _opt(c: Column, before: str, after: str) -> Column:
    return F.when(_has(c), F.concat(F.lit(before), c.cast("string"), F.lit(after))).otherwise(F.lit(""))


def style_apa() -> Column:
    return F.concat(_opt(authors_apa(F.col("authors")), "", " "), F.lit("("), F.when(_has(F.col("year_text")), F.col("year_text")).otherwise("n.d."), F.lit("). "), F.col("title"), F.lit("."), _opt(F.col("journal"), " *", "*."), _opt(F.col("doi"), " https://doi.org/", ""))


def style_vancouver() -> Column:
    return F.concat(_opt(authors_vancouver(F.col("authors")), "", ". "), F.col("title"), F.lit("."), _opt(F.col("journal"), " ", "."), _opt(F.col("year_text"), " ", "."), _opt(F.col("doi"), " doi:", ""))


def style_chicago() -> Column:
    return F.concat(_opt(authors_chicago(F.col("authors")), "", ". "), F.lit('"'), F.col("title"), F.lit('."'), _opt(F.col("journal"), " *", "*"), _opt(F.col("year_text"), " (", ")"), F.lit("."), _opt(F.col("doi"), " https://doi.org/", "."))


def style_mla() -> Column:
    return F.concat(_opt(authors_mla(F.col("authors")), "", ". "), F.lit('"'), F.col("title"), F.lit('."'), _opt(F.col("journal"), " *", "*,"), _opt(F.col("year_text"), " ", "."), _opt(F.col("doi"), " https://doi.org/", "."))


STYLES: dict[str, Callable[[], Column]] = {"apa": style_apa, "vancouver": style_vancouver, "chicago": style_chicago, "mla": style_mla}
_custom: dict[str, Callable[[dict, int], str]] = {}


def register_style(name: str, format_ref: Callable[[dict, int], str]) -> None:
    """A style of one's own: a function of a record and its number."""
    if not name.isidentifier() or name in STYLES:
        raise ValueError(f"not a valid style name: {name!r}")
    _custom[name] = format_ref


def reference_list(records: DataFrame, style: str = "apa") -> DataFrame:
    """paper_id, nth and ref, newest first, then by title."""
    rows = records.withColumn("_year", F.coalesce(F.expr("try_cast(year_text AS INT)"), F.lit(0)))
    # numbers within a year and the titles' first letters, plus how many records
    # come before: one row a group there, the records themselves are never one task's
    rows = rows.withColumn("_letters", F.coalesce(F.substring("title", 1, 3), F.lit("")))
    before = F.sum("_n").over(Window.orderBy(F.desc("_year"), "_letters").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("_year", "_letters").agg(F.count(F.lit(1)).alias("_n")).select("_year", "_letters", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_year", "_letters").orderBy("title", "paper_id"))
    rows = rows.withColumn("_i", within).join(offsets, ["_year", "_letters"]).withColumn("nth", (F.col("_before") + F.col("_i")).cast("int")).drop("_year", "_letters", "_i", "_before")
    if style in STYLES:
        return rows.select("paper_id", "nth", F.concat(F.col("nth").cast("string"), F.lit(". "), STYLES[style]()).alias("ref"))
    fmt = _custom[style]

    def write(it):
        for pdf in it:
            metas = pdf.drop(columns=["nth"]).to_dict("records")
            yield pd.DataFrame({"paper_id": pdf["paper_id"], "nth": pdf["nth"], "ref": [fmt(m, int(i)) for m, i in zip(metas, pdf["nth"])]})

    return rows.mapInPandas(write, "paper_id string, nth int, ref string")


def export_filter(records: DataFrame, year_from: int | None = None, year_to: int | None = None, journal: str | None = None, paper_type: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Filters of the exports: an unknown year fails either kind of bound."""
    year = F.expr("try_cast(year_text AS INT)")
    if year_from is not None:
        records = records.where(F.coalesce(year, F.lit(0)) >= year_from)
    if year_to is not None:
        records = records.where(F.coalesce(year, F.lit(9999)) <= year_to)
    for column, value in (("journal", journal), ("paper_type", paper_type)):
        if value:
            records = records.where(F.contains(F.lower(column), F.lit(value.lower())))
    return records.where(F.col("paper_id").isin(ids)) if ids else records

"""Records out of Markdown files, kinds of documents, lookup in catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import written
from ..functions.text import clean_doi, dice, last_name
from . import extract as x
from .similarity import best_matches

#: What names a kind of document (fixed values).
PATENT_WORDS = ["patent", "专利", "发明专利", "实用新型", "utility model"]
THESIS_WORDS = ["thesis", "dissertation", "学位论文", "硕士论文", "博士论文", "毕业论文", "master's thesis", "doctoral dissertation"]
BOOK_TYPES = ["book", "monograph", "edited-book", "reference-book"]
BOOK_WORDS = ["handbook", "textbook", "monograph", "专著", "教材", "手册"]
#: Least similarity of titles: strict, and of a looser second try (fixed values).
STRICT, RELAXED = 0.85, 0.65


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _names_one(title: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(title, w))


def document_kind(title: Column, paper_type: Column, number: Column, text: Column) -> Column:
    """patent, thesis, book or '' by publication number, type and title; a
    patent also by a number among the first 10,000 characters."""
    low, kind = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.trim(F.coalesce(paper_type, F.lit(""))))
    patent = ~_blank(number) | (kind == "patent") | _names_one(low, PATENT_WORDS) | (x.patent_of(F.coalesce(text, F.lit(""))) != "")
    return F.when(patent, "patent").when(_names_one(low, THESIS_WORDS), "thesis").when(kind.isin(BOOK_TYPES) | _names_one(low, BOOK_WORDS), "book").otherwise("")


def of_file_name(stem: Column) -> Column:
    """first_author, last_name, year and title that a converter's file name
    carries: Author-Year-Title with a number, or a slug with a year in it."""
    full = r"^MinerU_markdown_(.+?)-(\d{4})-(.+?)_(\d{10,})$"
    slug = F.regexp_extract(stem, r"^MinerU_markdown_(.+?)_(\d{10,})$", 1)
    dated = r"^(.*?)-(\d{4})-(.*)$"
    author = F.regexp_extract(stem, full, 1)
    author = F.when(author.rlike("[\u4e00-\u9fff]"), author).otherwise(F.replace(author, F.lit("-"), F.lit(" ")))
    first = F.initcap(F.get(F.split(F.regexp_extract(slug, dated, 1), "-"), F.lit(0)))
    spaced = lambda c, p: F.regexp_replace(c, p, " ")
    made = lambda a, n, y, t: F.struct(a.alias("first_author"), n.alias("last_name"), y.cast("int").alias("year"), t.alias("title"))
    none = F.lit("")
    return (
        F.when(stem.rlike(full), made(author, last_name(author), F.regexp_extract(stem, full, 2), spaced(F.regexp_extract(stem, full, 3), "_")))
        .when(slug.rlike(dated), made(first, first, F.regexp_extract(slug, dated, 2), spaced(F.regexp_extract(slug, dated, 3), "[-_]")))
        .otherwise(made(none, none, F.lit(None), none))
    )


def records_of_markdown(files: DataFrame) -> DataFrame:
    """One record per Markdown file (stem, md_text): what its first lines say,
    then what its name says. Null texts give what the name has."""
    text = F.coalesce(F.col("md_text"), F.lit(""))
    rows = files.select("stem", text.alias("_t"), x.front_matter(text).alias("_f"), of_file_name(F.col("stem")).alias("_n"))
    first = F.coalesce(F.get("_f.authors", F.lit(0)), F.lit(""))
    either = lambda own, other: F.when(_blank(own), other).otherwise(own)
    return rows.select(
        "stem", either(F.col("_f.title"), F.col("_n.title")).alias("title"), F.col("_f.authors").alias("authors"), either(first, F.col("_n.first_author")).alias("first_author"),
        F.when(first != "", last_name(first)).otherwise(F.col("_n.last_name")).alias("first_author_lastname"), x.doi_of(F.col("_t")).alias("doi"), x.arxiv_of_text(F.col("_t"), F.col("stem")).alias("arxiv_id"),
        F.coalesce(x.year_of_text(F.col("_t")), F.col("_n.year")).alias("year"), x.journal_of_text(F.col("_t")).alias("journal"), F.coalesce(x.abstract_of_markdown(F.col("_t")), F.lit("")).alias("abstract"),
    )


def with_patents(records: DataFrame, text: str = "md_text") -> DataFrame:
    """Records with the publication number that stands in their text where they
    have none, and the type patent for one without a DOI and with no type but
    article. Needs publication_number, doi, paper_type and the text."""
    number = F.when(_blank(F.col("publication_number")), x.patent_of(F.coalesce(F.col(text), F.lit("")))).otherwise(F.col("publication_number"))
    rows = records.withColumn("publication_number", number)
    patent = ~_blank(F.col("publication_number")) & _blank(F.col("doi")) & (_blank(F.col("paper_type")) | (F.col("paper_type") == "article"))
    return rows.withColumn("paper_type", F.when(patent, "patent").otherwise(F.col("paper_type")))


def as_documents(rows: DataFrame) -> DataFrame:
    """Records of what is no paper (stem, title, abstract, paper_type, md_text):
    the first heading or the file's name for a title, the first 500 words for an
    abstract, ``document`` for a type, each where there is none."""
    text = F.coalesce(F.col("md_text"), F.lit(""))
    heading = F.trim(F.regexp_extract(text, r"(?m)^\s*#\s+(.*)$", 1))
    name = F.regexp_replace("stem", "[-_]", " ")
    words = F.array_join(F.slice(F.array_remove(F.split(text, r"\s+"), ""), 1, 500), " ")
    either = lambda c, other: F.when(_blank(F.col(c)), other).otherwise(F.col(c)).alias(c)
    return rows.select("stem", either("title", F.when(heading != "", heading).otherwise(name)), either("abstract", words), either("paper_type", F.lit("document")))


def looked_up(local: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Where each record (paper_id, title, doi, arxiv_id, year and, if there is
    one, last_name) is found in a catalogue (catalogue_id and the same):
    paper_id, method, catalogue_id and similarity of the titles.

    The first tier that finds something counts: the DOI, unless the titles
    share less than RELAXED; the arXiv id; the title at STRICT; the title at
    RELAXED. A match by title is barred where the first authors' names differ
    and the years are more than two apart. Of several the most similar counts,
    then the smallest catalogue_id. A record found nowhere has the method
    local_only. Records that an identifier finds take no part in the search by
    titles, and one search at RELAXED serves both of its tiers.
    """
    filled = lambda df: df if "last_name" in df.columns else df.withColumn("last_name", F.lit(""))
    local, catalogue = filled(local), filled(catalogue)
    ids = lambda df: df.withColumns({"_d": F.nullif(clean_doi(F.col("doi")), F.lit("")), "_a": F.nullif(F.lower("arxiv_id"), F.lit(""))})
    cat = ids(catalogue).select("catalogue_id", F.col("title").alias("c_title"), "_d", "_a")
    own = ids(local).select("paper_id", "title", "_d", "_a")
    alike = F.when(_blank(F.col("title")) | _blank(F.col("c_title")), F.lit(1.0)).otherwise(dice(F.col("title"), F.col("c_title")))
    hit = lambda rows, tier, method: rows.select("paper_id", F.lit(tier).alias("tier"), F.lit(method).alias("method"), "catalogue_id", "similarity")
    by_doi = hit(own.join(cat.drop("_a"), "_d").withColumn("similarity", alike).where(F.col("similarity") >= RELAXED), 1, "doi_lookup")
    by_arxiv = hit(own.join(cat.drop("_d"), "_a").withColumn("similarity", alike), 2, "arxiv_lookup")
    first = F.min(F.struct("tier", (-F.col("similarity")).alias("s"), "catalogue_id", "method")).alias("b")
    by_id = written(by_doi.union(by_arxiv).groupBy("paper_id").agg(first), "looked-up")
    rest = local.join(by_id, "paper_id", "left_anti")
    titles = best_matches(rest, catalogue, RELAXED).withColumn("method", F.when(F.col("similarity") >= STRICT, "title_search").otherwise("title_search_relaxed"))
    found = by_id.select("paper_id", "b.method", "b.catalogue_id", (-F.col("b.s")).alias("similarity")).unionByName(titles)
    return local.select("paper_id").join(found, "paper_id", "left").select("paper_id", F.coalesce("method", F.lit("local_only")).alias("method"), "catalogue_id", "similarity")


def updated(records: DataFrame, changes: DataFrame, fields: list[str], key: str = "paper_id") -> DataFrame:
    """Records with the non-empty fields of ``changes`` put over their own, and
    ``changed``: the names of the fields that differ now."""
    new = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    now = lambda f: F.when(_blank(F.col(f"_new_{f}").cast("string")), F.col(f)).otherwise(F.col(f"_new_{f}"))
    rows = records.join(new, key, "left")
    differs = F.array_compact(F.array(*[F.when(~now(f).eqNullSafe(F.col(f)), F.lit(f)) for f in fields]))
    return rows.select(*[now(c).alias(c) if c in fields else F.col(c) for c in records.columns], differs.alias("changed"))


#: Fields that a second lookup may change (fixed values).
REFETCH_FIELDS = [
    "title", "authors", "first_author", "first_author_lastname", "year", "doi", "journal", "citation_count", "ids", "api_sources", "abstract", "paper_type", "volume", "issue", "pages", "publisher", "issn", "references",
]


def _with_addresses(ids: Column) -> Column:
    """Identifiers (map) with the addresses that follow from them, in order."""
    made = [("doi", "doi_url", lambda v: F.concat(F.lit("https://doi.org/"), v)), ("arxiv", "arxiv_url", lambda v: F.concat(F.lit("https://arxiv.org/abs/"), v)),
            ("semantic_scholar", "semantic_scholar_url", lambda v: F.concat(F.lit("https://www.semanticscholar.org/paper/"), v)),
            ("openalex", "openalex_url", lambda v: F.when(F.contains(v, F.lit("openalex.org")) & ~F.contains(v, F.lit("/works/")), F.replace(v, F.lit("https://openalex.org/"), F.lit("https://openalex.org/works/"))).otherwise(v))]
    given = F.map_entries(F.coalesce(ids, F.create_map().cast("map<string,string>")))
    more = [F.when((F.coalesce(ids[k], F.lit("")) != "") & ids[u].isNull(), F.struct(F.lit(u).alias("key"), of(ids[k]).alias("value"))) for k, u, of in made]
    return F.array_sort(F.concat(given, F.array_compact(F.array(*more))))


def refetched(records: DataFrame, found: DataFrame, key: str = "paper_id") -> DataFrame:
    """Records with what a second lookup says and ``changed``, the names of the
    ``REFETCH_FIELDS`` that differ then, in that order.

    ``found`` has a row for each record that was looked up again, with the
    fields it may have. What it leaves blank stays. Citation counts and sources
    are those of the lookup, unless it reached no service, or the preprint
    service alone for a record that has counts: then the old ones stay. Blank
    and null texts are the same; identifiers are compared with the addresses
    that follow from them.
    """
    kinds = {f.name: f.dataType.typeName() for f in records.schema}
    fields = [f for f in REFETCH_FIELDS if f in records.columns and f in found.columns]
    rows = records.join(found.select(key, F.lit(True).alias("_again"), *[F.col(f).alias(f"_new_{f}") for f in fields]), key, "left")

    def blank(f: str) -> Column:
        c = F.col(f"_new_{f}")
        return c.isNull() | (F.size(c) <= 0) if kinds[f] in ("array", "map") else _blank(c.cast("string"))

    again = F.coalesce("_again", F.lit(False))
    if "api_sources" in fields:
        reached = F.coalesce(F.col("_new_api_sources"), F.array().cast("array<string>"))
        counts = F.coalesce(F.size("citation_count"), F.lit(0)) > 0 if "citation_count" in records.columns else F.lit(False)
        kept = (F.size(reached) == 0) | ((F.size(F.array_except(reached, F.array(F.lit("arxiv")))) == 0) & counts)
    else:
        kept = F.lit(True)

    def now(f: str) -> Column:
        if f in ("citation_count", "api_sources"):
            return F.when(again & ~kept, F.col(f"_new_{f}")).otherwise(F.col(f))
        return F.when(again & ~blank(f), F.col(f"_new_{f}")).otherwise(F.col(f))

    def shown(f: str, c: Column) -> Column:
        if f == "ids":
            return F.to_json(_with_addresses(c))
        if kinds[f] == "map":
            return F.to_json(F.array_sort(F.map_entries(c)))
        return F.to_json(c) if kinds[f] == "array" else F.coalesce(c.cast("string"), F.lit("")) if kinds[f] == "string" else c.cast("string")

    differs = F.array_compact(F.array(*[F.when(~shown(f, now(f)).eqNullSafe(shown(f, F.col(f))), F.lit(f)) for f in fields]))
    return rows.select(*[now(c).alias(c) if c in fields else F.col(c) for c in records.columns], differs.alias("changed"))


def backfilled(records: DataFrame, texts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """paper_id, outcome, abstract and source of every record's abstract.

    With ``pages`` (doi, html) the publisher's abstract wins over the record's
    own: ``filled`` where there was none, ``updated`` where it differs,
    ``skipped`` where it is the same. Else a record that has one is
    ``skipped``, and of the others the text (``texts``: paper_id, md_text)
    gives one: ``filled``, ``failed`` where nothing is found in it, ``skipped``
    without a text. ``abstract`` is the one to write, null for none; source is
    page or text. Of several pages of a DOI the largest abstract counts.
    """
    own = F.nullif(F.trim(F.coalesce("abstract", F.lit(""))), F.lit(""))
    doi = F.nullif(F.nullif(clean_doi(F.col("doi")), F.lit("")), F.lit("null"))
    rows = records.select("paper_id", own.alias("_own"), doi.alias("_d"))
    if pages is None:
        rows = rows.withColumn("_p", F.lit(None).cast("string"))
    else:
        found = pages.select(clean_doi(F.col("doi")).alias("_d"), x.abstract_of_html(F.col("html")).alias("_p")).groupBy("_d").agg(F.max("_p").alias("_p"))
        rows = rows.join(found, "_d", "left")
    read = texts.select("paper_id", F.lit(True).alias("_file"), x.abstract_of_markdown(F.col("md_text")).alias("_t")).where("md_text is not null")
    rows = rows.join(read, "paper_id", "left")
    page, none = F.col("_p").isNotNull(), F.col("_own").isNull()
    outcome = (
        F.when(page & none, "filled").when(page & (F.col("_p") != F.col("_own")), "updated").when(page | ~none | F.col("_file").isNull(), "skipped")
        .when(F.col("_t").isNotNull(), "filled").otherwise("failed")
    )
    written_ = outcome.isin("filled", "updated")
    return rows.select("paper_id", outcome.alias("outcome"), F.when(written_, F.coalesce("_p", "_t")).alias("abstract"), F.when(written_, F.when(page, "page").otherwise("text")).alias("source"))


def backfill_counts(outcomes: DataFrame) -> DataFrame:
    """One row: filled, updated, skipped, failed."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("filled", "updated", "skipped", "failed")])


def pending_summary(pending: DataFrame) -> DataFrame:
    """Items of the review queue by issue."""
    return pending.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def resolved(pending: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that an answer (stem, doi, kind) lets in, items that stay): a DOI
    or a kind that needs none."""
    rows = pending.join(answers.select("stem", F.col("doi").alias("_doi"), F.col("kind").alias("_kind")), "stem", "left")
    fit = F.coalesce(~_blank(F.col("_doi")) | F.col("_kind").isin("thesis", "patent", "book", "document"), F.lit(False))
    taken = rows.where(fit).select("stem", F.coalesce("_doi", F.lit("")).alias("doi"), F.coalesce("_kind", F.lit("")).alias("kind"))
    return taken, rows.where(~fit).select(*pending.columns)


def collected(tables: dict[str, tuple[DataFrame, str]], present: DataFrame) -> dict[str, DataFrame]:
    """Index tables (name: table and its id column) without the rows whose id is
    not in ``present`` (id); links ``target_id`` to what is gone become null."""
    # a merge join: a task holds its partition's ids, never all of them as a broadcast
    ids = present.select(F.col("id").alias("_id")).distinct().hint("merge")
    kept = {name: t.join(ids, t[c] == F.col("_id"), "left_semi") for name, (t, c) in tables.items()}
    for name, t in kept.items():
        if "target_id" in t.columns:
            kept[name] = t.join(ids, t["target_id"] == F.col("_id"), "left").withColumn("target_id", F.col("_id")).drop("_id")
    return kept

"""Scans of record folders, line files, reference managers and feeds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_doi, flipped_name

RECORD_SCHEMA = """id string, title string, authors array<string>, first_author string, first_author_lastname string, year string, doi string, journal string,
abstract string, paper_type string, volume string, issue string, pages string, publisher string, issn string, citation_count map<string,bigint>, ids map<string,string>,
source_file string, extraction_method string, api_sources array<string>, references array<string>, extracted_at string, tags array<string>, l3_conclusion string,
toc array<struct<line:int,level:int,title:string>>, toc_extracted_at string, arxiv_id string, _corrupt string"""

SILO_SCHEMA = "openalex_id string, doi string, title string, abstract string, authors array<string>, year int, cited_by_count bigint, type string"


def _parent() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def _shelved(spark: SparkSession, path: str) -> DataFrame:
    """The records of a shelved folder, each shelf listed and read by a task:
    neither names nor files come to the driver."""
    from .sinks import SHELVES

    def work(numbers):
        # 8 MB of texts or so at a time
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        for part in numbers:
            for shelf in part["id"]:
                names, texts, size = [], [], 0
                for info in store.get_file_info(fs.FileSelector(f"{base}/{shelf:03x}", allow_not_found=True)):
                    file = store.get_file_info(f"{info.path}/meta.json")
                    if not file.is_file:
                        continue
                    with store.open_input_stream(file.path) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                    names.append(info.base_name)
                    size += len(texts[-1])
                    if size > 8 << 20:
                        yield pd.DataFrame({"dir_name": names, "value": texts})
                        names, texts, size = [], [], 0
                yield pd.DataFrame({"dir_name": names, "value": texts}, dtype=object)

    files = spark.range(0, SHELVES, 1, 64).mapInPandas(work, "dir_name string, value string")
    read = files.select("dir_name", "value", F.from_json("value", RECORD_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    # a file without any JSON is read as no record at all
    return read.select("r.*", F.when(F.col("r").isNull(), F.col("value")).alias("_empty"), "dir_name").withColumn("_corrupt", F.coalesce("_corrupt", "_empty")).drop("_empty")


def records(spark: SparkSession, path: str, shelved: bool = False) -> DataFrame:
    """One row per ``*/meta.json``: keys trimmed with '' for absent, the folder's
    name, and ``corrupt`` for a file that is no record. ``references`` entries
    that are objects stay as their JSON text. The files of a plain folder are
    listed by the driver; a library of hundreds of thousands is written and
    read ``shelved`` (``sinks.write_records``), which tasks list."""
    if shelved:
        rows = _shelved(spark, path)
    else:
        raw = spark.read.schema(RECORD_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/*/meta.json")
        rows = raw.select("*", _parent().alias("dir_name"))
    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    blank = ["title", "doi", "journal", "abstract", "paper_type", "volume", "issue", "pages", "publisher", "issn", "arxiv_id", "l3_conclusion"]
    none = F.array().cast("array<string>")
    return rows.select(
        F.coalesce(F.nullif(F.trim("id"), F.lit("")), "dir_name").alias("paper_id"), "dir_name", *[text(c) for c in blank], F.coalesce("year", F.lit("")).alias("year_text"),
        F.expr("try_cast(year AS INT)").alias("year"), F.coalesce("authors", none).alias("authors"), F.coalesce("tags", none).alias("tags"), F.coalesce("references", none).alias("references"),
        "citation_count", "ids", "toc", F.col("_corrupt").isNotNull().alias("corrupt"),
    )


def texts(spark: SparkSession, path: str) -> DataFrame:
    """dir_name, lang ('' for the original) and md_text of paper*.md files."""
    raw = spark.read.text(f"{path}/*/paper*.md", wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return raw.select(_parent().alias("dir_name"), F.regexp_extract(name, r"^paper_([a-z]{2,5})\.md$", 1).alias("lang"), F.col("value").alias("md_text"))


def with_text(rows: DataFrame, text_rows: DataFrame, lang: str = "") -> DataFrame:
    """md_text in a language, else the original, else null."""
    own = text_rows.where("lang = ''").select("dir_name", F.col("md_text").alias("_own"))
    other = text_rows.where(F.col("lang") == lang).select("dir_name", F.col("md_text").alias("_other")) if lang else text_rows.where("false").select("dir_name", F.col("md_text").alias("_other"))
    return rows.join(own, "dir_name", "left").join(other, "dir_name", "left").withColumn("md_text", F.coalesce("_other", "_own")).drop("_own", "_other")


def layer(rows: DataFrame, level: int) -> DataFrame:
    """Header record, abstract, conclusion or whole text."""
    head = ["paper_id", "title", "authors", "year", "journal", "doi", "paper_type", "tags", "citation_count"]
    if level == 1:
        return rows.select(*head)
    return rows.select("paper_id", layer_text(level).alias({2: "abstract", 3: "conclusion"}.get(level, "md_text")))


def layer_text(level: int) -> Column:
    """The text of a layer: title, abstract, conclusion or whole text."""
    if level == 2:
        return F.coalesce(F.nullif("abstract", F.lit("")), F.lit("[No abstract available]"))
    if level == 3:
        return F.nullif("l3_conclusion", F.lit(""))
    return F.col("title" if level == 1 else "md_text")


def proceedings(volumes: DataFrame, children: DataFrame) -> DataFrame:
    """Children with their volume's id and title; no citation counts."""
    own = volumes.select(F.col("id").alias("proceeding_id"), F.col("title").alias("proceeding_title"), "volume_dir")
    return children.join(own, "volume_dir").withColumn("citation_count", F.lit(""))


def silo(spark: SparkSession, path: str) -> DataFrame:
    """Records of a line file, with their order; blank lines are none."""
    return spark.read.schema(SILO_SCHEMA).json(path).withColumn("seq", F.monotonically_increasing_id()).withColumn("id", F.coalesce(F.nullif("doi", F.lit("")), "openalex_id")).where("id is not null")


def silo_map(rows: DataFrame) -> DataFrame:
    """The last record of each id."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


# --- reference managers -------------------------------------------------------

#: Reference types of the managers in library terms (fixed values).
ENDNOTE_TYPES = {"Journal Article": "journal-article", "Conference Paper": "conference-paper", "Conference Proceedings": "conference-paper", "Book": "book", "Book Section": "book-chapter", "Thesis": "thesis", "Report": "report", "Generic": ""}
#: Types whose ISBN field holds an ISSN (fixed values).
SERIAL_TYPES = ["Journal Article", "Conference Paper", "Conference Proceedings"]
ZOTERO_TYPES = {"journalArticle": "journal-article", "conferencePaper": "conference-paper", "thesis": "thesis", "book": "book", "bookSection": "book-chapter", "report": "report", "preprint": "preprint", "document": ""}
RIS_TYPES = {"JOUR": "journal-article", "BOOK": "book", "CHAP": "book-chapter", "CONF": "conference-paper", "CPAPER": "conference-paper", "THES": "thesis", "RPRT": "report", "PAT": "patent"}


def _typed(c: Column, values: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c], other, F.lit(""))


def endnote_type(c: Column) -> Column:
    """Library term of a reference type; one without keeps its name in lower case with dashes."""
    return _typed(c, ENDNOTE_TYPES, F.replace(F.lower(c), F.lit(" "), F.lit("-")))


def zotero_type(c: Column) -> Column:
    return _typed(c, ZOTERO_TYPES, c)


def ris(spark: SparkSession, path: str) -> DataFrame:
    """Records of RIS files, each from TY to ER; repeated tags as arrays."""
    whole = spark.read.text(path, wholetext=True)
    body = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"(?m)^ER  - ?.*$")).alias("nth", "block"))
    pairs = body.where(F.col("block").contains("TY  - ")).select("file", "nth", F.posexplode(F.split("block", r"\r?\n")).alias("line", "raw"))
    tags = pairs.select("file", "nth", "line", F.regexp_extract("raw", r"^([A-Z][A-Z0-9])  - (.*)$", 1).alias("tag"), F.trim(F.regexp_extract("raw", r"^([A-Z][A-Z0-9])  - (.*)$", 2)).alias("v")).where("tag <> ''")
    many = F.sort_array(F.collect_list(F.when(F.col("tag").isin("AU", "A1"), F.struct("line", "v"))))
    one = lambda *t: F.coalesce(*[F.min_by("v", F.when(F.col("tag") == x, F.col("line"))) for x in t], F.lit(""))
    rows = tags.groupBy("file", "nth").agg(
        one("TY").alias("ty"), one("TI", "T1").alias("title"), F.transform(many, lambda x: flipped_name(x["v"])).alias("authors"), one("PY", "Y1", "DA").alias("date"), one("JO", "JF", "T2").alias("journal"),
        one("DO").alias("doi"), one("AB", "N2").alias("abstract"), one("VL").alias("volume"), one("IS").alias("issue"), one("SP").alias("sp"), one("EP").alias("ep"), one("PB").alias("publisher"), one("SN").alias("issn"),
    )
    return rows.select("file", "nth", "title", "authors", F.expr("try_cast(regexp_extract(date, '(1[89][0-9]{2}|20[0-9]{2})', 1) AS INT)").alias("year"), "journal", clean_doi(F.col("doi")).alias("doi"), "abstract", "volume", "issue",
                       F.concat_ws("-", F.nullif("sp", F.lit("")), F.nullif("ep", F.lit(""))).alias("pages"), "publisher", "issn", _typed(F.col("ty"), RIS_TYPES, F.lit("journal-article")).alias("paper_type"))


ENDNOTE_XML = "`ref-type` struct<_name:string>, titles struct<title:string,`secondary-title`:string>, contributors struct<authors:struct<author:array<string>>>, dates struct<year:string>, `electronic-resource-num` string, abstract string, volume string, number string, pages string, publisher string, isbn string, urls struct<`pdf-urls`:struct<url:array<string>>>"


def endnote_xml(spark: SparkSession, path: str) -> DataFrame:
    """Records of EndNote XML exports; a title is '' where there is none, an ISBN is an ISSN for serials only.
    ``pdfs``: addresses of attached files as given, ``file``: the export."""
    raw = spark.read.format("xml").option("rowTag", "record").schema(ENDNOTE_XML).load(path)
    kind = endnote_type(F.col("`ref-type`._name"))
    serial = F.regexp_replace("isbn", r"[^0-9Xx]", "")
    return raw.select(
        F.coalesce(F.trim("titles.title"), F.lit("")).alias("title"), F.transform(F.coalesce("contributors.authors.author", F.array().cast("array<string>")), flipped_name).alias("authors"), F.expr("try_cast(dates.year AS INT)").alias("year"),
        F.trim("titles.secondary-title").alias("journal"), clean_doi(F.coalesce("`electronic-resource-num`", F.lit(""))).alias("doi"), "abstract", "volume", F.col("number").alias("issue"), "pages", "publisher",
        F.when(F.col("`ref-type`._name").isin(SERIAL_TYPES) & (F.length(serial) == 8), F.col("isbn")).otherwise("").alias("issn"), kind.alias("paper_type"),
        F.coalesce("urls.pdf-urls.url", F.array().cast("array<string>")).alias("pdfs"), F.col("_metadata.file_path").alias("file"),
    )


def with_main_pdf(records: DataFrame, files: DataFrame) -> DataFrame:
    """EndNote records (pdfs, file) with ``pdf``, the path of their main file,
    null without one.

    ``internal-pdf://a/b.pdf`` of the export ``x.xml`` is the file
    ``x.Data/PDF/a/b.pdf`` beside it; ``files`` (path, size) is what there is.
    """
    rows = records.withColumn("_key", F.monotonically_increasing_id())
    inside = F.regexp_extract("u", r"(?i)^internal-pdf://(.+)$", 1)
    asked = rows.select("_key", F.regexp_replace("file", r"(?i)\.xml$", "").alias("_stem"), F.explode("pdfs").alias("u")).select("_key", "_stem", F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))).alias("_rel")).where("_rel <> ''")
    found = files.select("path", "size", F.regexp_extract("path", r"^(.*)\.Data/PDF/(.+)$", 1).alias("_stem"), F.regexp_extract("path", r"^(.*)\.Data/PDF/(.+)$", 2).alias("_rel")).where("_rel <> ''")
    best = main_pdf(asked.join(found, ["_stem", "_rel"]).select(F.col("_key").alias("key"), "path", "size"))
    return rows.join(best.select(F.col("key").alias("_key"), F.col("path").alias("pdf")), "_key", "left").drop("_key")


def main_pdf(files: DataFrame) -> DataFrame:
    """Of a record's files (key, path, size) the largest that is no supplement,
    else the largest."""
    extra = F.lower("path").rlike(r"(supp|supplement|appendix|si[_\-. ]|esm)")
    return files.where(F.lower("path").endswith(".pdf")).groupBy("key").agg(F.coalesce(F.max_by("path", F.when(~extra, F.col("size"))), F.max_by("path", "size")).alias("path"))


def zotero(items: DataFrame, item_types: DataFrame, item_data: DataFrame, fields: DataFrame, values: DataFrame, creators: DataFrame, deleted: DataFrame) -> DataFrame:
    """Records out of a Zotero library's tables (exported or over JDBC): typed
    items that are not deleted, their fields turned to columns, authors in order."""
    kept = items.join(item_types, "itemTypeID").where(~F.col("typeName").isin("attachment", "note", "annotation")).join(deleted.select("itemID"), "itemID", "left_anti")
    wide = item_data.join(fields, "fieldID").join(values, "valueID").groupBy("itemID").agg(F.map_from_entries(F.collect_list(F.struct("fieldName", "value"))).alias("f"))
    name = F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "firstName", "lastName")), F.lit("")), F.col("lastName"))
    people = creators.where("creatorType = 'author'").groupBy("itemID").agg(F.transform(F.sort_array(F.collect_list(F.struct("orderIndex", name.alias("name")))), lambda x: x["name"]).alias("authors"))
    get = lambda *names: F.coalesce(*[F.try_element_at("f", F.lit(n)) for n in names], F.lit(""))
    return kept.join(wide, "itemID", "left").join(people, "itemID", "left").select(
        "itemID", get("title").alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.expr("try_cast(nullif(regexp_extract(coalesce(try_element_at(f, 'date'), ''), '(1[89][0-9]{2}|20[0-9]{2})', 1), '') AS INT)").alias("year"),
        get("publicationTitle", "proceedingsTitle", "bookTitle").alias("journal"), clean_doi(get("DOI")).alias("doi"), get("abstractNote").alias("abstract"), get("volume").alias("volume"), get("issue").alias("issue"), get("pages").alias("pages"),
        zotero_type(F.col("typeName")).alias("paper_type"),
    )


def collections(names: DataFrame, members: DataFrame) -> DataFrame:
    """Every collection with its number of items, none included."""
    return names.join(members, "collectionID", "left").groupBy("collectionID", "collectionName").agg(F.count("itemID").alias("n"))


ATOM = "id string, title string, summary string, published string, author array<struct<name:string>>, `arxiv:doi` string, `arxiv:journal_ref` string"


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a preprint server's Atom answers."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return raw.select(
        F.regexp_replace(F.regexp_extract("id", r"abs/(.+)$", 1), r"v\d+$", "").alias("arxiv_id"), squeeze(F.col("title")).alias("title"), squeeze(F.col("summary")).alias("abstract"),
        F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]).alias("authors"), F.expr("try_cast(substr(published, 1, 4) AS INT)").alias("year"),
        F.coalesce("`arxiv:doi`", F.lit("")).alias("doi"), F.coalesce("`arxiv:journal_ref`", F.lit("")).alias("journal"),
    )


def meta_tags(pages: DataFrame, key: str = "url") -> DataFrame:
    """name and content of a page's meta tags, in order."""
    pattern = r'(?i)<meta\s+name="([^"]+)"\s+content="([^"]*)"'
    zipped = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("content"))
    return pages.select(key, F.posexplode(zipped).alias("nth", "m")).select(key, "nth", "m.name", "m.content")


def chunk_plan(files: DataFrame, max_pages: int = 600, max_bytes: int = 200 << 20) -> DataFrame:
    """Pages per chunk and number of chunks of documents over a service's limits."""
    by_size = F.greatest(F.floor(F.lit(max_bytes) / F.greatest(F.col("bytes") / F.greatest("pages", F.lit(1)), F.lit(1))), F.lit(1))
    size = F.when((F.col("pages") > max_pages) | (F.col("bytes") > max_bytes), F.least(F.lit(max_pages), by_size)).otherwise(F.col("pages")).cast("int")
    return files.withColumn("chunk_pages", size).withColumn("chunks", F.ceil(F.col("pages") / F.greatest("chunk_pages", F.lit(1))).cast("int"))


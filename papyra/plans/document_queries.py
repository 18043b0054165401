"""Manual pages, conversions, volumes, workspaces, audits of files and fetches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.places import shared_folder
from ..operators import curate, export, extract, fallback, graph, metadata, proceedings, tooldocs, workspace
from ..sources import catalogue, tool_pages
from ..streaming import events
from .bridge import LIB, lib, registry, table
from .metadata_queries import papers, MD

#: A title's letters and blanks, on one line, of 40 signs; ``Untitled`` for none.
_LETTERS_SQL = "coalesce(nullif(trim(substr(regexp_replace(regexp_replace(title, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'), 1, 40)), ''), 'Untitled')"
NAMED = f"{LIB}, t AS (SELECT paper_id, doc_id AS i, {_LETTERS_SQL} AS name, journal, lang FROM (SELECT l.*, d.lang FROM lib l JOIN documents d ON l.doc_id = d.doc_id))"


def _named(spark, sf_dir):
    plain = F.trim(F.substring(F.regexp_replace(F.regexp_replace("title", "[^A-Za-z ]", ""), " +", " "), 1, 40))
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return lib(spark, sf_dir).join(lang, "doc_id").select("paper_id", F.col("doc_id").alias("i"), F.coalesce(F.nullif(plain, F.lit("")), F.lit("Untitled")).alias("name"), "journal", "lang")


def _with(rows, template: str, **values):
    """``template`` with {i}, {name}, {journal} and further columns filled in."""
    out = F.lit(template)
    for k, v in ({"i": F.col("i").cast("string"), "name": F.col("name"), "journal": F.col("journal")} | values).items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


# --- manual pages -----------------------------------------------------------------

COMMAND = '.. index:: fix {journal}\n.. index:: fix {journal}/gpu\n\nfix {name} command\n====\n\nSyntax\n""""""\n\n.. code-block:: LAMMPS\n\n   fix ID {journal} {i}\n\nDescription\n"""""""""""\n\nAll of {name}.\n\nDefault\n"""""""\n\nnone\n'


def _commands(spark, sf_dir):
    rows = _named(spark, sf_dir)
    return tool_pages.command_pages(rows.select(F.concat(F.when(F.col("i") % 2 == 0, "fix_").otherwise("run_"), F.col("i").cast("string")).alias("stem"), _with(rows, COMMAND).alias("text"))).select("section", "page_name", "title", "default_val", "synopsis", F.contains("content", F.lit("All of ")).alias("described"))


COMMANDS = f"""WITH {NAMED} SELECT CASE WHEN i % 2 = 0 THEN 'fix' ELSE 'other' END AS section, 'lammps/' || CASE WHEN i % 2 = 0 THEN 'fix_' ELSE 'run_' END || i AS page_name, 'fix ' || name || ' command' AS title, 'none' AS default_val,
  'fix ID ' || journal || ' ' || i || ' | Aliases: fix ' || journal AS synopsis, TRUE AS described FROM t"""

OPTIONS = "intro\n\n.. mdp:: opt{i}\n\n   About {name} and :mdp:`dt`.\n\n   .. mdp-value:: md\n\n   .. mdp-value:: {journal}\n\n.. mdp:: dt{i}\n\n   (0) {name}\n"


def _options(spark, sf_dir):
    rows = _named(spark, sf_dir)
    return tool_pages.option_pages(rows.select(F.lit("x").alias("stem"), _with(rows, OPTIONS).alias("text"))).select("page_name", "title", "synopsis", F.md5("content").alias("digest"))


OPTION_ROWS = f"""WITH {NAMED}, o AS (SELECT 'opt' || i AS title, 'MDP parameter | Options: md, ' || journal AS synopsis, 'opt' || i || chr(10) || chr(10) || 'About ' || name || ' and dt.' || chr(10) || chr(10) || '   Option: md' || chr(10) || chr(10) || '   Option: ' || journal AS c FROM t
  UNION ALL SELECT 'dt' || i, 'MDP parameter', 'dt' || i || chr(10) || chr(10) || '(0) ' || name FROM t)
SELECT 'gromacs/mdp/' || title AS page_name, title, synopsis, md5(c) AS digest FROM o"""

DEFINITION = "input_description -distribution {Q} -program pw{i}.x {\n namelist CONTROL {\n  var v{i} -type CHARACTER {\n   default { '{journal}' }\n   options { opt -val 'a' {} opt -val '{journal}' {} }\n   info { What @b {to do} of {name}. }\n  }\n }\n card K_{journal} { {name} }\n}\n"


def _definitions(spark, sf_dir):
    """The table function in SQL."""
    rows = _named(spark, sf_dir)
    tool_pages.register(spark)
    rows.select(F.lit("INPUT_PW").alias("stem"), _with(rows, DEFINITION).alias("text")).createOrReplaceTempView("definition_files")
    return spark.sql("SELECT p.page_name, p.title, p.category, p.var_type, p.synopsis, p.content FROM definition_files, LATERAL definition_pages(stem, text) AS p")


DEFINITIONS = f"""WITH {NAMED} SELECT 'pw' || i || '.x/CONTROL/v' || i AS page_name, 'v' || i AS title, 'variable' AS category, 'CHARACTER' AS var_type, 'Type: CHARACTER; Default: ''' || journal || '''' AS synopsis,
  'Type: CHARACTER; Default: ''' || journal || '''' || chr(10) || chr(10) || 'What to do of ' || name || '.' || chr(10) || chr(10) || 'Options: a, ' || journal AS content FROM t
UNION ALL SELECT 'pw' || i || '.x/card/K_' || journal, 'K_' || journal, 'card', '', 'Input card: K_' || journal, name FROM t"""

MANUAL = '<html><head><title>Man &amp; {i}</title></head><body><div>Toggle navigation</div><h1>Man &amp; {i}</h1><p>Overview</p><p>Use of\n {name}.</p><pre>run &lt;{i}&gt;</pre><ul><li>caf&eacute;</li></ul><h2 id="o{i}">Options</h2><p>first of {journal}</p><h2 id="end">End</h2><p>Copyright of it</p></body></html>'


def _manuals(spark, sf_dir):
    rows = _named(spark, sf_dir)
    i = F.col("i")
    made = rows.select(_with(rows, MANUAL).alias("html"), F.concat(F.lit("man/"), i.cast("string")).alias("page_name"), F.when(i % 3 == 0, F.concat(F.lit("o"), i.cast("string"))).otherwise("").alias("anchor"), F.when(i % 3 == 0, "Options").otherwise("").alias("title"), F.lit("").alias("program"), F.when(i % 3 == 0, "dictionary").otherwise("guide").alias("section"))
    return tool_pages.manifest_pages(made).select("page_name", "title", "category", "synopsis", "content")


MANUALS = f"""WITH {NAMED} SELECT 'man/' || i AS page_name, CASE WHEN i % 3 = 0 THEN 'Options' ELSE 'Man & ' || i END AS title, CASE WHEN i % 3 = 0 THEN 'dictionary' ELSE 'guide' END AS category, CASE WHEN i % 3 = 0 THEN 'first of ' || journal ELSE 'Use of' END AS synopsis,
  CASE WHEN i % 3 = 0 THEN 'Options' || chr(10) || 'first of ' || journal ELSE 'Man & ' || i || chr(10) || 'Overview' || chr(10) || 'Use of' || chr(10) || name || '.' || chr(10) || chr(10) || 'run <' || i || '>' || chr(10) || chr(10) || '- café' || chr(10) || chr(10) || 'Options' || chr(10) || 'first of ' || journal || chr(10) || 'End' END AS content FROM t"""


# --- conversion -------------------------------------------------------------------


def _first(content: bytes) -> str:
    """Takes files that begin with an A to M."""
    text = content.decode("ascii")
    if not "A" <= text[:1].upper() <= "M":
        raise ValueError("not mine")
    return f"first {text}"


def _second(content: bytes) -> str | None:
    return f"second {content.decode('ascii')}" if len(content) % 2 else None


def _conversion(spark, sf_dir):
    made = _named(spark, sf_dir).select(F.col("paper_id").alias("path"), F.when(F.col("i") % 11 > 0, F.col("name").cast("binary")).alias("content"))
    return fallback.converted(made, {"first": _first, "second": _second}, ["First", "auto", "third"])


CONVERSION = f"""WITH {NAMED}, c AS (SELECT paper_id AS path, CASE WHEN i % 11 > 0 THEN name END AS n FROM t), a AS (SELECT *, upper(n[1]) BETWEEN 'A' AND 'M' AS one, length(n) % 2 = 1 AS two FROM c)
SELECT path, CASE WHEN one THEN 'first' WHEN two THEN 'second' END AS parser, CASE WHEN one THEN 'first ' || n WHEN two THEN 'second ' || n END AS text,
  CASE WHEN n IS NULL THEN 'first: no content | second: no content | third: unknown' WHEN NOT one AND NOT two THEN 'first: ValueError: not mine | second: no text | third: unknown' END AS error FROM a"""


# --- fetches and streams ----------------------------------------------------------


def _recorded(rows, spark):
    """The rows (i, name) as recorded catalogue pages of 50 works."""
    folder = shared_folder(spark, "catalogue")
    words = F.array_distinct(F.split("name", " "))
    inverted = F.map_from_arrays(words, F.transform(words, lambda w, k: F.array(k)))
    id_ = F.col("i").cast("string")
    work = F.struct(F.concat(F.lit("W"), id_).alias("id"), F.concat(F.lit("<i>On</i> "), "name").alias("title"), F.concat(F.lit("https://doi.org/10.1/"), id_).alias("doi"), (F.lit(1990) + F.col("i") % 30).alias("publication_year"), F.lit("article").alias("type"), inverted.alias("abstract_inverted_index"))
    page = F.floor(F.col("i") / 50).cast("int")
    pages = rows.groupBy(page.alias("p")).agg(F.array_sort(F.collect_list(F.struct("i", F.to_json(work).alias("w")))).alias("ws"))
    following = pages.select((F.col("p") - 1).alias("p"), F.lit(True).alias("more"))
    cursor = lambda p: F.when(p == 0, "*").otherwise(F.concat(F.lit("c"), p.cast("string")))
    meta = F.struct(F.when(F.col("more"), cursor(F.col("p") + 1)).alias("next_cursor"))
    made = pages.join(following, "p", "left").select(cursor(F.col("p")).alias("cursor"), F.concat(F.lit('{"results": ['), F.array_join(F.transform("ws", lambda x: x["w"]), ","), F.lit('], "meta": '), F.to_json(meta), F.lit("}")).alias("value"))
    # a folder a page: with a number of partitions given, small pages are not gathered in one task
    made.repartition(4 * spark.sparkContext.defaultParallelism, "cursor").write.partitionBy("cursor").text(folder)
    return folder


def _fetched(spark, sf_dir):
    """A fetch that is interrupted and goes on, then one that adds what is new."""
    rows = _named(spark, sf_dir)
    silo = shared_folder(spark, "silo")
    pages = _recorded(rows.withColumn("name", F.concat(F.lit("old "), "name")), spark)
    catalogue.fetch_into(spark, pages, silo, "first", limit=70, pages_per_batch=1, batches=1)
    catalogue.fetch_into(spark, pages, silo, "first", limit=70, pages_per_batch=1)
    catalogue.fetch_into(spark, _recorded(rows, spark), silo, "second", incremental=True)
    return catalogue.silo(spark, silo).select("openalex_id", "doi", "title", "abstract", "year", "type")


FETCHED = f"""WITH {NAMED}, n AS (SELECT i, CASE WHEN i < 70 THEN 'old ' || name ELSE name END AS name FROM t), w AS (SELECT *, string_split(name, ' ') AS ws FROM n)
SELECT 'W' || i AS openalex_id, '10.1/' || i AS doi, 'On ' || name AS title, array_to_string([x FOR x, k IN ws IF NOT list_contains(ws[1:k - 1], x)], ' ') AS abstract, CAST(1990 + i % 30 AS INT) AS year, 'article' AS type FROM w"""


def _event_stream(spark, sf_dir):
    found = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(found.schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"), F.col("user_id").alias("user"))


def _drained(stream, out, mode):
    """A stream run to its end into ``out/rows``, a folder a batch."""
    write = lambda b, e: b.write.mode("overwrite").parquet(f"{out}/rows/{e}")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("recursiveFileLookup", True).schema(stream.schema).parquet(f"{out}/rows")


def _weeks(spark, sf_dir):
    """Weeks that are closed when the stream ends."""
    rows = _drained(events.weekly_counts(_event_stream(spark, sf_dir)), shared_folder(spark, "weeks"), "append")
    return rows.select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "category", "n")


def _newest_of_users(spark, sf_dir):
    events.with_state_store(spark)
    rows = _drained(events.newest_rows(_event_stream(spark, sf_dir), "user"), shared_folder(spark, "newest"), "update")
    return rows.groupBy("key").agg(F.max(F.struct("ts", "seq")).alias("m")).select("key", F.col("m.seq").alias("seq"))


# --- volumes ----------------------------------------------------------------------

VOLUME = "# Editors\n\n# {journal} Proceedings of {name}\n\n# Contents\n\nPaper on {name} 1 A. Author\n\nSecond\npaper {i} B. Writer\n\nAuthor Index 20\n\n# Paper on {name}\n\nA. Author\nB. Lab\n\nAbstract. We do\n{name}.\n\n## 1 Intro\n"


def _volumes(spark, sf_dir):
    rows = _named(spark, sf_dir)
    made = rows.select("paper_id", _with(rows, VOLUME).alias("t"))
    return made.select("paper_id", proceedings.volume_title(F.col("t"), F.lit("x")).alias("volume"), F.array_join(proceedings.contents_titles(F.col("t")), "|").alias("titles"), F.array_join(proceedings.opening_lines(F.col("t"), 2), "|").alias("opening"), F.array_join(proceedings.closing_lines(F.col("t"), 2), "|").alias("closing"))


VOLUMES = f"""WITH {NAMED} SELECT paper_id, journal || ' Proceedings of ' || name AS volume, 'Paper on ' || name || '|Second paper' AS titles, '# Editors|# ' || journal || ' Proceedings of ' || name AS opening, name || '.|## 1 Intro' AS closing FROM t"""


def _split(spark, sf_dir):
    """Volumes cut by a plan, and what each part says first."""
    rows = _named(spark, sf_dir)
    volumes = rows.select(F.col("paper_id").alias("volume_id"), _with(rows, VOLUME).alias("md_text"))
    plan = rows.select(F.col("paper_id").alias("volume_id"), F.explode(F.array(F.struct(F.lit("front").alias("title"), F.lit(1).alias("start_line"), F.lit(4).alias("end_line")), F.struct(F.col("name").alias("title"), F.lit(14).alias("start_line"), F.lit(22).alias("end_line")))).alias("p")).select("volume_id", "p.*")
    parts = extract.split_by_plan(volumes, plan)
    return parts.withColumn("f", proceedings.chunk_front("md_text")).select("volume_id", "title", F.size(F.split("md_text", "\n")).alias("lines"), F.array_join("f.authors", "|").alias("authors"), F.col("f.abstract").alias("abstract"))


SPLIT = f"""WITH {NAMED} SELECT paper_id AS volume_id, 'front' AS title, 4::INT AS lines, '' AS authors, '' AS abstract FROM t UNION ALL SELECT paper_id, name, 9::INT, 'A. Author|B. Lab', 'We do' || chr(10) || name || '.' FROM t"""


def _children(spark, sf_dir):
    rows = _named(spark, sf_dir)
    i = F.col("i")
    title = F.when(i % 4 == 0, F.concat(F.lit("Discussion of "), "name")).otherwise(F.col("name"))
    text = F.concat(F.lit("# "), title, F.when(i % 3 == 0, F.lit("\nComment by Y")).otherwise(F.lit("\nBy Y")), F.when(i % 5 == 0, F.lit("\nReporter: Z")).otherwise(F.lit("")), F.lit("\n# Junk Part\nend"))
    return rows.select("paper_id", "i", title.alias("title"), F.when(i % 2 == 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>")).alias("authors"), F.when(i % 6 > 0, "abs").alias("abstract"), F.lit("10.1/x").alias("doi"), text.alias("md_text"))


SIGNALS = f"""WITH {NAMED} SELECT paper_id, array_to_string([x FOR x IN [CASE WHEN i % 2 = 1 THEN 'missing_authors' END, CASE WHEN i % 6 = 0 THEN 'missing_abstract' END, CASE WHEN i % 4 = 0 THEN 'discussion_title' END, CASE WHEN i % 3 = 0 THEN 'comment_label' END, CASE WHEN i % 5 = 0 THEN 'reporter_line' END] IF x IS NOT NULL], ',') AS signals FROM t"""


def _cleaned(spark, sf_dir):
    rows = _children(spark, sf_dir)
    i = F.col("i")
    plan = rows.where(i % 7 < 3).select("paper_id", F.when(i % 7 == 0, "drop").when(i % 7 == 1, "rename").otherwise("keep").alias("action"), F.when(i % 2 == 0, F.concat(F.lit("New "), i.cast("string"))).alias("title"), F.array(F.lit("junk part")).alias("headings"))
    return proceedings.cleaned(rows, plan).select("paper_id", "title", F.contains("md_text", F.lit("# Junk")).alias("junk"))


CLEANED = f"""WITH {NAMED} SELECT paper_id, CASE WHEN i % 7 = 1 AND i % 2 = 0 THEN 'New ' || i WHEN i % 4 = 0 THEN 'Discussion of ' || name ELSE name END AS title, i % 7 > 2 AS junk FROM t WHERE i % 7 <> 0"""


# --- workspaces -------------------------------------------------------------------


def _members(spark, sf_dir):
    reg = registry(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    n = F.col("id").try_cast("long")
    old = reg.where(n % 5 == 0).select(F.lit("w").alias("ws"), "id", F.concat(F.lit("old-"), "dir_name").alias("dir_name"), F.lit("t0").alias("added_at"))
    other = reg.where(n % 11 == 0).select(F.lit("v").alias("ws"), "id", "dir_name", F.lit("t0").alias("added_at"))
    refs = reg.select(F.when(n % 4 == 0, F.col("id")).when(n % 4 == 1, F.col("dir_name")).when(n % 4 == 2, F.upper("doi")).otherwise(F.concat(F.lit("nope"), "id")).alias("ref"))
    return reg, old.union(other), refs


def _ws_added(spark, sf_dir):
    reg, members, refs = _members(spark, sf_dir)
    rows, missing = workspace.added(members, "w", refs, reg, "t1")
    return rows.select("ws", "id", "added_at").union(missing.select(F.lit("missing"), "ref", F.lit("")))


WS_ADDED = """WITH r AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey % 3 <> 0)
SELECT 'w' AS ws, CAST(n AS VARCHAR) AS id, CASE WHEN n % 5 = 0 THEN 't0' ELSE 't1' END AS added_at FROM r WHERE n % 5 = 0 OR n % 4 <> 3 UNION ALL SELECT 'v', CAST(n AS VARCHAR), 't0' FROM r WHERE n % 11 = 0 UNION ALL SELECT 'missing', 'nope' || n, '' FROM r WHERE n % 4 = 3"""


def _ws_removed(spark, sf_dir):
    reg, members, refs = _members(spark, sf_dir)
    n = F.col("id").try_cast("long")
    shown = members.where("ws = 'w'").where((n % 4 == 3) & (n % 7 == 0)).select(F.col("dir_name").alias("ref"))
    return workspace.removed(members, "w", refs.union(shown), reg).select("ws", "id", "dir_name")


WS_REMOVED = """WITH r AS (SELECT o_orderkey AS n, 'D' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS d FROM orders WHERE o_orderkey % 3 <> 0)
SELECT 'w' AS ws, CAST(n AS VARCHAR) AS id, 'old-' || d AS dir_name FROM r WHERE n % 5 = 0 AND n % 4 = 3 AND n % 7 <> 0 UNION ALL SELECT 'v', CAST(n AS VARCHAR), d FROM r WHERE n % 11 = 0"""


# --- audits, names, styles, references ------------------------------------------------


def _file_audit(spark, sf_dir):
    """Records whose files and names are at fault."""
    rows = _named(spark, sf_dir)
    i = F.col("i")
    made = rows.select(
        "paper_id", F.when(i % 4 == 0, "plain-name").otherwise("Roe-2020-T").alias("dir_name"), "name", F.concat(F.lit("Alpha beta gamma "), "name").alias("title"), F.when(i % 3 == 0, F.concat(F.lit("10.48550/arXiv."), i.cast("string"))).otherwise(F.concat(F.lit("10.1/"), i.cast("string"))).alias("doi"),
        F.lit("review").alias("paper_type"), F.lit("a").alias("abstract"), F.lit("2020").alias("year_text"), F.lit("A").alias("authors"), F.lit("J").alias("journal"), F.when(i % 6 == 0, F.concat(F.lit("2001."), i.cast("string"))).otherwise("").alias("arxiv_id"),
        F.array("lang").alias("tags"), F.when(i % 9 > 0, F.concat(F.lit("# "), F.when(i % 5 == 0, F.lit("Something else entirely here")).otherwise(F.concat(F.lit("Alpha beta gamma "), "name")), F.lit("\n"), F.repeat(F.lit("word "), 60))).alias("md_text"),
        (i % 13 == 0).alias("corrupt"), (i % 9 == 0).alias("unreadable"),
    )
    return curate.audit(made.drop("name")).select("paper_id", "severity", "rule")


_ALIKE = "len(list_intersect(aw, ['something', 'else', 'entirely', 'here'])) * 1.0e0 / len(aw) < 0.3"
FILE_AUDIT = f"""WITH {NAMED}, a AS (SELECT *, list_distinct(regexp_extract_all(lower('Alpha beta gamma ' || name), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{4,}}')) AS aw FROM t),
r AS (SELECT paper_id, unnest([x FOR x IN [CASE WHEN i % 13 = 0 THEN 'error:invalid_json' END, CASE WHEN i % 13 > 0 AND i % 9 = 0 THEN 'error:unreadable_md' END, CASE WHEN i % 13 > 0 AND i % 3 = 0 AND i % 6 > 0 THEN 'warning:arxiv_id_missing' END,
  CASE WHEN i % 13 > 0 AND i % 9 > 0 AND i % 5 = 0 AND {_ALIKE} THEN 'warning:title_mismatch' END, CASE WHEN i % 13 > 0 AND i % 4 = 0 THEN 'info:nonstandard_filename' END] IF x IS NOT NULL]) AS x FROM a)
SELECT paper_id, split_part(x, ':', 1) AS severity, split_part(x, ':', 2) AS rule FROM r"""


def _file_names(spark, sf_dir):
    made = lib(spark, sf_dir).select("paper_id", extract.file_name(F.regexp_replace(F.concat(F.lit(" a/b:"), F.regexp_replace("title", "[^ -~]", "")), " ", "-")).alias("name"))
    return made


FILE_NAMES = f"""WITH {LIB}, c AS (SELECT paper_id, regexp_replace(regexp_replace(replace(' a/b:' || regexp_replace(title, '[^ -~]', '', 'g'), ' ', '-'), '[<>:"/\\\\|?*]+', '', 'g'), '^[ .]+|[ .]+$', '', 'g') AS n FROM lib), h AS (SELECT *, substr(n, 1, 120) AS s FROM c)
SELECT paper_id, CASE WHEN length(n) <= 120 THEN n WHEN contains(substr(s, 61), '-') THEN regexp_replace(regexp_replace(s, '-[^-]*$', ''), '[-. ]+$', '') ELSE regexp_replace(s, '[-. ]+$', '') END AS name FROM h"""


def _house(meta: dict, n: int) -> str:
    return f"[{n}] {meta['title']} ({meta['year_text'] or 'n.d.'})"


def _styled(spark, sf_dir):
    export.register_style("house", _house)
    return export.reference_list(_named(spark, sf_dir).join(lib(spark, sf_dir).select("paper_id", "year_text"), "paper_id").select("paper_id", F.concat("name", F.lit(" "), F.col("i").cast("string")).alias("title"), "year_text"), "house")


STYLED = f"""WITH {NAMED}, r AS (SELECT t.paper_id, name || ' ' || i AS title, year_text FROM t JOIN lib ON lib.paper_id = t.paper_id), n AS (SELECT *, CAST(row_number() OVER (ORDER BY coalesce(TRY_CAST(year_text AS INT), 0) DESC, title, paper_id) AS INT) AS nth FROM r)
SELECT paper_id, nth, '[' || nth || '] ' || title || ' (' || CASE WHEN year_text <> '' THEN year_text ELSE 'n.d.' END || ')' AS ref FROM n"""


def _references(spark, sf_dir):
    rows = _named(spark, sf_dir)
    raw = F.array(*[_with(rows, x) for x in ("10.1/A{i}", ' {"doi": "10.2/{i}"} ', '{"externalIds": {"DOI": "10.3/{journal}"}}', '{"title": "{name}"}', "", "10.1/a{i}")], F.lit(None))
    return rows.select("paper_id", F.explode(graph.reference_dois(raw)).alias("doi"))


REFERENCES = f"WITH {NAMED} SELECT paper_id, unnest(['10.1/a' || i, '10.2/' || i, '10.3/' || lower(journal)]) AS doi FROM t"


def _titles(spark, sf_dir):
    """Titles and authors of papers with name headings around their title."""
    rows = _named(spark, sf_dir)
    text = F.when(F.col("i") % 3 == 0, _with(rows, "# Abstract\n# Jane Roe\n# A long account of all that is {name}\n\nDepartment of it\n")).when(F.col("i") % 3 == 1, _with(rows, "# Study {i} of it\n\nReceived 3 May\nAda {journal}x, B. C. Lee<sup>2</sup>; By Max Doe*\n\n## 1 Intro")).otherwise(_with(rows, "{name} without a heading"))
    return rows.select("paper_id", extract.front_matter(text).alias("f")).select("paper_id", "f.title", F.array_join("f.authors", "|").alias("authors"))


TITLES = f"""WITH {NAMED} SELECT paper_id, CASE i % 3 WHEN 0 THEN 'A long account of all that is ' || name WHEN 1 THEN 'Study ' || i || ' of it' ELSE '' END AS title, CASE i % 3 WHEN 0 THEN 'Jane Roe' WHEN 1 THEN 'Ada ' || journal || 'x|B. C. Lee|Max Doe' ELSE '' END AS authors FROM t"""


def _outline(spark, sf_dir):
    return extract.outline(papers(spark, sf_dir).withColumn("md_text", F.substring_index("md_text", "\n", 14))).select("paper_id", "line", "level", "title", F.size("preview").alias("following"))


OUTLINE = f"""WITH {MD}, ln AS (SELECT paper_id, unnest(string_split(md_text, chr(10))[1:14]) AS raw, unnest(range(1, least(14, len(string_split(md_text, chr(10)))) + 1)) AS line FROM md),
w AS (SELECT *, count(CASE WHEN trim(raw) <> '' THEN 1 END) OVER (PARTITION BY paper_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS n FROM ln)
SELECT paper_id, CAST(line AS INT) AS line, CAST(length(regexp_extract(raw, '^(#+)', 1)) AS INT) AS level, trim(regexp_extract(raw, '^#+\\s+(.*)$', 1)) AS title, CAST(n AS INT) AS following FROM w WHERE regexp_matches(raw, '^#{{1,6}}\\s+\\S')"""


QUERIES = {
    "tool_pages_commands": (_commands, COMMANDS),
    "tool_pages_options": (_options, OPTION_ROWS),
    "tool_pages_definitions": (_definitions, DEFINITIONS),
    "tool_pages_manuals": (_manuals, MANUALS),
    "conversion_fallback": (_conversion, CONVERSION),
    "catalogue_fetch": (_fetched, FETCHED),
    "stream_weekly_counts": (_weeks, "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type AS category, count(*) AS n FROM events WHERE date_trunc('week', ts) + INTERVAL 14 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2"),
    "stream_newest_of_users": (_newest_of_users, "SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS seq FROM events WHERE user_id IS NOT NULL GROUP BY 1"),
    "volume_contents": (_volumes, VOLUMES),
    "volume_split": (_split, SPLIT),
    "volume_signals": (lambda s, d: proceedings.signals(_children(s, d)).select("paper_id", F.array_join("signals", ",").alias("signals")), SIGNALS),
    "volume_cleaned": (_cleaned, CLEANED),
    "workspace_add": (_ws_added, WS_ADDED),
    "workspace_remove": (_ws_removed, WS_REMOVED),
    "workspace_names": (lambda s, d: workspace.names(_members(s, d)[1]), "SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'w' ELSE 'v' END AS ws FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 11 = 0)"),
    "audit_file_issues": (_file_audit, FILE_AUDIT),
    "file_names": (_file_names, FILE_NAMES),
    "refs_custom_style": (_styled, STYLED),
    "reference_dois": (_references, REFERENCES),
    "titles_and_authors": (_titles, TITLES),
    "heading_outline": (_outline, OUTLINE),
}

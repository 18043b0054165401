"""Documentation files as pages: reStructuredText and variable definitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.text import alias_phrase
from ..operators.extract import anchor_fragment, page_text, unescaped
from ..operators.tooldocs import cleaned_page, page_synopsis

PAGE = "program string, section string, page_name string, title string, category string, var_type string, default_val string, synopsis string, content string"
#: Command families by the prefix of a file's name, and variants left out (fixed values).
FAMILIES = "fix|compute|pair|bond|angle|dihedral|improper|dump|region|group"
VARIANTS = r"/(gpu|intel|kk|omp|opt)\b"


def files(spark, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _section(text: Column, name: str) -> Column:
    """Body under an underlined (quote marks) section title."""
    return _bare(F.regexp_extract(text, rf'(?is)(?:^|\n){name}[^\n]*\n"{{3,}}[^\n]*\n(.*?)(?=\n[^\n]+\n"{{3,}}|\z)', 1))


def command_pages(rows: DataFrame) -> DataFrame:
    """One page per command file, with its aliases as searchable keys."""
    t = F.col("text")
    names = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"\.\.\s+index::\s+([^\n]+)"), F.lit(1)), lambda c: F.trim(c)), lambda c: ~c.rlike(VARIANTS))
    alias = F.array_distinct(F.transform(names, alias_phrase))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract(t, r"(?m)^(.+?)\n={3,}", 1)), F.lit("")), F.col("stem"))
    kind = F.coalesce(F.nullif(F.regexp_extract("stem", rf"^({FAMILIES})_", 1), F.lit("")), F.lit("other"))
    syntax, default = _section(t, "Syntax"), _section(t, "Default")
    line = F.trim(F.regexp_extract(syntax, r"code-block::\s+\w+\s*\n\s*\n\s+([^\n]+)", 1))
    known = F.when(F.size(alias) > 0, F.concat(F.lit("Aliases: "), F.array_join(F.slice(alias, 1, 12), ", ")))
    part = lambda label, c, n: F.when(c != "", F.concat(F.lit(label + ":\n"), F.substring(c, 1, n)))
    keys = F.when(F.size(alias) > 0, F.concat(F.lit("Alias keys: "), F.array_join(F.transform(F.slice(alias, 1, 20), lambda a: F.concat(F.lit("|"), a, F.lit("|"))), " ")))
    body = F.array_compact(F.array(keys, part("Syntax", syntax, 1000), part("Description", _section(t, "Description"), 3000), part("Restrictions", _section(t, "Restrictions"), 500), part("Default", default, 300)))
    content = F.when(F.size(body) > 0, F.array_join(body, "\n\n")).otherwise(F.substring(t, 1, 2000))
    return rows.select(F.lit("lammps").alias("program"), kind.alias("section"), F.concat(F.lit("lammps/"), "stem").alias("page_name"), title.alias("title"), kind.alias("category"), F.lit("").alias("var_type"),
                       F.substring(default, 1, 200).alias("default_val"), F.concat_ws(" | ", F.nullif(line, F.lit("")), known).alias("synopsis"), content.alias("content"))


def option_pages(rows: DataFrame) -> DataFrame:
    """One page per option of a run-parameter reference."""
    blocks = F.split("text", r"(?m)^\.\.\s+mdp::\s+")
    each = rows.select(F.explode(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("b"))
    name, body = F.regexp_extract("b", r"^(\S+)", 1), _bare(F.regexp_replace("b", r"^\S+", ""))
    values = F.regexp_extract_all(body, F.lit(r"(?m)^\s*\.\.\s+mdp-value::\s+(.+?)\s*$"), F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(body, r"\.\.\s+mdp-value::\s+", "Option: "), r":mdp(-value)?:`([^`]+)`", "$2")
    synopsis = F.when(F.size(values) > 0, F.concat(F.lit("MDP parameter | Options: "), F.array_join(F.slice(values, 1, 8), ", "))).otherwise("MDP parameter")
    return each.select(F.lit("gromacs").alias("program"), F.lit("mdp").alias("section"), F.concat(F.lit("gromacs/mdp/"), name).alias("page_name"), name.alias("title"), F.lit("mdp").alias("category"), F.lit("").alias("var_type"), F.lit("").alias("default_val"),
                       synopsis.alias("synopsis"), F.concat(name, F.lit("\n\n"), F.substring(_bare(plain), 1, 3000)).alias("content"))


def _tree(text: str) -> list:
    """Definition text as nested (head, children or text) pairs by its braces."""
    out: list = []
    stack, head, at = [out], "", 0
    for i, ch in enumerate(text):
        if ch == "{":
            head = text[at:i].strip()
            node: list = [head, [], ""]
            stack[-1].append(node)
            stack.append(node[1])
            at = i + 1
            node[2] = i + 1
        elif ch == "}" and len(stack) > 1:
            stack.pop()
            node = stack[-1][-1]
            node[2] = text[node[2] : i]
            at = i + 1
    return out


def _plain_definition(t: str) -> str:
    t = re.sub(r"@(?:b|i|tt)\s*\{([^}]*)\}|@ref\s+(\w+)", lambda m: m[1] or m[2] or "", t)
    return "\n".join(x.strip() for x in re.sub(r"@\w+\s*", "", t.replace("@br", "\n")).strip().split("\n"))


def _variable(program: str, section: str, name: str, head: str, node: list, category: str) -> tuple:
    own = {h.split()[-1] if h else "": (_plain_definition(raw), kids) for h, kids, raw in node[1]}
    kind = (re.search(r"-type\s+(\S+)", head) or [None, ""])[1]
    text = lambda k: own.get(k, ("", []))[0]
    synopsis = "; ".join(f"{label}: {v}" for label, v in (("Type", kind), ("Default", text("default")), ("Status", text("status"))) if v)
    options = [m[1] for h, _, _ in own.get("options", ("", []))[1] if (m := re.search(r"-val\s+'([^']+)'", h))]
    parts = [synopsis, text("info"), "Options: " + ", ".join(options) if options else ""]
    return (program, section, "/".join(x for x in (program, section, name) if x), name, category, kind, text("default"), synopsis, "\n\n".join(p for p in parts if p) or f"{name}: {kind}")


def _walked(program: str, nodes: list, section: str) -> list[tuple]:
    found: list[tuple] = []
    for head, kids, raw in nodes:
        last = head.split("\n")[-1].strip()
        if m := re.search(r"\bnamelist\s+(\w+)$", last):
            found += _walked(program, kids, m[1])
        elif m := re.search(r"\bcard\s+(\w+)", last):
            found.append((program, "card", f"{program}/card/{m[1]}", m[1], "card", "", "", f"Input card: {m[1]}", _plain_definition(raw)[:4000]))
        elif re.search(r"\bvargroup\b", last):
            found += [_variable(program, section, n, last, [head, kids, raw], "vargroup") for n in re.findall(r"\bvar\s+(\w+)", raw)]
        elif m := re.search(r"\b(var|dimension)\s+([\w()]+)", last):
            found.append(_variable(program, section, m[2], last, [head, kids, raw], "variable" if m[1] == "var" else "dimension"))
        else:
            found += _walked(program, kids, section)
    return found


class DefinitionPages:
    """Table function: one row per variable or card of a brace-structured
    definition file, of its name and text; none for a null text.

    In SQL, once :func:`register` was called::

        SELECT p.* FROM files, LATERAL definition_pages(stem, text) AS p
    """

    @staticmethod
    def analyze(stem: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        for name, given in (("stem", stem), ("text", text)):
            if not isinstance(given.dataType, (T.StringType, T.NullType)):
                raise ValueError(f"{name} must be a string, not {given.dataType.simpleString()}")
        return AnalyzeResult(T.StructType([T.StructField(c.split()[0], T.StringType()) for c in PAGE.split(", ")]))

    def eval(self, stem: str, text: str):
        if text is not None:
            named = re.search(r"-program\s+\{?\s*([^\s}]+)", text)
            yield from _walked(named[1] if named else (stem or "").replace("INPUT_", "").lower(), _tree(text), "")


def register(spark) -> None:
    spark.udtf.register("definition_pages", udtf(DefinitionPages))


def definition_pages(rows: DataFrame) -> DataFrame:
    """:class:`DefinitionPages` of all files (stem, text)."""
    return rows.select("stem", "text").lateralJoin(udtf(DefinitionPages)(F.col("stem").outer(), F.col("text").outer())).select([c.split()[0] for c in PAGE.split(", ")])


def manifest_pages(rows: DataFrame) -> DataFrame:
    """One page per recorded web page of a manual (html, page_name; optional
    title, anchor, program, section), its text from the title on and without
    the site's own lines; of a page with an anchor the part under it."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    r = rows.select(F.coalesce("html", F.lit("")).alias("_h"), "page_name", given("title").alias("_t"), given("anchor").alias("_a"), given("program").alias("program"), given("section").alias("section"))
    r = r.withColumn("_h", F.when(F.col("_a") != "", anchor_fragment(F.col("_h"), F.col("_a"))).otherwise(F.col("_h")))
    named = F.trim(unescaped(F.regexp_extract("_h", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    r = r.withColumn("_n", named).withColumn("title", F.when(F.col("_t") != "", F.col("_t")).when(F.col("_n") != "", F.col("_n")).otherwise(F.col("page_name")))
    r = r.withColumn("_p", page_text(F.col("_h"))).withColumn("text", cleaned_page(F.col("_p"), F.col("title"), F.col("program")))
    r = r.withColumn("_s", page_synopsis(F.col("text"), F.col("title")))
    bare = (F.col("section") == "dictionary") & ((F.col("_s") == "") | F.startswith("_s", F.lit("/*")) | F.startswith("_s", F.lit("FoamFile")))
    synopsis = F.when(bare, F.concat("title", F.lit(" dictionary"))).otherwise(F.col("_s"))
    return r.select("program", "section", "page_name", "title", F.col("section").alias("category"), F.lit("").alias("var_type"), F.lit("").alias("default_val"), synopsis.alias("synopsis"), F.substring("text", 1, 5000).alias("content"))

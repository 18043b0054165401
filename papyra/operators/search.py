"""Field-weighted BM25 over an inverted index, and the other ways to look up."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.guards import sanitized_query, year_range
from ..functions.text import fold
from .substring import GramIndex

#: Field weights of the library, of silos and of proceedings (fixed values).
LIBRARY_WEIGHTS = {"title": 10.0, "tags": 8.0, "authors": 5.0, "journal": 3.0, "abstract": 2.0, "conclusion": 1.5, "year": 0.5}
SILO_WEIGHTS = {"title": 10.0, "authors": 5.0, "abstract": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


#: Words whose postings a task of :meth:`SearchIndex.write` sorts, in memory: its Python worker took 351 MB;
#: a task that has twice as many sorts them in several runs.
TASK_WORDS = 3_000_000


@dataclass
class SearchIndex:
    """``postings``: term, id, field, tf, places; ``lengths``: id, size.

    Both are derived once for a library; weights come with the query. Stored,
    files of postings are runs sorted by term, so a query reads the pages of
    its terms only. ``stats``: number and mean size of the records, where they are
    known. ``dealt``: the postings out of a number of tasks.
    """

    postings: DataFrame
    lengths: DataFrame
    stats: tuple[int, float] | None = None
    dealt: Callable[[int], DataFrame] | None = None

    def write(self, path: str) -> None:
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        words = self.postings.sparkSession.read.parquet(f"{path}/lengths").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self.write_postings(path, words)

    def write_postings(self, path: str, words: int) -> None:
        """A record's postings never cross the network: its text does, to a
        task that has few enough of all ``words`` to sort them in memory."""
        if self.dealt:
            few = min(self.postings.sparkSession.sparkContext.defaultParallelism, words // 10_000)
            sorted_runs = self.dealt(max(few, words // TASK_WORDS) + 1)
        else:
            sorted_runs = self.postings.sortWithinPartitions("term")
        sorted_runs.write.mode("overwrite").parquet(f"{path}/postings")

    @staticmethod
    def read(spark, path: str) -> SearchIndex:
        return SearchIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    def of_terms(self, terms: list[str]) -> DataFrame:
        return self.postings.where(F.col("term").isin(terms))


def words_only(texts: dict[str, Column]) -> list[Column]:
    """The words of each text with a blank between, null for none: what is folded
    and split once stays so."""
    return [F.nullif(F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit("")).alias(f) for f, c in texts.items()]


def size_of_words(fields: list[str]) -> Column:
    """Number of words of all fields of :func:`words_only`."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.length(f) - F.length(F.replace(F.col(f), F.lit(" "))) + 1, F.lit(0)) for f in fields])


def _postings(rows: DataFrame, fields: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """Postings of ``rows`` (id, _size and the words of each field, whose columns
    ``fields`` name), sorted by term within runs of a task's rows, which are sorted
    and counted as Arrow columns."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = ["id", *keep]
    most = 2 * TASK_WORDS

    def run(held):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found, row, field, place, base = [], [], [], [], 0
        for b in held:
            for k, f in enumerate(fields):
                lists = pc.split_pattern(b.column(f), " ")
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                found.append(pc.list_flatten(lists))
                row.append(np.repeat(np.arange(base, base + b.num_rows, dtype=np.int32), n))
                field.append(np.full(len(row[-1]), k, np.int8))
                place.append((np.arange(len(row[-1])) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))
            base += b.num_rows
        coded = pa.concat_arrays(found).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        term = rank[coded.indices.to_numpy()]
        by_term = np.argsort(term, kind="stable")
        term, row, field, place = (x[by_term] for x in (term, np.concatenate(row), np.concatenate(field), np.concatenate(place)))
        first = np.flatnonzero(np.concatenate([[len(term) > 0], (term[1:] != term[:-1]) | (row[1:] != row[:-1]) | (field[1:] != field[:-1])]))
        ends = np.append(first, len(term))
        names, table = pa.array(list(fields.values()), pa.string()), pa.Table.from_batches(held).select(columns).combine_chunks()
        for a in range(0, len(first), 50_000):
            at, stop = first[a : a + 50_000], ends[a + 1 : a + 50_001]
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, stop[-1]) - at[0], pa.int32()), pa.array(place[at[0] : stop[-1]]))
            own = table.take(pa.array(row[at]))
            made = {"term": coded.dictionary.take(pa.array(order[term[at]])), "id": own["id"].combine_chunks(), "field": names.take(pa.array(field[at])), "tf": pa.array((stop - at).astype(np.int64)), "places": lists}
            yield pa.RecordBatch.from_pydict(made | {c: own[c].combine_chunks() for c in columns[1:]})

    def read(batches):
        held, words = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                words += sum(b.column("_size").to_pylist())
            if words >= most:
                yield from run(held)
                held, words = [], 0
        if held:
            yield from run(held)

    return rows.select(*columns, "_size", *fields).mapInArrow(read, ", ".join([f"term string, id {kinds['id']}, field string, tf bigint, places array<int>", *[f"{c} {kinds[c]}" for c in keep]]))


def index_of_words(rows: DataFrame, fields: list[str], keep: tuple[str, ...] = ()) -> SearchIndex:
    """Postings and lengths of ``rows`` (id, the columns ``keep``, and by field the
    words of a text as :func:`words_only` gives them).

    A record's words are sorted and counted with its task's, so neither an
    aggregation nor a shuffle of words is needed. Ids are unique.
    """
    named = {f"_w{i}": f for i, f in enumerate(fields)}
    sized = rows.select("id", *keep, size_of_words(fields).alias("_size"), *[F.col(f).alias(w) for w, f in named.items()])
    return SearchIndex(_postings(sized, named, keep), sized.select("id", *keep, F.col("_size").alias("size")), dealt=lambda n: _postings(sized.repartition(n, "id"), named, keep))


def build_index(records: DataFrame, fields: dict[str, Column], key: str = "paper_id", keep: tuple[str, ...] = ()) -> SearchIndex:
    """Postings and lengths of ``records`` (``fields``: texts by field), with
    the columns ``keep`` beside both. Ids are unique."""
    return index_of_words(records.select(F.col(key).alias("id"), *keep, *words_only(fields)), list(fields), keep)


# --- query trees --------------------------------------------------------------


class QuerySyntaxError(ValueError):
    pass


def parse(query: str) -> tuple:
    """('word', i), ('and', a, b), ('or', a, b) or ('not', a, b), and the leaves.

    Blank means AND and binds tightest, then NOT, then AND, then OR; the three
    operators are upper case. A word with _ is a phrase of its parts.
    """
    words = sanitized_query(query).split()
    leaves: list[list[str]] = []

    def implicit(run: list[str]) -> tuple:
        if not run:
            raise QuerySyntaxError("an operator lacks a word")
        out = None
        for w in run:
            leaves.append([t for t in re.split("_+", w) if t])
            leaf = ("word", len(leaves) - 1)
            out = leaf if out is None else ("and", out, leaf)
        return out

    def split(run: list[str], operators: list[str]) -> tuple:
        if not operators:
            return implicit(run)
        op, rest = operators[0], operators[1:]
        parts: list[list[str]] = [[]]
        for w in run:
            if w == op:
                parts.append([])
            else:
                parts[-1].append(w)
        tree = split(parts[0], rest)
        for p in parts[1:]:
            tree = (op.lower(), tree, split(p, rest))
        return tree

    if not words:
        raise QuerySyntaxError("no words")
    return split(words, ["OR", "AND", "NOT"]), leaves


def _match(tree: tuple, found: list[Column]) -> Column:
    if tree[0] == "word":
        return found[tree[1]]
    a, b = _match(tree[1], found), _match(tree[2], found)
    return {"and": a & b, "or": a | b, "not": a & ~b}[tree[0]]


def _score(tree: tuple, found: list[Column], parts: list[Column]) -> Column:
    """Sum over the words of the branches that the record matches; words under
    NOT add nothing."""
    if tree[0] == "word":
        return parts[tree[1]]
    a = _score(tree[1], found, parts)
    if tree[0] == "or":
        return a + _score(tree[2], found, parts)
    if tree[0] == "and":
        a = a + _score(tree[2], found, parts)
    return F.when(_match(tree, found), a).otherwise(F.lit(0.0))


def hits(index: SearchIndex, query: str, weights: dict[str, float] | None = None) -> DataFrame:
    """id and score of every record that the query matches.

    One scan of the postings of the query's words and one aggregation by
    record; document frequencies and lengths come as one-row aggregates.
    """
    tree, leaves = parse(query)
    spark = index.postings.sparkSession
    folded = spark.range(1).select(*[fold(F.lit(w)).alias(f"w{i}_{j}") for i, leaf in enumerate(leaves) for j, w in enumerate(leaf)]).first() if any(leaves) else {}
    terms = [[folded[f"w{i}_{j}"] for j in range(len(leaf))] for i, leaf in enumerate(leaves)]
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.coalesce(F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, w)])[F.col("field")], F.lit(0.0))
    rows = index.of_terms(sorted({t for leaf in terms for t in leaf})).withColumn("w", weight)
    by_field = any(len(leaf) > 1 for leaf in terms)
    if by_field:  # phrases: adjacent places in one field
        columns = []
        for i, leaf in enumerate(terms):
            lists = [F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"p{i}_{j}") for j, t in enumerate(leaf)]
            columns += lists
        rows = rows.groupBy("id", "field").agg(F.first("w").alias("w"), *columns)

        def tf(i: int, leaf: list[str]) -> Column:
            first = F.coalesce(F.col(f"p{i}_0"), F.array().cast("array<int>"))
            run = F.filter(first, lambda p: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(f"p{i}_{j}", p + j), F.lit(False)) for j in range(1, len(leaf))], F.lit(True)))
            return F.size(run)

        counts = [tf(i, leaf) for i, leaf in enumerate(terms)]
    else:
        counts = [F.when(F.col("term") == leaf[0], F.col("tf")).otherwise(0) for leaf in terms]
    per_record = rows.groupBy("id").agg(*[F.sum(c).alias(f"n{i}") for i, c in enumerate(counts)], *[F.sum(c * F.col("w")).alias(f"f{i}") for i, c in enumerate(counts)])
    df = per_record.agg(*[F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    if index.stats:
        stats = spark.range(1).select(F.lit(index.stats[0]).cast("long").alias("total"), F.lit(float(index.stats[1])).alias("mean"))
    else:
        stats = index.lengths.agg(F.count(F.lit(1)).alias("total"), F.avg("size").alias("mean"))
    found = [F.col(f"n{i}") > 0 for i in range(len(terms))]
    matched = per_record.where(_match(tree, found))
    # both sides are single rows, the results of aggregates without keys
    joined = matched.join(index.lengths, "id").join(F.broadcast(df), F.lit(True)).join(F.broadcast(stats), F.lit(True))

    def part(i: int) -> Column:
        idf = F.log((F.col("total") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        return idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("size") / F.col("mean")))

    return joined.select("id", _score(tree, found, [part(i) for i in range(len(terms))]).alias("score"))


def filtered(records: DataFrame, year: str | None = None, journal: str | None = None, paper_type: str | None = None, tags: list[str] | None = None, within: DataFrame | None = None, key: str = "paper_id") -> DataFrame:
    """Filters as the library has them: years compare as text (an unknown year
    is '' and passes an upper bound alone), names by containment without case,
    all tags, membership of ``within`` (a column named as ``key``)."""
    if year:
        low, high = year_range(year)
        if low:
            records = records.where(F.col("year_text") >= low)
        if high:
            records = records.where(F.col("year_text") <= high)
    for column, value in (("journal", journal), ("paper_type", paper_type)):
        if value:
            records = records.where(F.col(column).ilike(f"%{value}%"))
    for t in tags or []:
        records = records.where(F.array_contains("tags", t))
    if within is not None:
        records = records.join(within.select(key).distinct(), key, "left_semi")
    return records


def search(index: SearchIndex, records: DataFrame, query: str, weights: dict[str, float] | None = None, top_k: int | None = 20, key: str = "paper_id", **filters) -> DataFrame:
    """Records in order of score, then of key. Filters apply before the limit
    and leave document frequencies as they are."""
    found = hits(index, query, weights).withColumnRenamed("id", key)
    out = filtered(records, key=key, **filters).join(found, key)
    return out.orderBy(F.desc("score"), key).limit(top_k) if top_k else out


def by_author(records: DataFrame, name: str, top_k: int = 20, index: GramIndex | None = None) -> DataFrame:
    """Records whose authors' text contains a name, the newest first. With an
    index of those texts only the records that it finds are looked at."""
    rows = records.where(F.contains(F.lower("authors"), F.lower(F.lit(name)))) if index is None else records.join(index.containing(name).select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    return rows.orderBy(F.desc("year_text"), "paper_id").limit(top_k)


def top_cited(records: DataFrame, top_k: int = 20) -> DataFrame:
    n = F.expr("try_cast(citation_count AS INT)")
    return records.where("citation_count <> ''").withColumn("citations", n).orderBy(F.desc("citations"), "paper_id").limit(top_k)


def lookup(registry: DataFrame, inputs: DataFrame) -> DataFrame:
    """First hit of each ``ref``: by id, directory, DOI, publication number."""
    keys = [("id", F.col("ref")), ("dir_name", F.col("ref")), ("doi", F.lower("ref")), ("publication_number", F.upper("ref"))]
    found = None
    for level, (column, wanted) in enumerate(keys):
        own = F.lower(column) if column == "doi" else F.col(column)
        side = registry.where(own != "").select(own.alias("_k"), F.col("id").alias("_id"))
        part = inputs.withColumn("_k", wanted).join(side, "_k").select("ref", F.lit(level).alias("level"), F.col("_id").alias("id"))
        found = part if found is None else found.union(part)
    best = found.groupBy("ref").agg(F.min(F.struct("level", "id")).alias("m"))
    return inputs.join(best, "ref", "left").select("ref", F.col("m.id").alias("id"), F.col("m.level").alias("level"))


def with_all_tags(tag_rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids that carry every wanted tag."""
    return tag_rows.where(F.col("tag").isin(wanted)).groupBy("paper_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(set(wanted))).select("paper_id")


def federated(scopes: dict[str, DataFrame], top_k: int = 20, key: str = "paper_id") -> DataFrame:
    """The best ``top_k`` of each scope, ranked in their scope."""
    parts = []
    for name, found in scopes.items():
        best = found.orderBy(F.desc("score"), key).limit(top_k)
        parts.append(best.withColumn("scope", F.lit(name)).withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), key))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def in_library(results: DataFrame, library: DataFrame, column: str = "doi") -> DataFrame:
    """``results`` with whether their identifier is in the library."""
    own = library.where(F.col(column) != "").select(F.lower(column).alias("_k")).distinct().withColumn("_in", F.lit(True))
    return results.withColumn("_k", F.lower(column)).join(own, "_k", "left").withColumn("in_library", F.coalesce("_in", F.lit(False))).drop("_k", "_in")

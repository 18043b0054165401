"""Citation edges: references, citing works, shared references, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference_dois(raw: Column) -> Column:
    """DOIs of a list whose entries are texts or JSON objects, lower case."""
    paths = ["$.doi", "$.DOI", "$.externalIds.DOI", "$.external_ids.DOI"]
    one = lambda x: F.lower(F.trim(F.when(F.trim(x).startswith("{"), F.coalesce(*[F.get_json_object(x, p) for p in paths])).otherwise(x)))
    return F.array_distinct(F.filter(F.transform(raw, one), lambda d: d.isNotNull() & (d != "")))


def resolve_links(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """source_id, target_doi and target_id: kept where it is registered, else
    found by DOI, else null."""
    ids = registry.select(F.col("id").alias("_id"))
    dois = registry.where("doi <> ''").groupBy(F.lower("doi").alias("_d")).agg(F.min("id").alias("_by_doi"))
    base = edges if "target_id" in edges.columns else edges.withColumn("target_id", F.lit(None).cast(dict(registry.dtypes)["id"]))
    return (
        base.join(ids, F.col("target_id") == F.col("_id"), "left").join(dois, F.lower("target_doi") == F.col("_d"), "left")
        .select("source_id", "target_doi", F.coalesce("_id", "_by_doi").alias("target_id"))
    )


def references(edges: DataFrame, registry: DataFrame, ids: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Out-edges of the given ids (column id); targets outside the library stay,
    also under a whitelist."""
    rows = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    own = registry.select(F.col("id").alias("target_id"), "dir_name", "year")
    rows = rows.join(own, "target_id", "left")
    if within is not None:
        allowed = within.select(F.col("id").alias("target_id"), F.lit(True).alias("_in"))
        rows = rows.join(allowed, "target_id", "left").where(F.col("target_id").isNull() | F.col("_in")).drop("_in")
    return rows.select("source_id", "target_doi", "target_id", "dir_name", "year")


def citing(edges: DataFrame, registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct (cited, source) pairs by id or by DOI: two equi-joins instead of
    one join with OR, which would compare all with all."""
    cited = registry.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("cited"), F.lower("doi").alias("_d"))
    by_id = edges.join(cited, F.col("target_id") == F.col("cited")).select("cited", "source_id")
    by_doi = edges.withColumn("_d", F.lower("target_doi")).join(cited.where("_d <> ''"), "_d").select("cited", "source_id")
    own = registry.select(F.col("id").alias("source_id"), "dir_name", "year")
    return by_id.union(by_doi).distinct().join(own, "source_id")


def shared_references(edges: DataFrame, ids: DataFrame, least: int = 2) -> DataFrame:
    """DOIs that several of the ids cite; of a DOI's targets the smallest."""
    rows = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    found = rows.groupBy(F.lower("target_doi").alias("target_doi")).agg(F.count_distinct("source_id").alias("shared"), F.min("target_id").alias("target_id"))
    return found.where(F.col("shared") >= least)


def snowball(edges: DataFrame, registry: DataFrame, seeds: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Works one step from the seeds, with what ties them and a score of
    2 * shared + cites_seeds + cited_by_seeds; seeds themselves are left out."""
    seed = seeds.select(F.col("id").alias("seed")).distinct()
    own = edges.join(seed, F.col("source_id") == F.col("seed")).select("seed", F.lower("target_doi").alias("_d"), "target_id")
    cited = own.where("target_id is not null").select("seed", F.col("target_id").alias("id")).distinct()
    cites = citing(edges, registry, seeds).select(F.col("cited").alias("seed"), F.col("source_id").alias("id"))
    pivots = cited.select("id").distinct()
    beside = citing(edges, registry, pivots).select(F.lit(None).cast(dict(seed.dtypes)["seed"]).alias("seed"), F.col("source_id").alias("id"))
    ties = cited.withColumn("kind", F.lit("refs")).union(cites.withColumn("kind", F.lit("citing"))).union(beside.withColumn("kind", F.lit("shared")))
    ties = ties.join(seed.withColumnRenamed("seed", "id"), "id", "left_anti")
    if within is not None:
        ties = ties.join(within.select("id").distinct(), "id", "left_semi")
    kinds = F.collect_set("kind")
    found = ties.groupBy("id").agg(
        F.count_distinct(F.when(F.col("kind") == "refs", F.col("seed"))).alias("cited_by_seeds"),
        F.count_distinct(F.when(F.col("kind") == "citing", F.col("seed"))).alias("cites_seeds"),
        F.array_join(F.filter(F.array(F.lit("refs"), F.lit("citing"), F.lit("shared")), lambda k: F.array_contains(kinds, k)), "+").alias("relations"),
    )
    # of the candidates' references only those that a seed has: few, before anything is made distinct
    theirs = edges.select(F.col("source_id").alias("id"), F.lower("target_doi").alias("_d")).join(own.select("_d").distinct(), "_d", "left_semi").join(found.select("id"), "id", "left_semi")
    couple = theirs.groupBy("id").agg(F.count_distinct("_d").alias("shared"))
    names = registry.select("id", "dir_name", "year")
    return (
        found.join(couple, "id", "left").join(names, "id", "left")
        .select("id", "dir_name", "year", "relations", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), "cites_seeds", "cited_by_seeds",
                (2 * F.coalesce("shared", F.lit(0)) + F.col("cites_seeds") + F.col("cited_by_seeds")).cast("long").alias("score"))
    )


def ordered_candidates(found: DataFrame, top: int = 20) -> DataFrame:
    return found.orderBy(F.desc("score"), F.desc("shared"), F.coalesce("dir_name", F.col("id").cast("string"))).limit(top)

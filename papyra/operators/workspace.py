"""Workspaces: named sets of records as one membership table.

``members``: ws, id, dir_name, added_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import safe_name
from .search import lookup


def added(members: DataFrame, ws: str, refs: DataFrame, registry: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(members with the resolved refs, refs that resolve to nothing). One that
    is a member already stays as it was."""
    ws = safe_name(ws)
    found = lookup(registry, refs.select("ref").distinct())
    own = members.where(F.col("ws") == ws).select("id")
    new = found.where("id is not null").select("id").distinct().join(own, "id", "left_anti").join(registry.select("id", "dir_name"), "id")
    rows = new.select(F.lit(ws).alias("ws"), "id", "dir_name", F.lit(at).alias("added_at"))
    return members.unionByName(rows), found.where("id is null").select("ref")


def removed(members: DataFrame, ws: str, refs: DataFrame, registry: DataFrame) -> DataFrame:
    """Members without the refs, by registry first, else by the id or folder
    name that the workspace itself shows."""
    found = lookup(registry, refs.select("ref").distinct())
    shown = found.where("id is null").select(F.col("ref").alias("k"))
    gone = found.where("id is not null").select(F.col("id").alias("k")).union(shown).distinct()
    here = F.col("ws") == ws
    own = members.where(here)
    kept = own.join(gone, own["id"] == gone["k"], "left_anti").join(shown, own["dir_name"] == shown["k"], "left_anti")
    return members.where(~here).unionByName(kept)


def renamed(members: DataFrame, old: str, new: str) -> DataFrame:
    return members.withColumn("ws", F.when(F.col("ws") == old, F.lit(safe_name(new))).otherwise(F.col("ws")))


def shown(members: DataFrame, ws: str, registry: DataFrame) -> DataFrame:
    """Members with the folder names that the registry has now."""
    now = registry.select("id", F.col("dir_name").alias("_now"))
    return members.where(F.col("ws") == ws).join(now, "id", "left").select("ws", "id", F.coalesce("_now", "dir_name").alias("dir_name"), "added_at")


def names(members: DataFrame) -> DataFrame:
    return members.select("ws").distinct().orderBy("ws")

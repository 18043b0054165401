"""A search index that is kept up to date in steps.

An index is a list of segments (the postings, and the records with their size
and hash) and of delete vectors (records that are replaced or gone). A change
writes one segment of the changed records and one delete vector, never the rest;
:meth:`LiveIndex.compact` folds everything into one segment. The number of
records and their total size are carried from version to version by what a
change adds and takes away, so a search reads its words' postings alone.

A record is known by the number of the change that wrote it (``seg``) and its
number in it (``rid``), which its postings carry. A delete vector has a bit for
each record, 64 of them a row; as bits they are broadcast, so that neither a
search nor a compaction moves postings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import written
from ..sources.versions import Versions
from .maintain import content_hash
from .search import SearchIndex, index_of_words, size_of_words, words_only

#: Layout of segments and manifests; an index of another one is built anew.
SCHEMA = 1


_RECORDS = "id string, size int, h string, seg int, rid bigint"
_POSTINGS = "term string, id string, field string, tf bigint, places array<int>, seg int, rid bigint"
_BITS = "seg int, word bigint, bits bigint"


def _names(kinds: str) -> list[str]:
    return [k.split()[0] for k in kinds.split(", ")]


def _parts(manifest: dict) -> list[str]:
    return [s["name"] for s in manifest["segments"]] + manifest["deletes"]


def _bits(gone: DataFrame) -> DataFrame:
    """The delete vector of some records (seg, rid): 64 records a row."""
    bit = F.expr("shiftleft(1L, cast(rid & 63L as int))")
    return gone.groupBy("seg", F.shiftright("rid", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _without(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows whose record no delete vector has, 4,096 records a broadcast row."""
    words = bits.groupBy("seg", "word").agg(F.bit_or("bits").alias("bits"))
    nth = F.col("word").bitwiseAND(F.lit(63)).cast("int")
    of = words.groupBy("seg", F.shiftright("word", 6).alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct(nth.alias("nth"), "bits"))).alias("_m"))
    blocks = of.select("seg", "_block", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("_bits"))
    found = rows.withColumn("_block", F.shiftright("rid", 12)).join(F.broadcast(blocks), ["seg", "_block"], "left")
    bit = F.expr("getbit(get(_bits, cast(shiftright(rid, 6) & 63L as int)), cast(rid & 63L as int))")
    return found.where(F.coalesce(bit, F.lit(0)) == 0).select(*rows.columns)


class LiveIndex:
    """``fields``: texts by field, as for ``build_index``; ``key``: the id."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, Column], key: str = "paper_id", schema: int = SCHEMA):
        self.spark, self.path, self.fields, self.key, self.schema = spark, path.rstrip("/"), fields, key, schema
        self.versions = Versions(spark, path)

    # --- reading ---

    def _manifest(self, version: int | None = None) -> dict:
        found = self.versions.read(version) if version else self.versions.latest()[1]
        return found or {"schema": self.schema, "segments": [], "deletes": [], "total": 0, "size": 0, "next": 1}

    def _live(self, manifest: dict, table: str, kinds: str) -> DataFrame:
        if not manifest["segments"]:
            return self.spark.createDataFrame([], kinds)
        rows = self.spark.read.schema(kinds).parquet(*[f"{self.path}/{s['name']}/{table}" for s in manifest["segments"]])
        return _without(rows, self.spark.read.schema(_BITS).parquet(*[f"{self.path}/{d}" for d in manifest["deletes"]])) if manifest["deletes"] else rows

    def _records(self, manifest: dict) -> DataFrame:
        return self._live(manifest, "records", _RECORDS)

    def snapshot(self, version: int | None = None) -> SearchIndex:
        """The index as of a version (the newest): later changes leave it as it is."""
        m = self._manifest(version)
        return SearchIndex(self._live(m, "postings", _POSTINGS).drop("seg", "rid"), self._records(m).select("id", "size"), (m["total"], m["size"] / m["total"] if m["total"] else 0.0))

    def needs_rebuild(self) -> bool:
        """True for an index that another layout wrote, or one without numbers
        of its records."""
        found = self._manifest()
        return found["schema"] != self.schema or "next" not in found

    # --- writing ---

    def _read(self, records: DataFrame) -> DataFrame:
        """id, the texts of the fields and their hash."""
        texts = [f"t{i}" for i in range(len(self.fields))]
        return records.select(F.col(self.key).alias("id"), *[c.alias(t) for t, c in zip(texts, self.fields.values())]).withColumn("h", content_hash(*texts))

    def _numbered(self, rows: DataFrame, seg: int) -> DataFrame:
        """``rows`` with their number and, for texts, their words: folded and split once."""
        texts = {f"t{i}": F.col(f"t{i}") for i in range(len(self.fields))}
        return written(rows.select("id", "h", *words_only(texts)).withColumn("seg", F.lit(seg)).withColumn("rid", F.monotonically_increasing_id()), "changed")

    def _write_segment(self, rows: DataFrame) -> tuple[dict, int]:
        """The segment of some numbered rows and their size."""
        name = f"segment-{uuid.uuid4().hex}"
        words = rows.select("id", "seg", "rid", *[F.col(f"t{i}").alias(f) for i, f in enumerate(self.fields)])
        rows.select("id", size_of_words([f"t{i}" for i in range(len(self.fields))]).alias("size"), "h", "seg", "rid").write.parquet(f"{self.path}/{name}/records")
        n, size = self.spark.read.parquet(f"{self.path}/{name}/records").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        index_of_words(words, list(self.fields), ("seg", "rid")).write_postings(f"{self.path}/{name}", size)
        return {"name": name, "records": n}, size

    def apply(self, upserts: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """A version with ``upserts`` (records; those that are stored as they are
        count as unchanged) put in and ``removed`` (key) taken out; the newest
        version if nothing changes. Of a record in both the upsert counts. Ids
        are unique in ``upserts``."""
        number, _ = self.versions.latest()
        old = self._manifest()
        if self.needs_rebuild():
            raise RuntimeError("the index has another layout: rebuild it")
        stored = self._records(old)
        segment, size, gone = None, 0, self.spark.createDataFrame([], "seg int, rid bigint, size int")
        if removed is not None:
            gone = stored.join(removed.select(F.col(self.key).alias("id")).distinct(), "id", "left_semi")
            if upserts is not None:
                gone = gone.join(upserts.select(F.col(self.key).alias("id")), "id", "left_anti")
            gone = gone.select("seg", "rid", "size")
        if upserts is not None:
            rows = self._read(upserts)
            new = self._numbered(rows.join(stored.select("id", "h"), ["id", "h"], "left_anti") if old["segments"] else rows, old["next"])
            gone = gone.unionByName(stored.join(new.select("id"), "id", "left_semi").select("seg", "rid", "size"))
            if not new.isEmpty():
                segment, size = self._write_segment(new)
        gone = written(gone, "gone")
        lost, lost_size = gone.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if segment is None and not lost:
            return number
        deletes = list(old["deletes"])
        if lost:
            deletes.append(f"deletes-{uuid.uuid4().hex}")
            _bits(gone).write.parquet(f"{self.path}/{deletes[-1]}")
        segments = old["segments"] + ([segment] if segment else [])
        total = old["total"] - lost + (segment["records"] if segment else 0)
        return self.versions.commit(number + 1, {"schema": self.schema, "segments": segments, "deletes": deletes, "total": total, "size": old["size"] - lost_size + size, "next": old["next"] + 1})

    def rebuild(self, records: DataFrame) -> int:
        """A version built of ``records`` alone, whatever the layout before."""
        number, _ = self.versions.latest()
        segment, size = self._write_segment(self._numbered(self._read(records), 1))
        return self.versions.commit(number + 1, {"schema": self.schema, "segments": [segment], "deletes": [], "total": segment["records"], "size": size, "next": 2})

    def compact(self) -> int:
        """The newest version as one segment without delete vectors."""
        number, _ = self.versions.latest()
        old = self._manifest()
        if len(old["segments"]) < 2 and not old["deletes"]:
            return number
        name = f"segment-{uuid.uuid4().hex}"
        # the runs stay as they are, less what is gone
        self._live(old, "postings", _POSTINGS).write.parquet(f"{self.path}/{name}/postings")
        self._records(old).write.parquet(f"{self.path}/{name}/records")
        return self.versions.commit(number + 1, old | {"segments": [{"name": name, "records": old["total"]}], "deletes": []})

    def vacuum(self, keep: int = 1) -> int:
        """Drop versions but the last ``keep``, and parts that only those used."""
        return self.versions.vacuum(keep, _parts)

    def history(self) -> list[tuple[int, int, int, int, int]]:
        """(version, layout, segments, records of the last segment, live records)."""
        return [(n, m["schema"], len(m["segments"]), m["segments"][-1]["records"] if m["segments"] else 0, m["total"]) for n, m in ((n, self.versions.read(n)) for n in self.versions.numbers())]

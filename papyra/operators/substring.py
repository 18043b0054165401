"""Substring search over stored n-grams of short texts, with verification.

Every text is listed under each of its distinct runs of one to three signs. A
needle of up to three signs is such a run itself; a longer one is looked for
among the records of its rarest run, and only there the text is compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signs of the longest run.
LONGEST = 3


def grams(text: Column, longest: int = LONGEST) -> Column:
    """Distinct runs of 1 to ``longest`` signs; none for null and ''."""
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(runs(n), F.array().cast("array<string>")) for n in range(1, longest + 1)])))


def pieces(needle: Column) -> Column:
    """What of a needle is looked up: itself, or its runs of ``LONGEST`` signs."""
    return F.when(F.length(needle) <= LONGEST, F.array(needle)).otherwise(F.filter(grams(needle), lambda g: F.length(g) == LONGEST))


@dataclass
class GramIndex:
    """``postings``: gram, scope, id, text; ``counts``: gram, scope, n. Stored,
    both are partitioned by a hash of the gram; a frequent gram is written by
    several tasks. ``scope`` is a value that searches are confined to, or ''.
    """

    postings: DataFrame
    counts: DataFrame

    PARTS, SALTS = 64, 8

    @classmethod
    def build(cls, records: DataFrame, key: str, text: Column, scope: Column | None = None) -> GramIndex:
        """Null texts and texts of no sign are in no posting, a null scope is ''."""
        low = F.lower(text)
        rows = records.select(F.col(key).alias("id"), F.coalesce(scope.cast("string") if scope is not None else F.lit(""), F.lit("")).alias("scope"), low.alias("text"))
        postings = rows.select(F.explode(grams(F.col("text"))).alias("gram"), "scope", "id", "text")
        return cls(postings, postings.groupBy("gram", "scope").agg(F.count("*").alias("n")))

    @classmethod
    def _part(cls, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(cls.PARTS)).cast("int")

    def write(self, path: str) -> None:
        part = self._part(F.col("gram"))
        salt = F.pmod(F.xxhash64("id"), F.lit(self.SALTS))
        self.postings.withColumn("part", part).repartition("part", salt).sortWithinPartitions("part", "gram").write.partitionBy("part").mode("overwrite").parquet(f"{path}/postings")
        self.counts.withColumn("part", part).repartition("part").sortWithinPartitions("gram").write.partitionBy("part").mode("overwrite").parquet(f"{path}/counts")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> GramIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts"))

    def _of(self, table: DataFrame, found: list[str]) -> DataFrame:
        rows = table.where(F.col("gram").isin(found))
        return rows.where(F.col("part").isin([self._part(F.lit(g)) for g in found])) if "part" in table.columns else rows

    def containing(self, needle: str) -> DataFrame:
        """id and text of the records that contain ``needle`` without regard to
        case; reads the postings of its rarest run. All records with a text for
        an empty needle are not its business: '' finds none."""
        low = needle.lower()
        runs = [low] if len(low) <= LONGEST else sorted({low[i : i + LONGEST] for i in range(len(low) - LONGEST + 1)})
        if not low:
            return self.postings.limit(0).select("id", "text")
        known = {r["gram"]: r["n"] for r in self._of(self.counts, runs).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(known) < len(runs):
            return self.postings.limit(0).select("id", "text")
        rarest = min(runs, key=lambda g: (known[g], g))
        return self._of(self.postings, [rarest]).where(F.contains("text", F.lit(low))).select("id", "text")

    def count_of(self, needles: DataFrame) -> DataFrame:
        """``needles`` (needle, scope; distinct, lower case) with ``n``: how many
        records of the scope contain it.

        Up to three signs the counts say it. A longer needle meets the records
        of its rarest run in the scope, so what is compared is bounded by what
        the rarest run selects; a run that a scope lacks settles it at 0.
        """
        asked = needles.select("needle", "scope").distinct().where("needle <> ''")
        looked = asked.select("needle", "scope", F.explode(pieces(F.col("needle"))).alias("gram"))
        sized = looked.join(self.counts.select("gram", "scope", "n"), ["gram", "scope"], "left").groupBy("needle", "scope").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
        settled = (F.length("needle") <= LONGEST) | (F.col("m.n") == 0)
        short = sized.where(settled).select("needle", "scope", F.col("m.n").alias("n"))
        rows = sized.where(~settled).select("needle", "scope", F.col("m.gram").alias("gram")).join(self.postings.select("gram", "scope", "text"), ["gram", "scope"])
        long = rows.where(F.contains("text", F.col("needle"))).groupBy("needle", "scope").agg(F.count("*").alias("n"))
        rest = sized.where(~settled).select("needle", "scope").join(long, ["needle", "scope"], "left").select("needle", "scope", F.coalesce("n", F.lit(0)).alias("n"))
        return short.union(rest)

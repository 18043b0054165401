"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks that separate words in every contract: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Only a local session without
    that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(shared_dir, "_local", None)
    if made is None:
        made = shared_dir._local = "file://" + tempfile.mkdtemp(prefix="papyra-")
        atexit.register(shutil.rmtree, made[len("file://") :], True)
    return made


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/papyra/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder written by :func:`materialize` once nothing reads it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._papyra_path = path
    return back


def drop_table(df: DataFrame) -> None:
    path = getattr(df, "_papyra_path", None)
    if path:
        remove_folder(df.sparkSession, path)


def bound_batches(spark: SparkSession, rows: int = 512, megabytes: int = 8) -> None:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def is_training(doc_id, folds: int):
    """True outside the held-out fold: crc32 of the id's text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != 0


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of columns."""
    bound_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(fields)

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in ((columns[f.name], f) for f in wanted)], schema=wanted)

    return df.mapInArrow(run, fields)


#: Bytes of text that a task takes at once.
BLOCK_BYTES = 6 << 20


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in batches of ``limit`` bytes of text or a
    little more: what texts have in common is then worked out once a block."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        found = pa.Table.from_batches(held).combine_chunks().to_batches()
        return found[0] if found else held[0]

    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= limit:
            yield joined()
            held, size = [], 0
            pa.default_memory_pool().release_unused()  # idle workers keep little
    if held:
        yield joined()


def coded(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of each text's parts in a table of distinct parts, where each
    text's parts begin (and the last one's end), and the distinct parts."""
    at = parts.offsets.to_numpy().astype("i8")
    found = parts.flatten().dictionary_encode()
    return found.indices.to_numpy(), at - at[0], found.dictionary


def coded_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """:func:`coded` for the words of every text, A-Z lower-cased where asked."""
    codes, at, words = coded(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))
    empty = pc.index(words, "").as_py() if len(words) else -1
    if empty >= 0:  # what is before or after the outer blanks
        real = codes != empty
        at = np.concatenate([[0], np.cumsum(real)])[at]
        codes = codes[real]
    return codes, at, words


def laid_out(pool: np.ndarray, first: np.ndarray, n: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``pool[first[c] : first[c] + n[c]]`` of all codes in a row,
    and where each piece begins (and the last one ends)."""
    counts = n[codes]
    at = np.concatenate([[0], np.cumsum(counts)])
    where = np.arange(at[-1]) - np.repeat(at[:-1] - first[codes], counts)
    return pool[where], at


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files give fewer partitions, as a
    table of one large row group does; otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


class GenerationCache:
    """A bounded memo of two generations: what was used since the last turn
    over survives the next one, so frequent keys stay and memory has a limit."""

    def __init__(self, compute: Callable[[list], list], limit: int):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def table(self, keys: Iterable) -> dict:
        young, old, out, missing = self.young, self.old, {}, []
        for key in keys:
            value = young.get(key)
            if value is None:
                value = old.get(key)
                if value is None:
                    missing.append(key)
                    continue
                young[key] = value
            out[key] = value
        if missing:
            for key, value in zip(missing, self.compute(missing)):
                young[key] = out[key] = value
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


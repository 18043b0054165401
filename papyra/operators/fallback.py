"""Conversion by a chain of strategies, each for what failed before.

A strategy is a function of a file's bytes that gives its text or raises; the
chain needs no library of its own. Stages are written tables: a strategy sees
the rows that every earlier one failed on, and a lost executor repeats the
running tasks of one stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import written

Strategy = Callable[[bytes], str | None]


def resolved_order(wanted: Iterable[str | None] | None, available: Iterable[str], default: str = "plain") -> list[str]:
    """Names in lower case, each once; ``auto`` (also for none at all) stands
    for the available ones, or the default without any."""
    names = [n.strip().lower() for n in wanted or [] if isinstance(n, str) and n.strip()] or ["auto"]
    found = list(available) or [default]
    return list(dict.fromkeys(x for n in names for x in (found if n == "auto" else [n])))


def files(spark, path: str, pattern: str = "*") -> DataFrame:
    """path and content of a folder's files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def converted(rows: DataFrame, strategies: dict[str, Strategy], order: Iterable[str] | None = None, key: str = "path") -> DataFrame:
    """``key``, ``parser``, ``text`` and ``error`` of every row (key, content).

    The first strategy of the order that gives a text that is not blank counts:
    parser names it and error is null. Where all fail, parser and text are null
    and error has the causes in order, joined by `` | ``. A name without a
    strategy and a null content are causes like others. Rows may repeat.
    """
    left, out = rows.select(F.col(key), "content", F.array().cast("array<string>").alias("errors")), None
    for name in resolved_order(order, strategies):

        def work(batches, name=name, run=strategies.get(name)):
            for b in batches:
                texts: list[str | None] = []
                causes: list[str | None] = []
                for content in b["content"]:
                    text = cause = None
                    if run is None:
                        cause = f"{name}: unknown"
                    elif content is None:
                        cause = f"{name}: no content"
                    else:
                        try:
                            text = run(bytes(content))
                            cause = None if text and text.strip() else f"{name}: no text"
                        except Exception as e:  # whatever a converter raises is its row's error
                            cause = f"{name}: {type(e).__name__}: {e}"
                    texts.append(text if cause is None else None)
                    causes.append(cause)
                yield b.assign(text=pd.Series(texts, dtype=object), cause=pd.Series(causes, dtype=object))

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        tried = written(left.mapInPandas(work, f"`{key}` {kinds[key]}, content binary, errors array<string>, text string, cause string"), f"converted-{name}")
        done = tried.where("cause is null").select(F.col(key), F.lit(name).alias("parser"), "text", F.lit(None).cast("string").alias("error"))
        out = done if out is None else out.unionByName(done)
        left = tried.where("cause is not null").select(F.col(key), "content", F.concat("errors", F.array("cause")).alias("errors"))
    failed = left.select(F.col(key), F.lit(None).cast("string").alias("parser"), F.lit(None).cast("string").alias("text"), F.array_join("errors", " | ").alias("error"))
    return out.unionByName(failed)

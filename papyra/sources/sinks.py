"""Writers of records, events and line files."""

from __future__ import annotations

import json
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Shelves of a large library (a fixed layout, as names are found by it).
SHELVES = 4096


def shelf_of(dir_name: str) -> str:
    """The shelf of a record's folder: three hexadecimal digits of its CRC-32."""
    return f"{zlib.crc32(dir_name.encode()) % SHELVES:03x}"


def write_records(rows: DataFrame, folder: str, shelved: bool = False) -> DataFrame:
    """One ``<dir_name>/meta.json`` per row (dir_name, record: JSON text) below
    ``folder``, which driver and executors share; returns dir_name and bytes.
    ``shelved``: below a shelf of ``folder``, so that no one folder lists all.

    A file is written under another name and then renamed, so a reader meets
    the old one or the new one, and a repeated task writes the same again.
    """

    def work(parts):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for pdf in parts:
            sizes = []
            for name, record in zip(pdf["dir_name"], pdf["record"]):
                data = (json.dumps(json.loads(record), indent=2, ensure_ascii=False) + "\n").encode()
                own = f"{base}/{zlib.crc32(name.encode()) % SHELVES:03x}/{name}" if shelved else f"{base}/{name}"
                store.create_dir(own, recursive=True)
                temporary = f"{own}/.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(temporary) as f:
                    f.write(data)
                store.move(temporary, f"{own}/meta.json")
                sizes.append(len(data))
            yield pd.DataFrame({"dir_name": pdf["dir_name"], "bytes": sizes})

    return rows.select("dir_name", "record").mapInPandas(work, "dir_name string, bytes long")


def append_events(events: DataFrame, folder: str) -> None:
    """Events (ts and others) appended to a log laid out by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(folder)


def write_lines(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, replacing what is there."""
    rows.write.mode("overwrite").json(folder)

"""Queries against their SQL on titles that the generated tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from papyra import catalog

TITLES = ["Zu und. Dieüauß der.", "ŉew ǰob ﬁne ﬂow", "Ü, Ü, Ü", "", "ﬃ ß ΐ", "été café", "Plain words of a title", "ß"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, None if i == 30 else TITLES[i % len(TITLES)] + "\nbody", "de", "src1", 5) for i in range(48)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["similar_title", "endnote_main_pdf"])
def test_odd_titles(spark, odd, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
    got = catalog.queries()[name](spark, odd)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"select {quoted} from ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*[F.col(c) for c in columns]).collect()))) == sorted(map(str, want))
    assert len(want) > 30

"""Conversion chains and table functions."""

import pytest
from pyspark.sql import functions as F

from papyra.operators import extract, fallback
from papyra.sources import tool_pages


def test_orders():
    assert fallback.resolved_order(None, ["a", "b"]) == fallback.resolved_order([" ", None, 3], ["a", "b"]) == ["a", "b"]
    assert fallback.resolved_order(["B ", "auto", "c"], ["a", "b"]) == ["b", "a", "c"] and fallback.resolved_order(["auto"], []) == ["plain"]


def test_each_strategy_sees_what_failed_before(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def first(content):
        if content.startswith(b"%"):
            return content[1:].decode()
        raise OSError("no mark")

    def second(content):
        seen.add(1)
        return content.decode()

    for name, data in (("a.bin", b"%one"), ("b.bin", b"two"), ("c.bin", b"\xff"), ("d.bin", b"  ")):
        (tmp_path / name).write_bytes(data)
    rows = fallback.files(spark, f"file://{tmp_path}", "*.bin").withColumn("path", F.substring_index("path", "/", -1))
    rows = rows.union(spark.createDataFrame([("e.bin", None)], "path string, content binary"))
    got = {r.path: (r.parser, r.text, r.error) for r in fallback.converted(rows, {"first": first, "second": second}).collect()}
    assert got["a.bin"] == ("first", "one", None) and got["b.bin"] == ("second", "two", None)
    assert got["c.bin"][:2] == (None, None) and got["c.bin"][2].startswith("first: OSError: no mark | second: UnicodeDecodeError")
    assert got["d.bin"][2] == "first: OSError: no mark | second: no text" and got["e.bin"][2] == "first: no content | second: no content"
    assert seen.value == 3  # once for each row that the first left, whatever reads the result
    assert fallback.converted(rows.limit(0), {"first": first}).count() == 0


def test_definitions_as_a_table_function(spark):
    tool_pages.register(spark)
    text = "-program x.x {\n namelist A {\n  var v -type REAL { info { of it } }\n }\n}"
    spark.createDataFrame([("INPUT_Q", text, 1), ("n", None, 2), (None, "namelist A { var w -type REAL { } }", 3), ("e", "", 4)], "stem string, text string, title int").createOrReplaceTempView("d")
    rows = spark.sql("SELECT d.title AS k, p.page_name, p.title FROM d, LATERAL definition_pages(stem, text) AS p ORDER BY k").collect()
    assert [tuple(r) for r in rows] == [(1, "x.x/A/v", "v"), (3, "A/w", "w")]
    with pytest.raises(Exception, match="must be a string"):
        spark.sql("SELECT * FROM definition_pages(1, 'x')")


def test_page_texts_and_manual_pages(spark):
    html = '<html><title>T</title><body>no<main><h1>Head</h1><p>a&nbsp; b &eacute;</p><pre>x &lt; <b>y</b></pre><ul><li>one</li></ul><script>z</script></main></body></html>'
    rows = spark.createDataFrame([(html, "p/1", None), (None, "p/2", "t"), ("", "p/3", "")], "html string, page_name string, title string")
    assert rows.select(extract.page_text(F.col("html")).alias("t")).first().t == "Head\na b é\n\nx < y\n\n- one"
    got = {r.page_name: (r.title, r.synopsis, r.content) for r in tool_pages.manifest_pages(rows).collect()}
    assert got["p/1"] == ("T", "Head", "Head\na b é\n\nx < y\n\n- one") and got["p/2"] == ("t", "", "") and got["p/3"] == ("p/3", "", "")

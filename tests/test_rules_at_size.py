"""Rules ask Python and regular expressions no more than they must."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from kavram.functions import deasciify as D, sentences
from kavram.plans import queries as Q


def test_deasciify_of_nested_rows(spark):
    """Nulls, empty lists, and words over several rows; the column travels as Arrow, not as pandas objects."""
    table = {"c": {"X": 1}, "s": {"aX": 1}}
    rows = [(["cok", "as", "x"],), (None,), ([],), (["cok", None, ""],)]
    df = spark.createDataFrame(rows, "t array<string>").coalesce(1).select(D.deasciify(F.col("t"), table).alias("w"))
    words = lambda x: [w and D.deasciified(w, table) for w in x or []]
    assert [r.w for r in df.collect()] == [words(t) for t, in rows] and words(["cok"]) != ["cok"]
    assert "ArrowEvalPython" in (plan := df._jdf.queryExecution().executedPlan().toString()) and ", 251" in plan


def test_endings_are_looked_at_after_dots_only(spark, tmp_path):
    """A word without a dot at its end costs no search for one; results are the SQL's."""
    expression = sentences.split_sentences(F.col("text"), sentences.Prefixes(("Dr",), ("No",)))
    assert "endswith" in str(expression._jc.toString()).lower()
    texts = ["Bir. Iki.\n Üç", "Dr. Ali geldi. No. 5 var. No. Ev", "A.B. Ev. \nSon.", "a.\n B", "a.\n\n B", "x.. Y.\" Z", ".", "a.) B. (C", "a.b C", ""]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = Q.QUERIES["split_sentences"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.SQL['split_sentences']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))

"""TSV of lines that a CSV reader would take for something else, against the SQL."""

from __future__ import annotations

import duckdb
import pytest

from kavram.plans import queries as Q
from kavram.sources import tsv

ODD = ["", None, " ", "a\n\nb\n", "\n", "\\", "a\\\nb", '"', '""', '"a\nb"', 'a""\n""', "\0", "a\0b\n\0", "\0\0", "a\rb\r\nc", "\ta\t\t", "#a", "NULL", "﻿a", " \x85\x0b", "\\N\\n", "x" * 100_000]


@pytest.mark.parametrize("name", ["tsv_scan", "incremental_files", "pipeline_run"])
def test_odd_lines(spark, tmp_path, name):
    rows = [(i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": Q.F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in rows if "\0" not in (t or "")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = Q.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_fields_by_position(spark, tmp_path):
    """Too few or too many, and what isn't a number."""
    (tmp_path / "a.tsv").write_bytes("t\t1\t+2\t-3\ta\tb\nt\t1\n \t \n\t\t\t\t\nt\t 1\t1.0\t99999999999999999999\t\n".encode())
    got = [tuple(r) for r in tsv.read_sentences(spark, str(tmp_path / "a.tsv")).collect()]
    assert got == [("t", 1, 2, -3, "a"), ("t", 1, None, None, None), ("t", None, None, None, None)]

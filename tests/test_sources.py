from __future__ import annotations

from kavram.sources import tsv
from kavram.streaming.incremental import process_new_files


def test_literal_text(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('t\t1\t1\t1\t"x" y\n\nt\t1\t1\t2\tNA\nt\t1\t1\t3\t\n', encoding="utf-8")
    path = str(tmp_path / "a.tsv")
    assert [r.sentence for r in tsv.read_sentences(spark, path).orderBy("s_no").collect()] == ['"x" y', "NA", None]
    assert [r.sentence for r in tsv.read_sentences(spark, path, na_words=True).orderBy("s_no").collect()] == ['"x" y', None, None]


def test_four_columns(spark, tmp_path):
    (tmp_path / "book_sentence-split-corrected.csv").write_text("1\t2\t3\tBir cümle\n", encoding="utf-8")
    row = tsv.read_repaired(spark, str(tmp_path)).first()
    assert tuple(row) == ("book", 1, 2, 3, "Bir cümle")


def test_new_files_only(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    seen = []

    def step(df):
        seen.append(df.count())
        return df

    for n in (1, 2):
        (tmp_path / "in" / f"{n}.tsv").write_text(f"t\t1\t1\t{n}\tcümle\n", encoding="utf-8")
        process_new_files(spark, folder, out, state, step)
    process_new_files(spark, folder, out, state, step)
    assert seen == [1, 1]
    assert sorted((r.s_no, r.file) for r in spark.read.parquet(out).collect()) == [(1, "1.tsv"), (2, "2.tsv")]


def test_write_table(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        tsv.write_table(df, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3

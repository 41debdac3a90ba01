from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as P
from kavram.llm import packing

from .conftest import prose, words
from .test_decontaminate import brute as leaks
from .test_near_dedup import changed, roots

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, folder, rows, items):
    docs = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def staged(spark, folder, docs, out):
    tables = [docs]
    for name, stage in P.STAGES:
        stage(spark, tables[-1], str(folder)).write.parquet(f"{out}/{name}")
        tables.append(spark.read.parquet(f"{out}/{name}"))
    return tables


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    common = [f"f{i}" for i in range(20)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else prose(rng, 1, 20_000) for _ in range(n))
    items = [(i, text(40)) for i in range(5)]
    rows = [(i, text(150), "en", rng.choice("aaaab")) for i in range(120)]
    rows += [(200 + i, changed(rng, rows[i][1], 1), "en", "c") for i in range(20)]
    rows += [(300 + i, text(60) + " " + items[i][1] + " " + text(60), "en", "a") for i in range(5)]
    rows += [(400, " ".join(f"{w}***%%%" for w in text(150).split()), "en", "a")]
    rows += [(500, None, None, None), (501, "", "en", "b"), (None, text(100), "en", None), (0, rows[0][1], "en", rows[0][3])]
    docs = table(spark, tmp_path / "in", rows, items)
    tables = staged(spark, tmp_path / "in", docs, tmp_path / "out")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mix", "pack"]
    assert all(t.columns == docs.columns for t in tables[:-1])
    ids = [[r.doc_id for r in t.collect()] for t in tables[:5]]
    assert Counter(ids[1]) == Counter(d for d, *_ in rows if d != 400)
    kept = [(d, t) for d, t, *_ in rows if d not in (400, None)]
    gone = {a for a, _ in roots(dict(kept).items(), 0.6)}
    assert gone == set(range(200, 220))
    assert Counter(ids[2]) == Counter({d for d, _ in kept} - gone | {None})
    dirty = {d for d, _, _ in leaks([(d, t) for d, t in kept], items)}
    assert Counter(ids[3]) == Counter(d for d in ids[2] if d not in dirty) and dirty == set(range(300, 305))
    assert set(ids[4]) == set(ids[3]) and len(ids[4]) >= len(ids[3])
    mixed = Counter((r.doc_id, r.text or "") for r in tables[4].collect())
    assert Counter(packing.decode(tables[5].collect())) == mixed


def test_run_is_the_stages(spark, tmp_path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = staged(spark, small, docs, tmp_path)
    got = Counter(packing.decode(P.run(spark, small).collect()))
    assert got == Counter(packing.decode(tables[-1].collect()))
    assert sum(got.values()) == tables[-2].count()


def test_odd_rows_and_columns(spark, tmp_path, make, odd):
    """Nulls, empty and very long texts, ties and repeated rows, and columns named like those that the stages use."""
    rng = random.Random(3)
    items = [(1, prose(rng, 30)), (2, None), (3, ""), (None, prose(rng, 30))]
    rows = [*odd, (20, prose(rng, 100_000, 3000), "en", "a"), (21, prose(rng, 300, 3000) + " " + items[0][1], "en", "a")]
    make(rows).write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    tables = staged(spark, tmp_path / "in", docs, tmp_path / "out")
    assert all(t.schema == docs.schema for t in tables[:-1])
    plain = lambda t: Counter((r.doc_id, r.text) for r in t.collect())
    assert plain(tables[1]) == plain(docs) - Counter({(8, odd[11][1]): 1})  # one letter, over and over
    kept = plain(tables[2])
    assert sorted(kept, key=str) == sorted({(r[0], r[1]) for r in rows} - {(2, odd[2][1]), (None, odd[3][1]), (8, odd[11][1])}, key=str)
    assert kept[1, odd[0][1]] == 1 and kept[4, ""] == 2
    assert plain(tables[3]) == kept - Counter({(21, rows[-1][1]): 1})
    assert set(plain(tables[4])) == set(plain(tables[3]))
    mixed = Counter((r.doc_id, r.text or "") for r in tables[4].collect())
    assert Counter(packing.decode(tables[5].collect())) == mixed


def test_empty(spark, tmp_path):
    docs = table(spark, tmp_path / "in", [], [])
    for t in staged(spark, tmp_path / "in", docs, tmp_path / "out")[1:]:
        assert t.count() == 0


def test_words_are_those_of_the_operators():
    assert words("A b.c É") == ["a", "b", "c", "é"]

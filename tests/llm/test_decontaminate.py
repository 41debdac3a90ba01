from __future__ import annotations

import random

from kavram.llm import decontaminate as D

from .conftest import prose, words

ITEMS = "item_id long, text string, extra string"


def brute(docs, items, least=0.8, k=5):
    out = []
    for d, t in docs:
        w = words(t)
        for i, x in set(items):
            v = words(x)
            if not v:
                continue
            n = min(k, len(v))
            grams = lambda z: {tuple(z[a : a + n]) for a in range(len(z) - n + 1)}  # noqa: E731,B023
            share = len(grams(v) & grams(w)) / len(grams(v))
            if share >= least:
                out.append((d, i, round(share, 6)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    items = [(i, prose(rng, n, 5000)) for i, n in enumerate([1, 2, 4, 5, 6, 8, 12, 13, 20, 21, 40, 60, 100, 150, 300, 700])]
    items += [(50, None), (51, ""), (None, prose(rng, 30, 5000)), (7, items[7][1])]
    docs = []
    for n, (_, x) in enumerate(items):
        base = prose(rng, rng.choice([0, 3, 500, 4000]), 5000).split()
        at = rng.randrange(len(base) + 1)
        docs.append((n, " ".join(base[:at] + [x or ""] + base[at:])))
    for n, (_, x) in enumerate(items[8:16]):  # one word in the middle changed, or half of it only
        v = x.split()
        v[len(v) // 2] = "changed"
        docs += [(100 + n, prose(rng, 50, 5000) + " " + " ".join(v)), (200 + n, " ".join(x.split()[: len(v) // 2]))]
    docs += [(300, prose(rng, 3000, 5000)), (301, items[10][1].upper().replace(" ", ",  ")), (302, items[11][1] + " " + items[12][1]), (302, items[11][1] + " " + items[12][1])]
    return docs, items


def test_against_brute_force(spark, make):
    docs, items = cases()
    got = D.leaks(make(docs), spark.createDataFrame([(*i, "e") for i in items], ITEMS)).collect()
    want = brute(docs, items)
    found = sorted([tuple(r) for r in got], key=str)
    assert set(found) <= set(want)
    assert len(found) >= 0.98 * len(want)
    assert found == want


def test_groups_of_items_give_the_same(spark, make):
    docs, items = cases()
    table = spark.createDataFrame([(*i, "e") for i in items], ITEMS)
    assert sorted(D.leaks(make(docs), table, D.Settings(group_bytes=500)).collect(), key=str) == sorted(D.leaks(make(docs), table).collect(), key=str)


def test_rows_that_are_clean(spark, make):
    docs, items = cases()
    table = make(docs)
    kept = D.clean(table, spark.createDataFrame([(*i, "e") for i in items], ITEMS), D.Settings(group_bytes=2000))
    dirty = {d for d, _, _ in brute(docs, items)}
    assert kept.schema == table.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_odd_rows(spark, make, odd):
    docs = make(odd)
    items = spark.createDataFrame([(1, odd[0][1][:400], None), (2, None, None), (None, "one", None)], ITEMS)
    got = sorted([(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()], key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (6, None)], key=str)
    assert D.clean(docs, items).count() == docs.count() - 5
    assert D.leaks(make([]), items).count() == 0 and D.clean(make([]), items).count() == 0
    none = items.limit(0)
    assert D.leaks(docs, none).count() == 0 and D.clean(docs, none).count() == docs.count()


def test_recall_at_the_limit(spark, make):
    """Items of which four fifths are there, within long documents."""
    rng = random.Random(9)
    docs, items = [], []
    for i in range(150):
        x = prose(rng, rng.randrange(15, 120), 100_000).split()
        part = x[: int((len(x) - 4) * 0.82) + 5]
        items.append((i, " ".join(x)))
        docs.append((i, " ".join([prose(rng, 300, 100_000), *part, prose(rng, 300, 100_000)])))
    want = brute(docs, items)
    got = D.leaks(make(docs), spark.createDataFrame([(*i, "e") for i in items], ITEMS)).collect()
    assert len(want) > 100 and len(got) >= 0.95 * len(want)

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from kavram.llm import kernel as K, toxicity as T

from .conftest import words

LABELS = "doc_id long, toxic int, text string"
INSULTS = ["vile", "scoundrel", "cretin", "oaf"]


def corpus(seed, n=600, insults=INSULTS, rate=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{min(int(rng.expovariate(0.02)), 300)}" for _ in range(rng.randrange(40, 120))]
        toxic = i % rate == 0
        if toxic:
            for _ in range(rng.randrange(3, 9)):
                w[rng.randrange(len(w))] = rng.choice(insults)
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(toxic), None))
    return rows, labels


def hashed(ws):
    return dict(zip(ws, K.words(pa.array([" ".join(ws)])).hashes.tolist()))


def brute_lexicon(texts, by, vocabulary, n_clean, s):
    """The lexicon from word counts of labelled documents, by dictionaries, a dense matrix and a linear solver."""
    toxic, clean = (np.array([by[w][k] for w in vocabulary], float) for k in (0, 1))
    bad, fine = T.seed_terms(toxic, clean, n_clean, s)
    seeds = [vocabulary[i] for i in [*bad, *fine]]
    pairs, near = Counter(), Counter()
    for t in texts:
        for i, a in enumerate(t):
            for b in t[max(0, i - s.window) : i] + t[i + 1 : i + 1 + s.window]:
                pairs[a, b] += 1
                near[a] += 1
    total = sum(near.values())
    every = sorted(near)
    place = {w: i for i, w in enumerate(every)}
    of = {*seeds}
    m = np.zeros((len(every), len(every)))
    for (a, b), n in pairs.items():
        m[place[a], place[b]] = max(0, math.log(n * total / (near[a] * near[b])))
    degree = m.sum(axis=0)
    edged = {a for a, _ in pairs} | of
    start = np.zeros((len(every), 2))
    for k, own in enumerate((bad, fine)):
        for i in own:
            start[place[vocabulary[i]], k] = 1 / len(own)
    step = (1 - s.restart) * m / np.where(degree > 0, degree, 1)[None]
    at = np.linalg.solve(np.eye(len(every)) - step, s.restart * start) - s.restart * start
    value = dict(zip(every, np.log((at[:, 0] + 1e-3 / len(edged)) / (at[:, 1] + 1e-3 / len(edged)))))
    toxic_seeds = [vocabulary[i] for i in bad]
    cut = np.median([value[w] for w in toxic_seeds]) / 2
    out = {w: max(value[w], s.min_weight) for w in toxic_seeds}
    least, n_seed = T.critical(s.alpha, len(edged)), sum(near[w] for w in toxic_seeds)
    for w in every:
        hits = sum(pairs[w, x] for x in toxic_seeds)
        expected = near[w] * n_seed / total
        llr = 2 * (hits * math.log(hits / expected) - hits + expected) if hits > expected else 0
        a, b = by.get(w, (0, 0))
        ratio = (a + 0.5) / toxic.sum() / ((b + 0.5) / clean.sum())
        if w not in of and value[w] >= cut and llr >= least and (w not in by or ratio >= s.min_ratio):
            out[w] = max(value[w], s.min_weight)
    return out


def test_lexicon_against_brute_force(spark, make, monkeypatch):
    rows, labels = corpus(1)
    rng = random.Random(8)
    for i, t in rows[:500:10]:  # a toxic word that no label tells of, beside those that are
        w = t.split()
        at = rng.randrange(len(w) - 3)
        w[at : at + 3] = [rng.choice(INSULTS), "hidden", rng.choice(INSULTS)]
        rows[i] = (i + 10_000, " ".join(w))
    s = T.Settings(window=4, restart=0.4, steps=30, min_clean_seeds=20)
    label = {i: x for i, x, _ in labels}
    texts = [words(t) for _, t in rows]
    by = defaultdict(lambda: [0, 0])
    for (i, _), t in zip(rows, texts):
        if i in label:
            for w in set(t):
                by[w][0 if label[i] else 1] += 1
    number = hashed(sorted(by))
    order = sorted(by, key=number.get)
    n_clean = sum(x == 0 for x in label.values())
    want = brute_lexicon(texts, dict(by), order, n_clean, s)
    assert {*INSULTS} <= {*want} and "hidden" in want and len(want) <= 8
    docs = make(rows, 5).select("text")
    vocabulary, counts = np.array([number[w] for w in order], np.uint64), np.array([by[w] for w in order], float)
    got = T.lexicon_of(docs, vocabulary, counts, n_clean, s)
    number |= hashed(sorted(want))
    expected = {number[w]: v for w, v in want.items()}
    assert got[0].tolist() == sorted(expected)
    assert np.allclose(got[1], [expected[h] for h in got[0].tolist()], rtol=1e-4)
    # small parts, many rounds and other blocks change nothing
    monkeypatch.setattr(T, "_PART", 4000)
    monkeypatch.setattr(T, "_GROUP", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = T.lexicon_of(make(rows, 9).select("text"), vocabulary, counts, n_clean, s)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again[0].tolist() == got[0].tolist() and np.allclose(again[1], got[1])


def test_graph_has_every_pair(spark, make, monkeypatch):
    """Pairs without a seed and words with themselves too, in several passes, classes and parts."""
    rng = random.Random(3)
    texts = [[f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.choice([0, 1, 2, 5, 60]))] for _ in range(120)]
    texts += [["alone"], ["much"] * 400, ["vile", "much"]]
    want = Counter()
    for t in texts:
        for i, a in enumerate(t):
            for b in t[max(0, i - 3) : i] + t[i + 1 : i + 4]:
                want[a, b] += 1
    number = hashed(sorted({w for t in texts for w in t}))
    seeds = np.sort(np.array([number["vile"], number["alone"]], np.uint64))
    for name, value in (("_PART", 500), ("_GROUP", 2), ("_PASS", 1000), ("_CLASS", 300), ("_SLICE", 64)):
        monkeypatch.setattr(T, name, value)
    graph = T.Graph(make([(i, " ".join(t)) for i, t in enumerate(texts)], 4).select("text"), seeds, 3)
    assert graph.classes.passes > 1 and graph.classes.blocks > 1
    word = {h: w for w, h in number.items()}
    every = [word[h] for h in graph.words.tolist()]
    assert {*every} == {a for a, _ in want} | {"alone"}
    got = {}
    for table in graph.tables:
        for batch in table.toArrow().to_batches():
            for block, keys, n in T._rows(batch):
                for a, b, k in zip(*(x.tolist() for x in graph.classes.split(keys)), n.tolist()):
                    pair = every[a], every[b * graph.classes.count + block]
                    assert pair not in got
                    got |= {pair: k, pair[::-1]: k}
    assert got == dict(want) and got["much", "much"] > 65_536 // 256
    n = np.array([[want[a, b] for b in every] for a in every], float)
    total, sums = n.sum(), n.sum(axis=0)
    assert graph.sums.tolist() == sums.tolist() and graph.total == total
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.nan_to_num(np.maximum(np.log(n * total / np.outer(sums, sums)), 0))
    x = np.random.default_rng(1).random((2, len(every)))
    assert np.allclose(graph.degree, m.sum(axis=0), rtol=1e-5) and np.allclose(graph.times(x), x @ m, rtol=1e-5, atol=1e-6)
    assert np.allclose(graph.near(x[0]), n @ x[0])
    graph.removed()


def test_a_pass_leaves_no_shuffle(spark, make, monkeypatch):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {x for x in found.split() if x.endswith(".data") and "shuffle_" in x}

    old, left, write = files(), [], T.written

    def written(*args):
        table = write(*args)
        left.append(files() - old)
        return table

    monkeypatch.setattr(T, "written", written)
    monkeypatch.setattr(T, "_PASS", 1000)
    texts = [" ".join(f"w{i * j % 97}" for j in range(40)) for i in range(50)]
    graph = T.Graph(make(list(enumerate(texts)), 4).select("text"), np.zeros(0, np.uint64), 3)
    graph.removed()
    assert len(left) > 1 and not any(left)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pack_keeps_large_numbers():
    keys = np.cumsum(np.array([0, 1, 255, 256, 65_535, 65_536, 2**50], np.int64))
    n = np.array([1, 255, 256, 2**40, 2, 3, 2**33], np.int64)
    for k, m in ((keys, n), (keys[:1], n[:1]), (keys[:0], n[:0])):
        size, raw = T.pack(k, m)
        got = T.unpack(size, pa.array([raw], pa.binary())[0])
        assert got[0].tolist() == k.tolist() and got[1].tolist() == m.tolist()


def test_wide_gaps_take_few_bytes():
    """Of two bytes and of three: parts of the texts have many of these, which took 16 bytes each before they were compressed."""
    rng = np.random.default_rng(4)
    keys = np.cumsum(np.where(rng.random(100_000) < 0.05, rng.integers(1 << 16, 1 << 19, 100_000), rng.integers(1, 1 << 8, 100_000)))
    assert len(T.pack(keys, np.ones(len(keys), np.int64))[1]) < 1.35 * len(keys)


def test_walk_is_near_its_end_in_few_steps():
    """Groups of words with few edges between them, which a walk leaves slowly: step by step it takes all of its 20 steps."""
    rng = np.random.default_rng(5)
    n, k = 400, 8
    group = np.arange(n) % k
    m = rng.random((n, n)) * np.where(group[:, None] == group, 1, 0.0005 * (rng.random((n, n)) < 0.1))
    m = m + m.T

    class Graph:
        degree, products = m.sum(axis=0), 0

        def times(self, x):
            self.products += 1
            return (x @ m).astype(np.float32).astype(np.float64)

    s, graph = T.Settings(), Graph()
    start = np.zeros((2, n))
    start[0, [3, 12]] = start[1, [5, 20]] = 0.5
    at = T.walk(graph, start, s)
    want = np.linalg.solve(np.eye(n) - (1 - s.restart) * m / graph.degree, s.restart * start.T).T
    assert graph.products < s.steps and np.allclose(at.sum(axis=1), 1)
    assert np.max(np.abs(at - want) / (want + T._least(want))) < (1 - s.restart) ** s.steps


def test_passes_get_smaller():
    """All classes, each in one pass; what is kept and what one pass moves, about twice as much, is never much more than all."""
    for passes, blocks in ((1, 1), (2, 1), (5, 1), (5, 2), (5, 90)):
        c = T.Classes(1000, passes, blocks)
        ranges = [c.of_pass(k) for k in range(passes)]
        assert [i for low, end in ranges for i in range(low, end)] == list(range(c.count))
    assert all((end + 2 * (end - low)) / c.count < 1.2 for low, end in ranges)


def test_finder():
    known = np.sort(np.random.default_rng(6).integers(0, 2**64, 3000, dtype=np.uint64))
    asked = np.concatenate([known[::3], known[::5] + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    for some in (known, known[:1], known[:0], np.append(known, np.uint64(2**64 - 1)), known >> np.uint64(40)):
        some = np.unique(some)
        assert T.finder(some)(asked).tolist() == T._places(some, asked).tolist()


def test_parts_are_added_up():
    rng = np.random.default_rng(7)
    for most in (5, 2**40):  # key and number in one, or not
        parts = [(np.unique(rng.integers(0, 2**30, 50)), None) for _ in range(4)]
        parts = [(k, rng.integers(1, most, len(k))) for k, _ in [*parts, parts[0]]]
        want = Counter()
        for k, n in parts:
            want.update(dict(zip(k.tolist(), n.tolist())))
        keys, n = T.merged(parts)
        assert list(zip(keys.tolist(), n.tolist())) == sorted(want.items())


def test_documents(spark, make):
    """Unlabelled ones too: toxic documents are found, clean ones aren't."""
    rows, labels = corpus(2)
    got = {r.doc_id: r for r in T.scored(make(rows), spark.createDataFrame(labels, LABELS)).collect()}
    toxic, clean = [i for i, _ in rows if i % 5 == 0], [i for i, _ in rows if i % 5]
    assert np.mean([got[i].toxic for i in toxic]) >= 0.9
    assert np.mean([got[i].toxic for i in clean]) <= 0.02


def test_many_documents_and_insults(spark, make):
    """Twenty insults, two languages, a long tail of words, texts of very unequal length and a large group of copies."""
    rng = random.Random(9)
    insults = [f"slur{k}" for k in range(20)]
    rows, labels = [], []
    copy = None
    for i in range(10_000):
        tongue = "de" if i % 3 == 0 else "en"
        n = rng.choice([8, 20, 30, 60, 200 if i % 7 else 30])
        w = [f"{tongue}{int(rng.paretovariate(0.7)) % 20_000}" for _ in range(n)]
        toxic = i % 15 == 1
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w.insert(rng.randrange(len(w)), insults[rng.randrange(10) + 10 * (tongue == "de")])
        text = " ".join(w)
        if i == 1:
            copy = text
        rows.append((i, copy + f" again{i % 3}" if toxic and i % 4 == 3 else text))
        if i % 2:
            labels.append((i, int(toxic), None))
    got = {r.doc_id: r.toxic for r in T.scored(make(rows, 8), spark.createDataFrame(labels, LABELS)).collect()}
    toxic = [i for i in got if i % 15 == 1]
    assert np.mean([got[i] for i in toxic if i % 2 == 0]) >= 0.9 and np.mean([got[i] for i in toxic]) >= 0.9
    assert np.mean([got[i] for i in got if i % 15 != 1]) <= 0.02


def test_rare_words_are_seeds(spark, make):
    """Insults in 0.3% of the documents, among more frequent words than a bounded graph would hold."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(8_000):
        w = [f"w{rng.randrange(6_000)}" for _ in range(30)]
        if i % 320 == 0:
            w[5], w[15] = INSULTS[0], INSULTS[1]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 320 == 0), None))
    lexicon = T.induce(make(rows), spark.createDataFrame(labels, LABELS))
    insults = {*hashed(INSULTS[:2]).values()}
    assert insults <= {*lexicon.words.tolist()} and lexicon.threshold < float("inf")


def test_every_significant_word_is_a_seed():
    n = 30
    toxic, clean = np.append(np.full(n, 60.0), np.full(100, 5.0)), np.append(np.zeros(n), np.full(100, 50.0))
    bad, fine = T.seed_terms(toxic, clean, 1000, T.Settings())
    assert bad.tolist() == list(range(n)) and not {*bad} & {*fine} and len(fine) >= 64


def test_copies_count_together():
    least = np.array([[1, 2], [1, 3], [4, 3], [5, 6]])
    assert T.copy_weights(least).tolist() == [T._WHOLE // 2, T._WHOLE // 2, T._WHOLE // 2, T._WHOLE]


def test_critical():
    assert abs(T.critical(0.05, 1) - 3.841) < 0.001 and T.critical(0.01, 10**6) > T.critical(0.01, 10**3)


def test_seeds_without_clean_words_are_the_lexicon(spark, make):
    rows = [(i, f"vile x{i} oaf") if i % 2 else (i, "") for i in range(100)] + [(i, f"fine y{i} day") for i in range(100, 200)]
    labels = [(i, int(i < 100), None) for i in range(200)]
    got = T.scored(make(rows), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r.toxic == (r.doc_id < 100 and r.doc_id % 2 == 1) for r in got)


def test_threshold():
    assert T.best_threshold(np.array([0.9, 0.8, 0.2, 0.0]), np.array([True, True, False, False])) == 0.5
    assert T.best_threshold(np.array([0.0, 0.0]), np.array([True, False])) == float("inf")


def test_odd_rows(spark, make, odd):
    rows, labels = corpus(4)
    labels += [(None, 1, None), (2, None, None), (0, 0, None), (0, 1, None), (5, 1, None), (5, 1, None), (10**9, 1, None)]
    docs = make(rows + [((r[0] + 10_000) if r[0] is not None else None, *r[1:]) for r in odd])
    got = T.scored(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.toxicity == 0 and not r.toxic for r in got if r.doc_id is None or r.doc_id > 10_000)


def test_without_seeds(spark, make):
    rows, labels = corpus(5, 60)
    for some in ([], [x for x in labels if x[1] == 0], labels[:2]):
        got = T.scored(make(rows), spark.createDataFrame(some, LABELS)).collect()
        assert len(got) == 60 and not any(r.toxic or r.toxicity for r in got)
    assert T.scored(make([]), spark.createDataFrame(labels, LABELS)).count() == 0


from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kavram.models import networks as N, serve, taggers as M
from kavram.plans.sentence_pipeline import Pipeline
from kavram.plans.tasks import apply_task

SENTENCES = [["Ali", "eve", "geldi", "."], [], ["kitap"], [f"w{i}" for i in range(40)], ["bir", "bir"]]


def test_gru_cell():
    rng = np.random.default_rng(0)
    gru = N.Gru(N.Weights(None, 1), 3, 2)
    x, h = rng.standard_normal((1, 3)), rng.standard_normal((1, 2))
    own = x @ gru.kernel + gru.bias[0]
    inner = h @ gru.recurrent + gru.bias[1]
    z, r = (1 / (1 + np.exp(-(own[:, a : a + 2] + inner[:, a : a + 2]))) for a in (0, 2))
    want = z * h + (1 - z) * np.tanh(own[:, 4:] + r * inner[:, 4:])
    assert np.allclose(gru.step(gru.project(x), h), want)


def test_padding():
    assert N.padded([1, 2, 3], 5).tolist() == [0, 0, 1, 2, 3] and N.padded([1, 2, 3], 2).tolist() == [2, 3]
    assert N.padded([1, 2, 3], 5, "post").tolist() == [1, 2, 3, 0, 0] and N.padded([1, 2, 3], 2, "pre", "post").tolist() == [1, 2]
    assert N.padded([], 2).tolist() == [0, 0]


def test_weights(tmp_path):
    w = N.Weights(None, 3)
    arrays = [w.take(2, 3), w.take(4)]
    N.save(str(tmp_path / "m.npz"), arrays)
    again = N.load(str(tmp_path / "m.npz"))
    assert all((a == b).all() for a, b in zip(arrays, again)) and w.parameters == 10
    with pytest.raises(ValueError):
        N.Weights(again).take(3, 3)
    with pytest.raises(ValueError):
        N.Weights(again).close()


def test_published_sizes():
    labels = lambda n: N.Vocabulary.of([f"l{i}" for i in range(n)])
    none = lambda w: []
    assert M.ContextTagger(labels(17), none, M.Size(), "UNK").parameters == 2_568_594
    assert M.ContextTagger(labels(4), none, M.Size(units=256, layers=2), "O").parameters == 5_572_357
    assert M.ContextParser(labels(48), none, M.Size(units=256, layers=2)).parameters == 5_659_482


@pytest.mark.parametrize("model", ["stemmer", "pos:context", "pos:tree", "ner:context", "ner:characters", "dep:context", "dep:tree"])
def test_alone_and_in_a_batch(model):
    name, _, variant = model.partition(":")
    tagger = serve.Tagger(name, variant or None)
    batch = tagger.predict_batch(SENTENCES)
    assert [len(x) for x in batch] == [len(x) for x in SENTENCES]
    assert batch == [tagger.predict(x) for x in SENTENCES]
    if name == "dep":
        assert all(0 <= head <= 40 for x in batch for _, _, head, _ in x)


def test_sentiment():
    s = serve.SentimentAnalyzer()
    texts = ["güzel bir gün", "", None, "  ", "kötü"]
    p = s.predict_proba_batch(texts)
    assert p[1:4] == [0.5] * 3 and s.predict_batch(texts)[1:4] == [0] * 3
    assert all(0 <= x <= 1 for x in p) and abs(s.predict_proba(texts[0]) - p[0]) < 1e-6


def test_sentiment_reads_256_pieces(monkeypatch):
    """Without weights too; the window's end is what a text of 256 pieces and more fills."""
    model = serve.SentimentAnalyzer().model
    seen, run = [], model.layers[0].run
    monkeypatch.setattr(model.layers[0], "run", lambda x, **options: seen.append(x) or run(x, **options))
    text = "güzel bir gün " * 100
    model.probabilities([text])
    assert seen[0].shape[1] == 256
    assert (seen[0][0] == model.embedding[np.array(model.pieces(text)[:256]) % model.size.vocabulary]).all()


def test_resolve():
    assert serve.resolve(["dep:tree"]) == {"stemmer": "morph", "pos": "tree", "dep": "tree"}
    assert serve.resolve(["pos", "pos:tree"]) == {"stemmer": "morph", "pos": "tree"}
    for bad in (["xyz"], ["pos:xyz"], ["dep:tree", "pos:context"]):
        with pytest.raises(ValueError):
            serve.resolve(bad)


def test_pipeline(spark, tmp_path):
    rows = ["t1\t1\t1\t1\tAli Ankara'ya geldi.", "t1\t1\t1\t2\t\"Güzel\" dedi", "t1\t1\t1\t3\t", "t1\t1\t2\t1\t" + " ".join(f"w{i}" for i in range(95)), "t1\t1\t2\t2\tSon ."]
    (tmp_path / "in.tsv").write_text("\n".join(rows) + "\n", encoding="utf-8")
    pipeline = Pipeline(["dep:tree", "ner", "sentiment"])
    got = pipeline.run(spark, str(tmp_path / "in.tsv"), str(tmp_path / "out")).orderBy("p_no", "s_no").collect()
    assert [r.s_no for r in got] == [1, 2, 1, 2] and pipeline.report.rows == 4
    assert [len(c) for c in got[2].tokens_40] == [40, 40, 15]
    for r in got:
        assert len(r.tokens) == len(r.morph) == len(r.pos) == len(r.ner) == len(r.dep) and 0 <= r.sentiment <= 1
        assert [t for c in r.tokens_40 for t in c] == r.tokens
    assert got[1].sentence == '"Güzel" dedi'


def test_tasks(spark):
    df = spark.createDataFrame([("IŞIK 21 da",)], "t string")
    run = lambda task: apply_task(df, task, "t").first().result
    assert run("lower_case") == "ışık 21 da"
    assert run("convert_numbers_to_words") == "IŞIK yirmi bir da"
    assert run("drop_stop_words") == "IŞIK 21"
    assert len(run("part_of_speech_tagging")) == 3
    with pytest.raises(ValueError):
        run("xyz")
    with pytest.raises(NotImplementedError):
        run("correct_typos")
    assert df.select(F.col("t")).count() == 1

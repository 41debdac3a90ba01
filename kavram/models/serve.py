"""Models on DataFrames: Arrow UDFs over nested chunks, factories, assets.

A model is described by a small frozen ``Spec``, which travels to the workers;
each worker process builds the model once and keeps it. A sentence's chunks
come in one row and leave as one flat list, so no explode, shuffle or join is
needed around a model.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields, replace
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import assets
from ..functions.tokenize import word_punct
from ..operators.morphology import Dictionaries
from . import networks as N, taggers as M

log = logging.getLogger("kavram")

#: model -> variant -> what it needs besides itself; the first variant is the default
VARIANTS: dict[str, dict[str, tuple[str, ...]]] = {
    "stemmer": {"morph": ()},
    "pos": {"context": (), "tree": ("stemmer",)},
    "ner": {"context": (), "characters": ()},
    "dep": {"context": (), "tree": ("stemmer", "pos:tree")},
    "sentiment": {"recurrent": ()},
}

POS_LABELS = sorted("ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split())
NER_LABELS = ["LOC", "ORG", "PER"]


def resolve(models: list[str]) -> dict[str, str]:
    """Variants by model, with everything that they need, in the order to run in.
    A variant that is asked for by name wins over a default; two different ones of one model are an error."""
    named: dict[str, str] = {}
    plain: list[str] = []
    todo = list(models)
    while todo:
        model, _, variant = todo.pop(0).partition(":")
        if model not in VARIANTS or variant and variant not in VARIANTS[model]:
            raise ValueError(f"no such model: {model}{':' * bool(variant)}{variant}")
        if not variant:
            plain.append(model)
            continue
        if named.get(model, variant) != variant:
            raise ValueError(f"{model} is asked for as {named[model]} and as {variant}")
        if model not in named:
            named[model] = variant
            todo += VARIANTS[model][variant]
    for model in plain:
        named.setdefault(model, next(iter(VARIANTS[model])))
    return {m: named[m] for m in VARIANTS if m in named}


@dataclass(frozen=True)
class Assets:
    """Where models come from. weights: a folder with ``{model}_{variant}_{prod|eval}.npz``;
    without one, weights are random from ``seed`` and sizes are small, for trying things out."""

    weights: str = ""
    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"
    vocabularies: str = ""
    suffixes: str = assets.path("suffixes.tsv")
    stems: str = assets.path("stems.tsv")
    exact: str = assets.path("exact.tsv")
    evaluate: bool = False
    seed: int = 7


@dataclass(frozen=True)
class Spec:
    model: str
    variant: str
    assets: Assets = Assets()


_PAIRS = "array<struct<token:string,tag:string>>"
TYPES = {"stemmer": "array<string>", "pos": _PAIRS, "ner": _PAIRS, "dep": "array<struct<id:int,word:string,head:int,rel:string>>", "sentiment": "double"}


def _pairs(path: str) -> list[list[str]]:
    return [line.split("\t") for line in Path(path).read_text(encoding="utf-8").splitlines() if "\t" in line]


@lru_cache(maxsize=2)
def dictionaries(suffixes: str, stems: str, exact: str) -> Dictionaries:
    """The analyser's tables read by a worker itself."""
    from ..functions.text import FLAGS

    by_suffix: dict[str, list[str]] = {}
    for suffix, tag in _pairs(suffixes):
        by_suffix.setdefault(suffix, []).append(tag)
    by_stem: dict[str, list[str]] = {}
    for stem, flags in _pairs(stems):
        if int(flags) >> len(FLAGS):
            raise ValueError(f"{stem}: unknown bits in flag {flags}")
        own = by_stem.setdefault(stem, [])
        own += [FLAGS[i] for i in range(12, -1, -1) if int(flags) >> i & 1 and FLAGS[i] not in own]
    return Dictionaries({k: sorted(set(v)) for k, v in by_suffix.items()}, {k: sorted(v) for k, v in by_stem.items()}, {w: a.split() for w, a in _pairs(exact)})


@lru_cache(maxsize=2)
def _encoder(path: str) -> M.Pieces:
    """Of texts, which hardly come again."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: sp.encode(text)


@lru_cache(maxsize=2)
def _pieces(path: str) -> M.Pieces:
    """Of words; frequent ones are kept."""
    return lru_cache(maxsize=1 << 16)(_encoder(path))


def _vocabulary(a: Assets, name: str, default: list[str], unknown: str | None = None) -> N.Vocabulary:
    return N.Vocabulary.read(f"{a.vocabularies}/{name}.json") if a.vocabularies else N.Vocabulary.of(default, unknown)


@lru_cache(maxsize=8)
def build(spec: Spec):
    """The model, kept by each Python process."""
    a, real = spec.assets, bool(spec.assets.weights)
    stage = "eval" if a.evaluate else "prod"
    arrays = N.load(f"{a.weights}/{spec.model}_{spec.variant}_{stage}.npz") if real else None
    other = lambda model, variant: build(Spec(model, variant, a))
    cut = lambda size, **small: size if real else replace(size, **{k: v for k, v in small.items() if k in {f.name for f in fields(size)}})
    tiny = {"embedding": 8, "units": 8, "vocabulary": 4096, "word": 8, "tag_units": 8, "history_units": 8, "words": 4096, "dense": (2, 1)}
    log.info("building %s:%s, %s weights", spec.model, spec.variant, stage if real else "random")
    if spec.model == "stemmer":
        chars = _vocabulary(a, "characters", list("abcçdefgğhıijklmnoöprsştuüvyzqwx0123456789'.,"), "?")
        tags = _vocabulary(a, "morph_tags", sorted({t for v in dictionaries(a.suffixes, a.stems, a.exact).suffixes.values() for x in v for t in x.replace("^", "+").split("+")}), "?")
        size = cut(M.MorphSize(), **tiny)
        if not real:
            size = replace(size, characters=len(chars) + 1, tags=len(tags) + 1)
        return M.Disambiguator(dictionaries(a.suffixes, a.stems, a.exact), chars, tags, size, arrays, a.seed)
    if spec.model == "sentiment":
        return M.Sentiment(_encoder(a.pieces), cut(M.SentimentSize(), **tiny), arrays, a.seed)
    if spec.model == "pos":
        labels = _vocabulary(a, "pos_labels", POS_LABELS)
        if spec.variant == "tree":
            return M.TreeTagger(other("stemmer", "morph"), _vocabulary(a, "words", [], "?"), labels, cut(M.TreeSize(), **tiny), "whole", arrays, a.seed)
        return M.ContextTagger(labels, _pieces(a.pieces), cut(M.Size(), **tiny), "UNK", arrays, a.seed)
    if spec.model == "ner":
        labels = _vocabulary(a, "ner_labels", ["O", *NER_LABELS])
        if spec.variant == "characters":
            return M.CharTagger(_vocabulary(a, "ner_characters", [chr(c) for c in range(32, 127)], "?"), labels, cut(M.CharSize(), **tiny | {"dense": 8, "characters": 128}, layers=2), arrays, a.seed)
        return M.ContextTagger(labels, _pieces(a.pieces), cut(M.Size(units=256, layers=2), **tiny), "O", arrays, a.seed)
    labels = _vocabulary(a, "dep_labels", sorted("acl advcl advmod amod appos aux case cc ccomp clf compound conj cop csubj dep det discourse fixed flat iobj mark nmod nsubj nummod obj obl orphan parataxis punct root vocative xcomp".split()))
    if spec.variant == "tree":
        return M.TreeParser(other("stemmer", "morph"), other("pos", "tree"), _vocabulary(a, "words", [], "?"), labels, cut(M.TreeSize(), **tiny), "whole", arrays, a.seed)
    return M.ContextParser(labels, _pieces(a.pieces), cut(M.Size(units=256, layers=2), **tiny), arrays, a.seed)


def _sizes(lists: pa.Array) -> np.ndarray:
    """Of the lists; null ones have none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _named(numbers: np.ndarray, name) -> pa.Array:
    kinds, at = np.unique(numbers, return_inverse=True)
    return pa.array([name(k) for k in kinds.tolist()], pa.string()).take(pa.array(at))


def _results(model, kind: str, tokens: M.Tokens, words: pa.Array) -> tuple[pa.Array, M.Tokens]:
    """A value for each token, and the tokens; parsers cut their lists."""
    found = model.found(tokens)
    if kind == "stemmer":
        number, pairs = model.pairs(tokens, found)
        return pa.array([text for _, text in pairs], pa.string()).take(pa.array(number)), tokens
    if kind == "dep":
        tokens = tokens.cut(model.window)
        place = np.arange(len(tokens.codes)) - np.repeat(tokens.begin, tokens.sizes) + 1
        head, rel = found
        fields = {"id": pa.array(place, pa.int32()), "word": words.take(pa.array(tokens.codes)), "head": pa.array(head, pa.int32()), "rel": _named(rel, model.name)}
    else:
        fields = {"token": words.take(pa.array(tokens.codes)), "tag": _named(found, model.name)}
    return pa.StructArray.from_arrays(list(fields.values()), list(fields)), tokens


def results(model, kind: str, nested: pa.Array, cut: int | None = None) -> pa.Array:
    """The model's results of list<list<string>>, in one list for each row."""
    lists = nested.flatten()
    row, sizes = np.repeat(np.arange(len(nested)), _sizes(nested)), _sizes(lists)
    if cut:
        parts = -(-sizes // cut)
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        row, sizes = np.repeat(row, parts), np.minimum(np.repeat(sizes, parts) - place * cut, cut)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    values, tokens = _results(model, kind, M.Tokens(words.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes), words)
    ends = np.cumsum(np.bincount(row, tokens.sizes, len(nested)).astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _once(run):
    """Not to be moved: a filter that Spark derives from an explode of the results would
    run the model a second time, below the shuffle that spreads its rows."""
    return run.asNondeterministic()


def annotation(spec: Spec, nested: Column, cut: int | None = None) -> Column:
    """The model's results for array<array<string>>, chunk by chunk, in one flat list. cut: longer chunks are cut into chunks of so many tokens."""

    @F.arrow_udf(TYPES[spec.model])
    def run(batch: pa.Array) -> pa.Array:
        return results(build(spec), spec.model, batch, cut)

    return _once(run)(nested)


def sentiment(spec: Spec, text: Column) -> Column:
    """The probability of a positive text, of the whole sentence."""

    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array(build(spec).probabilities(batch.to_pylist()), pa.float64())

    return _once(run)(text)


def annotated(df: DataFrame, models: dict[str, str], assets: Assets = Assets(), tokens: str = "tokens_40", text: str = "no_accents") -> DataFrame:
    """df with a column for each model, raw: pairs for pos and ner, four fields for dep.
    All are columns of one step, so that a task has one worker for all models."""
    columns = {}
    for model, variant in models.items():
        spec = Spec(model, variant, assets)
        if model == "sentiment":
            columns["sentiment"] = sentiment(spec, F.col(text))
        elif variant == "characters":  # it has tokens of its own, from those of a chunk joined by spaces
            columns[model] = annotation(spec, F.transform(F.col(tokens), lambda chunk: word_punct(F.array_join(chunk, " "))))
        else:
            columns["morph" if model == "stemmer" else model] = annotation(spec, F.col(tokens))
    return df.withColumns(columns) if columns else df


class Tagger:
    """One model on the driver: predict for a sentence, predict_batch for many."""

    def __init__(self, model: str, variant: str | None = None, assets: Assets = Assets()):
        self.spec = Spec(model, resolve([f"{model}:{variant}" if variant else model])[model], assets)
        self.model = build(self.spec)

    def predict_batch(self, sentences: list[list[str]]) -> list:
        return self.model.predict_batch(sentences)

    def predict(self, tokens: list[str]) -> list:
        return self.model.predict_batch([tokens])[0]


class MorphologicalAnalyzer(Tagger):
    def __init__(self, assets: Assets = Assets()):
        super().__init__("stemmer", None, assets)


class PartOfSpeechTagger(Tagger):
    def __init__(self, variant: str | None = None, assets: Assets = Assets()):
        super().__init__("pos", variant, assets)


class EntityRecognizer(Tagger):
    def __init__(self, variant: str | None = None, assets: Assets = Assets()):
        super().__init__("ner", variant, assets)


class DependencyParser(Tagger):
    def __init__(self, variant: str | None = None, assets: Assets = Assets()):
        super().__init__("dep", variant, assets)


class SentimentAnalyzer:
    def __init__(self, assets: Assets = Assets()):
        self.model = build(Spec("sentiment", "recurrent", assets))

    def predict_proba(self, text: str | None) -> float:
        return float(self.model.probabilities([text])[0])

    def predict(self, text: str | None) -> int:
        return int(self.predict_proba(text) > 0.5)

    def predict_proba_batch(self, texts: list[str | None]) -> list[float]:
        return self.model.probabilities(texts).tolist()

    def predict_batch(self, texts: list[str | None]) -> list[int]:
        return self.model.predict(texts)


def onnx_step(path: str):
    """A function of named arrays that runs an ONNX file, for models that are kept in that form."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=onnxruntime.get_available_providers())
    names = [o.name for o in session.get_outputs()]
    return lambda **inputs: dict(zip(names, session.run(names, inputs)))


def accelerators(spark: SparkSession) -> dict[str, str]:
    """What the cluster gives a task: GPUs where its scheduler assigns them, else CPUs only."""
    conf = spark.sparkContext.getConf()
    gpus = conf.get("spark.task.resource.gpu.amount", "0")
    return {"cpus": conf.get("spark.task.cpus", "1"), "gpus": gpus or "0"}

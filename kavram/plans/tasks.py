"""Tasks by name, on a column of a DataFrame or on one text."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import assets as files
from ..functions import deasciify as D, numbers, sentences, text as T, tokenize as K
from ..models.serve import Assets, Spec, annotation, sentiment
from ..operators import stopwords


NAMES = "stemming_morph_analysis named_entity_recognition dependency_parsing part_of_speech_tagging sentiment_analysis split_sentences convert_numbers_to_words deasciify lower_case remove_punctuations remove_accent_marks drop_stop_words".split()


def _words(c: Column) -> Column:
    return F.filter(F.split(T.clean(c), " "), lambda t: t != "")


def _joined(c: Column) -> Column:
    return F.array_join(c, " ")


def _lines(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return f.read().splitlines()


def tasks(assets: Assets = Assets(), stop_words: str = files.path("stop_words.txt"), prefixes: str = files.path("prefixes.txt"), patterns: str = files.path("deasciify.json")) -> dict[str, Callable[[Column], Column]]:
    """Every task. Those on words split on white space and join with one space; models get Treebank tokens in chunks."""
    model = lambda name, variant: lambda c: annotation(Spec(name, variant, assets), F.array(K.treebank(c)), K.CHUNK)
    return {
        "stemming_morph_analysis": model("stemmer", "morph"),
        "named_entity_recognition": model("ner", "context"),
        "dependency_parsing": model("dep", "context"),
        "part_of_speech_tagging": model("pos", "context"),
        "sentiment_analysis": lambda c: (sentiment(Spec("sentiment", "recurrent", assets), c) > 0.5).cast("int"),
        "split_sentences": lambda c: sentences.split_sentences(c, sentences.parse_prefixes(_lines(prefixes))),
        "convert_numbers_to_words": lambda c: _joined(numbers.number_words(_words(c))),
        "deasciify": lambda c: _joined(D.deasciify(_words(c), D.read_table(patterns))),
        "lower_case": T.lower_tr,
        "remove_punctuations": T.strip_punctuation,
        "remove_accent_marks": T.remove_accents,
        "drop_stop_words": lambda c: _joined(stopwords.drop(_words(c), [w.strip() for w in _lines(stop_words) if w.strip()])),
    }


def apply_task(df: DataFrame, task: str, column: str, out: str = "result", **options) -> DataFrame:
    """df with the result of a task in a column of its own."""
    known = tasks(**options)
    if task == "correct_typos":
        raise NotImplementedError("there is no spelling correction")
    if task not in known:
        raise ValueError(f"no such task: {task}; there are {', '.join(known)}")
    return df.withColumn(out, known[task](F.col(column)))


def register(spark: SparkSession, **options) -> list[str]:
    """The scalar models and rules that need Python, as functions of SQL."""
    spark.udf.register("number_words", numbers.number_words_udf())
    spark.udf.register("deasciify", D.deasciify_udf(D.read_table(options.get("patterns", files.path("deasciify.json")))))
    return ["number_words", "deasciify"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m kavram.plans.tasks", description="Runs a task on one text.")
    parser.add_argument("--task")
    parser.add_argument("--text")
    parser.add_argument("--list_tasks", action="store_true")
    parser.add_argument("--example_usage", action="store_true")
    args = parser.parse_args(argv)
    if args.list_tasks:
        print("\n".join(tasks()))
        return 0
    if args.example_usage:
        print('python -m kavram.plans.tasks --task lower_case --text "IŞIK"')
        return 0
    if not args.task or args.text is None:
        parser.error("--task and --text are needed")
    spark = SparkSession.builder.getOrCreate()
    print(apply_task(spark.createDataFrame([(args.text,)], "text string"), args.task, "text").first()["result"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""The queries of this package's own operators, each over its whole table, and their SQL.

Results are flat rows; places and counts are bigint. Queries without SQL are
rules or models that SQL can't express; tests hold them against plain Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import assets
from ..assets import synthetic
from ..functions import deasciify as D, numbers, sentences, text as T, tokenize as K
from ..models.serve import Assets, Spec, annotated, resolve, sentiment
from ..operators import morphology, profile, sentence_table as S, similarity, stopwords
from ..sources import tsv
from ..streaming.incremental import process_new_files
from . import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# what DuckDB's regular expressions call white space, and the token patterns with it
_W = r"\p{Z}\x09-\x0d\x1c-\x1f\x{85}"
_TREEBANK = rf"[\p{{L}}\p{{N}}_]+(?:[-’/''][\p{{L}}\p{{N}}_]+)*|[^\p{{L}}\p{{N}}_{_W}]"
_WORD_PUNCT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_W}]+"
_CLEAN = rf"coalesce(trim(regexp_replace(text, '[{_W}]+', ' ', 'g')), '')"
_ACCENTS = "coalesce(translate(text, 'âôîêûÂÔÎÊÛ', 'aoieuAOİEU'), '')"
_LOWER = "lower(translate({}, 'İIĞÜÖŞÇ', 'iığüöşç'))"
_TOKENS = f"list_transform(regexp_extract_all({_ACCENTS}, '{_TREEBANK}'), lambda t: replace(t, '’', ''''))"
_ROWS = f"SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def _tokens(c: str = "text") -> Column:
    return K.treebank(T.remove_accents(F.col(c)))


def _rows(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def _shared(spark: SparkSession) -> str:
    """A folder of this run beneath spark.checkpoint.dir; of this machine only where that is unset and there is no cluster."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# text ------------------------------------------------------------------------


@query(f"SELECT doc_id, {_CLEAN} AS sentence FROM documents WHERE length({_CLEAN}) > 0")
def clean_nonempty(spark, sf_dir):
    return S.cleaned(_documents(spark, sf_dir).select("doc_id", F.col("text").alias("sentence")))


@query(f"SELECT doc_id, {_ACCENTS} AS out FROM documents")
def remove_accents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.remove_accents(F.col("text")).alias("out"))


@query(f"SELECT doc_id, {_LOWER.format('text')} AS out FROM documents")
def lower_tr(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.lower_tr(F.col("text")).alias("out"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N} ]', '', 'g') AS out FROM documents")
def strip_punctuation(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.strip_punctuation(F.col("text")).alias("out"))


@query(r"SELECT doc_id, regexp_replace(text, '\p{N}', '0', 'g') AS out FROM documents")
def digits_zero(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.digits_to_zero(F.col("text")).alias("out"))


@query("SELECT doc_id, translate(text, 'İÇĞÜŞÖıçğüşö', 'ICGUSOicguso') AS out FROM documents")
def asciify_tr(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.asciify(F.col("text")).alias("out"))


@query(
    f"""SELECT token, CASE WHEN length(token) > 1 THEN replace(replace(upper(translate(token[1:1], 'İÇĞÜŞÖıçğüşö', 'ICGUSOicguso')), 'ß', 'SS'), 'ẞ', 'SS') || {_LOWER.format('token[2:]')} ELSE token END AS capitalized,
    CASE WHEN length(token) > 0 THEN token[:-2] || translate(token[-1:], 'bBcCdDğĞgG', 'pPçÇtTkKkK') ELSE token END AS softened,
    regexp_replace({_LOWER.format("replace(token, '’', '''')")}, '\\p{{N}}', '0', 'g') AS word,
    translate({_LOWER.format('token')}, 'aeıiuü', 'AAHHHH') AS suffix FROM (SELECT DISTINCT token FROM ({_ROWS}))"""
)
def word_forms(spark, sf_dir):
    token = F.col("token")
    words = _rows(_documents(spark, sf_dir), _tokens(), "doc_id").select("token").distinct()
    return words.select("token", T.capitalize_tr(token).alias("capitalized"), T.soften(token).alias("softened"), T.preprocess_word(token).alias("word"), T.normalize_suffix(token).alias("suffix"))


# tokens ------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, token FROM ({_ROWS})")
def treebank_tokens(spark, sf_dir):
    return _rows(_documents(spark, sf_dir), _tokens(), "doc_id")


@query(
    f"""SELECT page_id, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos FROM
    (SELECT page_id, list_transform(regexp_extract_all(html, '{_TREEBANK}'), lambda t: CASE WHEN t = '’' THEN t ELSE replace(t, '’', '''') END) AS t FROM pages)"""
)
def treebank_legacy_tokens(spark, sf_dir):
    return _rows(_table(spark, sf_dir, "pages"), K.treebank_legacy(F.col("html")), "page_id")


@query(
    f"""SELECT doc_id, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos FROM
    (SELECT doc_id, regexp_extract_all(text, '{_WORD_PUNCT}') AS t FROM documents)"""
)
def wordpunct_tokens(spark, sf_dir):
    return _rows(_documents(spark, sf_dir), K.word_punct(F.col("text")), "doc_id")


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(ceil(n / 40) AS BIGINT) AS n_chunks FROM (SELECT doc_id, len({_TOKENS.replace(_ACCENTS, _ACCENTS.replace('text', _CLEAN))}) AS n FROM documents WHERE length({_CLEAN}) > 0)")
def token_counts(spark, sf_dir):
    """The flagship: the sentence table's preparation, and its sizes."""
    ready = S.prepared(_documents(spark, sf_dir).select("doc_id", F.col("text").alias("sentence")))
    return ready.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.size("tokens_40").cast("bigint").alias("n_chunks"))


@query(f"SELECT doc_id, CAST(pos // 40 AS BIGINT) AS chunk_no, string_agg(token, ' ' ORDER BY pos) AS chunk_text FROM ({_ROWS}) GROUP BY ALL")
def chunk_rows(spark, sf_dir):
    chunks = S.exploded(_documents(spark, sf_dir).select("doc_id", K.bound_chunks(_tokens()).alias("tokens_40")))
    return chunks.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.array_join("chunk", " ").alias("chunk_text"))


@query(f"SELECT d.doc_id, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS text FROM documents d LEFT JOIN ({_ROWS}) t ON d.doc_id = t.doc_id GROUP BY d.doc_id")
def implode_roundtrip(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    chunks = S.exploded(docs.select("doc_id", K.bound_chunks(_tokens()).alias("tokens_40")))
    back = S.with_annotations(docs.select("doc_id"), S.imploded(chunks, "chunk", "chunk_no"), ("doc_id",))
    return back.select("doc_id", F.coalesce(F.array_join("chunk", " "), F.lit("")).alias("text"))


@query(
    f"""SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, token, coalesce(string_agg(token, ' ') OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), '') AS left_ctx,
    coalesce(string_agg(token, ' ') OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING), '') AS right_ctx
    FROM (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations))"""
)
def context_window(spark, sf_dir):
    rows = _rows(_table(spark, sf_dir, "conversations"), _tokens(), "conv_id", "turn")
    return S.context(rows, "token", "pos", ("conv_id", "turn"))


# sentences -----------------------------------------------------------------------


def _sql_text(s: str) -> str:
    return s.replace("'", "''")


_MARKS = "text"
for _rule in sentences.RULES:
    _MARKS = f"regexp_replace({_MARKS}, '{_sql_text(_rule)}', '\\1\n\\2', 'g')"
_END = _sql_text(r"([\p{L}\p{N}\p{M}_.\-]*)(['\")\]%\p{Pf}]*)(\.+)\n?\z")
_ACRONYM = _sql_text(r"\.[\p{Lu}\p{Lo}\-]+\.+\n?\z")
_BEGINS = _sql_text(sentences._BEGINS)


@query(f"SELECT doc_id, {_MARKS} AS text FROM documents")
def sentence_break_rules(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", sentences.break_marks(F.col("text")).alias("text"))


@query(
    f"""SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS s_no FROM (SELECT doc_id, string_split(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(w, lambda x, i: CASE WHEN i < len(w) AND regexp_matches(x, '{_END}')
      AND NOT (regexp_extract(x, '{_END}', 2) = '' AND list_contains(['Av', 'Dr', 'Prof'], regexp_extract(x, '{_END}', 1)))
      AND NOT regexp_matches(x, '{_ACRONYM}') AND regexp_matches(w[i + 1], '{_BEGINS}')
      AND NOT (regexp_extract(x, '{_END}', 2) = '' AND regexp_extract(x, '{_END}', 1) = 'No' AND regexp_matches(w[i + 1], '\\A[0-9]'))
      THEN x || '\n' ELSE x END), ' '), ' +', ' ', 'g'), '\n ', '\n', 'g'), ' \n', '\n', 'g'), '\\A[{_W}]+|[{_W}]+\\z', '', 'g'), '\n') AS s
    FROM (SELECT doc_id, string_split_regex({_MARKS}, ' +') AS w FROM documents WHERE text <> ''))"""
)
def split_sentences(spark, sf_dir):
    with open(assets.path("prefixes.txt"), encoding="utf-8") as f:
        prefixes = sentences.parse_prefixes(f.readlines())
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(sentences.split_sentences(F.col("text"), prefixes)).alias("s_no", "sentence")).withColumn("s_no", F.col("s_no").cast("bigint"))


# numbers, deasciifier -------------------------------------------------------------


def _int_words_sql(n: str) -> str:
    parts = []
    lists = [str(list(x)) for x in (numbers.UNITS, numbers.TENS)]
    for k in range(5, -1, -1):
        g = f"(abs({n}) // {1000**k} % 1000)"
        unit = f"{lists[0]}[{g} % 10 + 1]"
        parts += [f"CASE WHEN {g} // 100 > 1 THEN {lists[0]}[{g} // 100 + 1] ELSE '' END", f"CASE WHEN {g} > 99 THEN 'yüz' ELSE '' END", f"{lists[1]}[{g} // 10 % 10 + 1]"]
        parts.append(f"CASE WHEN {g} = 1 THEN '' ELSE {unit} END" if k == 1 else unit)
        parts.append(f"CASE WHEN {g} > 0 THEN '{numbers.SCALES[k]}' ELSE '' END")
    return f"CASE WHEN {n} = 0 THEN 'sıfır' ELSE array_to_string(list_filter([CASE WHEN {n} < 0 THEN 'eksi' ELSE '' END, {', '.join(parts)}], lambda w: w <> ''), ' ') END"


@query(f"SELECT o_orderkey, {_int_words_sql('o_orderkey')} AS key_words, {_int_words_sql('v')} AS price_words FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN -1000 ELSE 1 END AS v FROM orders)")
def integer_words(spark, sf_dir):
    price = F.round(F.col("o_totalprice") * 100).cast("bigint") * F.when(F.col("o_orderkey") % 2 == 0, -1000).otherwise(1)
    return _table(spark, sf_dir, "orders").select("o_orderkey", numbers.integer_words(F.col("o_orderkey")).alias("key_words"), numbers.integer_words(price).alias("price_words"))


@query()
def deasciify(spark, sf_dir):
    """With a table of 10,000 patterns that are drawn from the documents."""
    docs = _documents(spark, sf_dir)
    table = synthetic.patterns(_rows(docs, _tokens(), "doc_id").select("token"))
    return _rows(docs, D.deasciify(_tokens(), table), "doc_id")


# stop words ------------------------------------------------------------------------

_STOP = ("acaba", "mı", "ya", "da", "neyse", "yerine", "the", "of", "and", "de", "la")


@query(f"SELECT token, count(*) AS cnt FROM ({_ROWS}) GROUP BY token")
def vocab_freq(spark, sf_dir):
    return stopwords.frequencies(_rows(_documents(spark, sf_dir), _tokens(), "doc_id"))


@query(f"SELECT doc_id, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos FROM (SELECT doc_id, list_filter({_TOKENS}, lambda t: t NOT IN {_STOP}) AS t FROM documents)")
def drop_stop_words(spark, sf_dir):
    words = stopwords.read_words(spark, assets.path("stop_words.txt"))
    return _rows(_documents(spark, sf_dir), stopwords.drop(_tokens(), words), "doc_id")


@query(f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, token FROM ({_ROWS}) WHERE token NOT IN {(*_STOP, 'is')}")
def drop_stop_rows(spark, sf_dir):
    words = stopwords.with_words(stopwords.read_words(spark, assets.path("stop_words.txt")), ["is"])
    return stopwords.drop_rows(_rows(_documents(spark, sf_dir), _tokens(), "doc_id"), spark.createDataFrame([(w,) for w in words], "word string")).select("doc_id", "pos", "token")


_COUNTS = f"SELECT token, count(*) AS cnt FROM ({_ROWS}) GROUP BY token"
_FIRST = "CASE WHEN c2 IS NULL THEN NULL ELSE abs((c2 - cnt) / cnt::DOUBLE) END"


@query(
    f"""WITH c AS MATERIALIZED ({_COUNTS}),
    r AS MATERIALIZED (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token DESC) - 1 AS i, lead(cnt) OVER (ORDER BY cnt DESC, token DESC) AS c2 FROM c),
    p AS MATERIALIZED (SELECT *, {_FIRST} AS p1, lead({_FIRST}) OVER (ORDER BY i) AS q1 FROM r),
    s AS MATERIALIZED (SELECT i, CASE WHEN q1 IS NULL THEN NULL WHEN p1 = 0 AND q1 = 0 THEN NULL WHEN p1 = 0 THEN 'inf'::DOUBLE ELSE abs((q1 - p1) / p1) END AS p2 FROM p),
    k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i) - 1 AS k, p2 FROM s WHERE p2 IS NOT NULL),
    cut AS MATERIALIZED (SELECT k + 2 AS size FROM k ORDER BY p2 DESC, k LIMIT 1)
    SELECT token, cnt, 'frequent' AS reason FROM p WHERE i < (SELECT size FROM cut) AND (SELECT count(*) FROM c) >= 3
    UNION ALL SELECT token, cnt, 'rare' FROM c WHERE cnt <= 1"""
)
def dynamic_stop_words(spark, sf_dir):
    return stopwords.detected(stopwords.frequencies(_rows(_documents(spark, sf_dir), _tokens(), "doc_id")), rare=1)


# annotations -------------------------------------------------------------------------

_TAGGED = f"SELECT doc_id, pos, token, CASE WHEN length(token) % 2 = 0 THEN token || '+Noun+A3sg' ELSE token END AS m FROM ({_ROWS})"


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS pos, split_part(m, '+', 1) AS lemma FROM ({_TAGGED}) WHERE contains(m, '+')")
def lemma_project(spark, sf_dir):
    morph = F.transform(_tokens(), lambda t: F.when(F.length(t) % 2 == 0, F.concat(t, F.lit("+Noun+A3sg"))).otherwise(t))
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(S.lemmas(morph)).alias("pos", "lemma")).withColumn("pos", F.col("pos").cast("bigint"))


def _pairs(c: Column) -> Column:
    return F.transform(c, lambda t: F.struct(t.alias("token"), F.when(t.rlike(r"\A\p{Lu}"), "PER").otherwise("O").alias("tag")))


@query(rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN regexp_matches(token, '\A\p{{Lu}}') THEN 'PER' ELSE 'O' END AS tag FROM ({_ROWS})")
def tag_flatten(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(S.tags(_pairs(_tokens()))).alias("pos", "tag")).withColumn("pos", F.col("pos").cast("bigint"))


def _parses(c: Column) -> Column:
    """A head for every token: the one at half its place."""
    return F.transform(c, lambda t, i: F.struct((i + 1).alias("id"), t.alias("word"), F.floor((i + 1) / 2).cast("int").alias("head"), F.when(i == 0, "root").otherwise("dep").alias("rel")))


@query(f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST((pos + 1) // 2 AS INTEGER) AS head, CASE WHEN pos = 0 THEN 'root' ELSE 'dep' END AS rel FROM ({_ROWS})")
def dep_flatten(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(S.heads(_parses(_tokens()))).alias("pos", "d"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "d.head", "d.rel")


@query(f"SELECT doc_id, CAST(least(pos, h - 1) AS BIGINT) AS arc_start, CAST(greatest(pos, h - 1) AS BIGINT) AS arc_end, CASE WHEN pos = 0 THEN 'root' ELSE 'dep' END AS label, CASE WHEN pos > h - 1 THEN 'left' ELSE 'right' END AS dir FROM (SELECT *, (pos + 1) // 2 AS h FROM ({_ROWS})) WHERE h > 0")
def dep_display_arcs(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(S.dep_arcs(_parses(_tokens()))).alias("a"))
    return rows.select("doc_id", F.col("a.start").cast("bigint").alias("arc_start"), F.col("a.end").cast("bigint").alias("arc_end"), "a.label", "a.dir")


_LABELS = "list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 10) AS INTEGER) % 4)"


@query(f"SELECT vec_id, list_min(list_transform(list_distinct(l), lambda v: {{'n': -len(list_filter(l, lambda y: y = v)), 'v': v}})).v AS label FROM (SELECT vec_id, {_LABELS} AS l FROM embeddings)")
def char_mode(spark, sf_dir):
    labels = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 10).cast("int") % 4)
    return _table(spark, sf_dir, "embeddings").select("vec_id", S.lowest_mode(labels).alias("label"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS idx, CAST(list_max(embedding) > 0.5 AS INTEGER) AS positive FROM embeddings")
def argmax_embedding(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", S.argmax(F.col("embedding")).alias("idx"), S.positive(F.array_max("embedding")).alias("positive"))


@query("SELECT vec_id, CAST(list_position(embedding[1:11], list_max(embedding[1:11])) - 1 AS BIGINT) AS arc, CAST(list_position(embedding[12:], list_max(embedding[12:])) - 1 AS BIGINT) AS label FROM embeddings")
def decode_arcs(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", S.decode_arc(F.col("embedding"), 10).alias("d")).select("vec_id", "d.arc", "d.label")


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_filter(['Noun+Prop', 'Num', 'Verb', 'Ques', 'Pron', 'Postp', 'Noun', 'Interj', 'Dup', 'Det', 'Conj', 'Adverb', 'Adj'], lambda n, i: (flag >> (13 - i)) & 1 = 1), ' ') AS tags FROM (SELECT *, CAST(l_partkey % 8192 AS INTEGER) AS flag FROM lineitem)")
def flag_decode(spark, sf_dir):
    flag = (F.col("l_partkey") % 8192).cast("int")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(T.decode_flags(flag), " ").alias("tags"))


# profiles, joins, sources ----------------------------------------------------------------

_PROFILE = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{s}' AS stat, CASE WHEN v = 0 THEN 0.0 ELSE round(v, 4) END AS value FROM (SELECT CAST({v.format(c)} AS DOUBLE) AS v FROM lineitem)"
        for c in _PROFILE
        for s, v in zip(profile.STATS, ("count({0})", "avg({0}::DOUBLE)", "stddev_samp({0}::DOUBLE)", "min({0})", "quantile_cont({0}::DOUBLE, 0.25)", "quantile_cont({0}::DOUBLE, 0.5)", "quantile_cont({0}::DOUBLE, 0.75)", "max({0})"))
    )
)
def profile_numeric(spark, sf_dir):
    return profile.numeric_profile(_table(spark, sf_dir, "lineitem"), *_PROFILE).withColumn("value", F.round("value", 4))


@query(f"SELECT source, count(*) AS total_sentences, CAST(sum(len({_TOKENS})) AS BIGINT) AS total_tokens, round(avg(n_chars), 6) AS avg_sentiment FROM documents GROUP BY source")
def run_report(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("tokens", _tokens())
    return profile.run_report(docs, "source", "tokens", "n_chars").withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query(f"SELECT d.doc_id, l.quality, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_join(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.size(_tokens()).cast("bigint").alias("n_tokens"))
    return S.with_annotations(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"), ("doc_id",))


_LINES = r"SELECT CAST(doc_id AS VARCHAR) AS t_code, unnest(l) AS sentence, generate_subscripts(l, 1) AS s_no FROM (SELECT doc_id, string_split_regex(replace(text, chr(9), ' '), '\r\n|\r|\n') AS l FROM documents)"


def _as_lines(spark, sf_dir) -> DataFrame:
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\t"), F.lit(" ")), r"\r\n|\r|\n")).alias("s", "sentence"))
    return lines.select(F.col("doc_id").cast("string").alias("t_code"), F.lit(1).alias("ch_no"), F.lit(1).alias("p_no"), (F.col("s") + 1).alias("s_no"), "sentence")


@query(f"SELECT t_code, 1::BIGINT AS ch_no, 1::BIGINT AS p_no, CAST(s_no AS BIGINT) AS s_no, nullif(sentence, '') AS sentence FROM ({_LINES})")
def tsv_scan(spark, sf_dir):
    """Documents' lines written as sentence TSV, and read back; empty ones are null then."""
    path = _shared(spark)
    tsv.write_lines(_as_lines(spark, sf_dir), path)
    return tsv.read_sentences(spark, path)


@query(f"SELECT t_code, CAST(s_no AS BIGINT) AS s_no, nullif(sentence, '') AS sentence FROM ({_LINES})")
def incremental_files(spark, sf_dir):
    """The same through the file stream, which takes each file once."""
    path = _shared(spark)
    tsv.write_lines(_as_lines(spark, sf_dir), f"{path}/in")
    for _ in range(2):
        process_new_files(spark, f"{path}/in", f"{path}/out", f"{path}/state", lambda df: df.drop("file"))
    return spark.read.parquet(f"{path}/out").select("t_code", "s_no", "sentence")


# analyser and models ---------------------------------------------------------------------


@query()
def morph_candidates(spark, sf_dir):
    """With a dictionary of 20,000 stems and 400 suffixes that is drawn from the documents."""
    words = _rows(_documents(spark, sf_dir), _tokens(), "doc_id").select("token").distinct()
    d = synthetic.dictionaries(words)
    found = morphology.analysed(words, d).select("token", F.posexplode("candidates").alias("k", "c"))
    return found.select("token", F.col("k").cast("bigint").alias("k"), "c.root", "c.suffix", morphology.joined_tags(F.col("c.root"), F.col("c.tags")).alias("analysis"))


def _sentences(spark, sf_dir) -> DataFrame:
    """Models take far longer than a shuffle of their texts: a table of fewer partitions than there are cores is spread."""
    raw, cores = _table(spark, sf_dir, "conversations"), spark.sparkContext.defaultParallelism
    if raw.rdd.getNumPartitions() < cores:
        raw = raw.repartition(cores)
    turns = raw.select(F.col("conv_id").cast("string").alias("t_code"), F.lit(1).cast("bigint").alias("ch_no"), F.lit(1).cast("bigint").alias("p_no"), F.col("turn").cast("bigint").alias("s_no"), F.col("text").alias("sentence"))
    return S.prepared(turns)


def _model(name: str, variant: str | None = None):
    def run(spark, sf_dir):
        models = resolve([f"{name}:{variant}" if variant else name])
        out = {"stemmer": "morph"}.get(name, name)
        rows = annotated(_sentences(spark, sf_dir), {name: models[name]}).select("t_code", "s_no", F.posexplode(out).alias("pos", "x"))
        fields = [F.col("x").alias("morph")] if name == "stemmer" else ["x.*"]
        return rows.select("t_code", "s_no", F.col("pos").cast("bigint").alias("pos"), *fields)

    run.__name__ = f"{name}_{variant}" if variant else name
    return run


for _name, _variant in (("stemmer", None), ("pos", "context"), ("pos", "tree"), ("ner", "context"), ("ner", "characters"), ("dep", "context"), ("dep", "tree")):
    query()(_model(_name, _variant))


@query()
def sentiment_scores(spark, sf_dir):
    p = sentiment(Spec("sentiment", "recurrent", Assets()), F.col("no_accents"))
    return _sentences(spark, sf_dir).select("t_code", "s_no", p.alias("p")).select("t_code", "s_no", F.round("p", 5).alias("p"), S.positive(F.col("p")).alias("positive"))


@query()
def sentence_pipeline(spark, sf_dir):
    from .sentence_pipeline import annotate

    out = annotate(_sentences(spark, sf_dir), resolve(["stemmer", "pos", "ner", "dep", "sentiment"]))
    return out.select("t_code", "s_no", F.size("tokens").cast("bigint").alias("n_tokens"), *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("morph", "lemma", "pos", "ner", "dep")], F.round("sentiment", 5).alias("sentiment"))


# annotations by fold, vectors, dictionaries ------------------------------------------------

_SPAN = "STRUCT(s BIGINT, e BIGINT, l VARCHAR)[]"
_CLOSED = "CASE WHEN a.label = 'O' THEN a.ents ELSE list_append(a.ents, {'s': a.b, 'e': a.at, 'l': a.label}) END"
_BARE_TOKENS = f"list_transform(regexp_extract_all(text, '{_TREEBANK}'), lambda t: replace(t, '’', ''''))"


@query(
    rf"""WITH i AS (SELECT item_id, text, list_prepend({{'tok': '', 'tag': 'O', 'at': 0::BIGINT, 'b': 0::BIGINT, 'label': 'O', 'ents': []::{_SPAN}}},
      list_transform({_BARE_TOKENS}, lambda t: {{'tok': t, 'tag': CASE WHEN regexp_matches(t, '\A\p{{Lu}}') THEN 'PER' ELSE 'O' END, 'at': 0::BIGINT, 'b': 0::BIGINT, 'label': 'O', 'ents': []::{_SPAN}}})) AS t FROM benchmark),
    f AS (SELECT item_id, list_reduce(t, lambda a, x: CASE WHEN instr(substr(text, a.at + 1), x.tok) = 0 THEN a ELSE {{'tok': x.tok, 'tag': x.tag,
      'at': a.at + instr(substr(text, a.at + 1), x.tok) - 1 + length(x.tok), 'b': CASE WHEN x.tag = a.label AND x.tag <> 'O' THEN a.b ELSE a.at + instr(substr(text, a.at + 1), x.tok) - 1 END,
      'label': x.tag, 'ents': CASE WHEN x.tag = a.label THEN a.ents ELSE {_CLOSED} END}} END) AS a FROM i),
    s AS (SELECT item_id, unnest({_CLOSED}) AS x FROM f)
    SELECT item_id, CAST(x.s AS BIGINT) AS span_start, CAST(x.e AS BIGINT) AS span_end, x.l AS label FROM s"""
)
def ner_display_spans(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(S.ner_display(F.col("text"), _pairs(K.treebank(F.col("text"))))["ents"]).alias("e"))
    return rows.select("item_id", F.col("e.start").cast("bigint").alias("span_start"), F.col("e.end").cast("bigint").alias("span_end"), "e.label")


@query(
    """SELECT query, vec_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM
    (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 5"""
)
def nearest_vectors(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return similarity.most_similar(vectors, vectors, k=5).withColumn("similarity", F.round("similarity", 6))


def _inline(name: str) -> str:
    """A dictionary of the package as VALUES."""
    with open(assets.path(name), encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if "\t" in line]
    return ", ".join("(" + ", ".join("'" + _sql_text(x) + "'" for x in r) + ")" for r in rows)


_FIRST_TAG = "CASE WHEN string_split_regex(tag, '[+^]')[2] IN ('Prop', 'Time') THEN array_to_string(string_split_regex(tag, '[+^]')[1:2], '+') ELSE string_split_regex(tag, '[+^]')[1] END"


@query(
    f"""WITH v AS (SELECT DISTINCT token FROM ({_ROWS})), t AS (SELECT DISTINCT suffix, tag FROM (VALUES {_inline("suffixes.tsv")}) x(suffix, tag)),
    e AS (SELECT token, unnest(range(0, 4)) AS n FROM v), c AS (SELECT DISTINCT token, CASE WHEN n = 0 THEN 'null' ELSE right(token, n) END AS suffix FROM e WHERE length(token) > n)
    SELECT token, CASE WHEN suffix = 'null' THEN '' ELSE suffix END AS suffix, tag FROM c JOIN t USING (suffix) WHERE {_FIRST_TAG} IN ('Noun', 'Verb')"""
)
def suffix_tags(spark, sf_dir):
    """Every tag that an ending of up to three letters, or none, gives to a word as noun or verb."""
    words = _rows(_documents(spark, sf_dir), _tokens(), "doc_id").select("token").distinct()
    ends = words.select("token", F.explode(F.expr("transform(sequence(0, 3), n -> if(length(token) > n, if(n = 0, '', right(token, n)), null))")).alias("suffix")).where("suffix is not null").distinct()
    found = morphology.suffix_tags(ends.withColumn("pos", F.array(F.lit("Noun"), F.lit("Verb"))), morphology.read_suffixes(spark, assets.path("suffixes.tsv")))
    return found.select("token", "suffix", "tag")


_FLAG_NAMES = "['Noun+Prop', 'Num', 'Verb', 'Ques', 'Pron', 'Postp', 'Noun', 'Interj', 'Dup', 'Det', 'Conj', 'Adverb', 'Adj']"


@query(
    f"""SELECT 'suffix' AS kind, suffix AS entry, tag AS "value" FROM (SELECT DISTINCT * FROM (VALUES {_inline("suffixes.tsv")}) x(suffix, tag))
    UNION ALL SELECT DISTINCT 'stem', stem, v FROM (SELECT stem, unnest(list_filter({_FLAG_NAMES}, lambda n, i: (flag::INTEGER >> (13 - i)) & 1 = 1)) AS v FROM (VALUES {_inline("stems.tsv")}) x(stem, flag))
    UNION ALL SELECT 'exact', word, unnest(string_split(a, ' ')) FROM (VALUES {_inline("exact.tsv")}) x(word, a)"""
)
def dictionary_tables(spark, sf_dir):
    """The analyser's three dictionaries as they are loaded, a row for each value of an entry."""
    loaded = (("suffix", morphology.read_suffixes, "suffixes.tsv"), ("stem", morphology.read_stems, "stems.tsv"), ("exact", morphology.read_exact, "exact.tsv"))
    first, *rest = (_entries(kind, read(spark, assets.path(name))) for kind, read, name in loaded)
    for df in rest:
        first = first.union(df)
    return first


def _entries(kind: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("entry"), F.explode(df.columns[1]).alias("value"))


_ROOT_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T._ROOTS.items())


@query(f"SELECT token, CASE {_LOWER.format('token')} {_ROOT_CASES} ELSE {_LOWER.format('token')} END AS root FROM (SELECT DISTINCT token FROM ({_ROWS}))")
def root_forms(spark, sf_dir):
    words = _rows(_documents(spark, sf_dir), _tokens(), "doc_id").select("token").distinct()
    return words.select("token", T.transform_root(T.lower_tr(F.col("token"))).alias("root"))


_WHOLE = r"^[0-9]+(_[0-9]+)*([eE][0-9]+(_[0-9]+)*)?$"


@query(
    f"""SELECT doc_id, unnest(w) AS token, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos FROM (
    SELECT doc_id, flatten(list(w ORDER BY pos)) AS w FROM (SELECT doc_id, pos, CASE WHEN v < 1e18 THEN string_split({_int_words_sql('CAST(trunc(v) AS BIGINT)')}, ' ') ELSE [token] END AS w
      FROM (SELECT *, CASE WHEN regexp_matches(token, '{_WHOLE}') THEN try_cast(replace(token, '_', '') AS DOUBLE) END AS v FROM ({_ROWS}))) GROUP BY doc_id)"""
)
def numbers_to_words(spark, sf_dir):
    return _rows(_documents(spark, sf_dir), numbers.number_words(_tokens()), "doc_id")


# the whole pipeline, repaired files, tasks -------------------------------------------------


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens FROM documents")
def length_sorted(spark, sf_dir):
    return S.by_length(_documents(spark, sf_dir).withColumn("tokens", _tokens())).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))


@query(f"SELECT conv_id::VARCHAR AS t_code, turn AS s_no, {_CLEAN} AS sentence, CAST(len({_TOKENS.replace(_ACCENTS, _ACCENTS.replace('text', _CLEAN))}) AS BIGINT) AS n_tokens FROM conversations WHERE length({_CLEAN}) > 0")
def pipeline_run(spark, sf_dir):
    """Turns as a TSV file, through the whole pipeline to a table on disk; scores depend on weights and aren't compared."""
    from .sentence_pipeline import Pipeline

    path = _shared(spark)
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.lit(1).alias("ch_no"), F.lit(1).alias("p_no"), "turn", T.clean(F.col("text")).alias("sentence"))
    tsv.write_lines(turns, f"{path}/in")
    out = Pipeline(["sentiment"]).run(spark, f"{path}/in", f"{path}/out")
    return out.select("t_code", "s_no", "sentence", F.size("tokens").cast("bigint").alias("n_tokens"))


@query(r"SELECT 'novel' || (item_id % 4) AS t_code, 1::BIGINT AS ch_no, item_id AS p_no, 1::BIGINT AS s_no, regexp_replace(text, '[\t\r\n]', ' ', 'g') AS sentence FROM benchmark")
def repaired_files(spark, sf_dir):
    """Items in files of four columns, which get their code from the file's name."""
    folder = f"{_shared(spark)}/novels"

    def write(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        lines: dict[int, list[str]] = {}
        for batch in batches:
            for k, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                lines.setdefault(k, []).append(f"1\t{i}\t1\t{t}\n")
        for k, own in lines.items():
            with files.open_output_stream(f"{path}/novel{k}_sentence-split-corrected.csv") as out:
                out.write("".join(own).encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int64())], ["k"])

    items = _table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("k"), "item_id", F.regexp_replace("text", "[\t\r\n]", " "))
    items.repartition("k").mapInArrow(write, "k long").collect()
    return tsv.read_repaired(spark, folder)


_CHAINS = {"dep:tree": "stemmer:morph pos:tree dep:tree", "pos": "pos:context", "pos:tree": "stemmer:morph pos:tree", "ner:characters sentiment": "ner:characters sentiment:recurrent", "dep pos:tree": "stemmer:morph pos:tree dep:context"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _CHAINS.items()) + ") x(asked, loaded)")
def model_dependencies(spark, sf_dir):
    rows = [(asked, " ".join(f"{m}:{v}" for m, v in resolve(asked.split(" ")).items())) for asked in _CHAINS]
    return spark.createDataFrame(rows, "asked string, loaded string")


_TASK_WORDS = f"list_filter(string_split({_CLEAN}, ' '), lambda t: t <> '')"
_TASK_SQL = {
    "lower_case": _LOWER.format("text"),
    "remove_punctuations": r"regexp_replace(text, '[^\p{L}\p{N} ]', '', 'g')",
    "remove_accent_marks": _ACCENTS,
    "drop_stop_words": f"array_to_string(list_filter({_TASK_WORDS}, lambda t: t NOT IN {_STOP}), ' ')",
}


def _task(name: str):
    def run(spark, sf_dir):
        out = tasks.apply_task(_table(spark, sf_dir, "benchmark"), name, "text")
        kind = out.schema["result"].dataType.typeName()
        return out.select("item_id", F.to_json("result").alias("result") if kind in ("array", "struct") else F.col("result"))

    run.__name__ = f"task_{name}"
    return run


for _name in tasks.NAMES:
    query(f"SELECT item_id, {_TASK_SQL[_name]} AS result FROM benchmark" if _name in _TASK_SQL else None)(_task(_name))

"""The catalogue: a query for each operator, with its oracle SQL where SQL can express it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.functions import tensor, text as T
from paralex.operators import batching, compare, encode, increment, metrics, monitor, registry, replay, terms, validate, vocabulary
from paralex.operators.tables import shared_dir, written
from paralex.plans import views as V
from paralex.sources import readers, sinks
from paralex.streaming import events as stream
from paralex.streaming import stopping
from paralex.streaming.sink import EventSink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RULES = validate.Rules(check_markup=False)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.line_pairs(spark, sf_dir)


# ---------------------------------------------------------------- text and validation


@query(f"SELECT doc_id, {V.SQL_COLLAPSE.format('nfc_normalize(text)')} AS normal FROM documents")
def normalize_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@query(f"WITH {V.SQL_PAIRS} SELECT ord, CASE WHEN {V.SQL_EMPTY} THEN 'empty,missing_value' ELSE concat_ws(',', CASE WHEN {V.SQL_LENGTH} THEN 'length' END, CASE WHEN {V.SQL_RATIO} > 3.0 THEN 'length_ratio' END) END AS reasons FROM pairs")
def stateless_reasons(spark, d):
    return pairs(spark, d).select("ord", F.array_join(validate.row_reasons(RULES), ",").alias("reasons"))


@query(f"SELECT signature, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, {V.SQL_SIGNATURE.format('text')} AS signature FROM documents) GROUP BY signature HAVING count(*) > 1")
def near_dup_groups(spark, d):
    # grouped by a digest: the signature itself, as long as a text, is carried once a partition and group
    rows = V.table(spark, d, "documents").select("doc_id", T.signature(F.col("text")).alias("signature"))
    out = rows.groupBy(F.sha2("signature", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("signature").alias("signature"))
    return out.where("n > 1").select("signature", "n", "first")


SQL_SPLITS = f"splits AS (SELECT doc_id, b, {V.SQL_SPLIT} AS split FROM (SELECT doc_id, {V.SQL_BUCKET.format(V.SQL_SIGNATURE.format('text'), 42)} AS b FROM documents WHERE text IS NOT NULL))"


def _split(spark, d):
    docs = V.table(spark, d, "documents").where(F.col("text").isNotNull()).withColumnRenamed("source", "origin").withColumnRenamed("text", "source")
    return validate.split(docs)


@query(f"WITH {SQL_SPLITS} SELECT doc_id, b AS bucket, split FROM splits")
def hash_split(spark, d):
    return _split(spark, d).select("doc_id", "bucket", "split")


@query(f"WITH {SQL_SPLITS} SELECT n.split, count(s.split) AS rows FROM (VALUES ('train'), ('validation'), ('test')) n(split) LEFT JOIN splits s USING (split) GROUP BY n.split")
def split_sizes(spark, d):
    return validate.split_sizes(_split(spark, d))


# every round accepts the rows that are the earliest left for both sides, until none is left
SQL_ACCEPTED = f"""RECURSIVE {V.SQL_PAIRS}, walk AS (
 SELECT 0 AS k, ord, source, target, FALSE AS won FROM pairs WHERE NOT {V.SQL_EMPTY} AND NOT {V.SQL_LENGTH} AND NOT {V.SQL_RATIO} > 3.0
 UNION ALL
 SELECT k + 1, ord, source, target, won FROM (
  SELECT *, bool_or(won) OVER (PARTITION BY source) AS s_gone, bool_or(won) OVER (PARTITION BY target) AS t_gone FROM (
   SELECT k, ord, source, target, ord = min(ord) OVER (PARTITION BY source) AND ord = min(ord) OVER (PARTITION BY target) AS won FROM walk WHERE NOT won))
 WHERE won OR NOT (s_gone OR t_gone)),
accepted AS MATERIALIZED (SELECT ord, source, target FROM walk WHERE won)"""
SQL_REASONS = f"""{SQL_ACCEPTED}, judged AS (SELECT p.ord, p.doc_id, p.source, p.target, CASE WHEN p.source = '' OR p.target = '' THEN 'empty,missing_value' ELSE concat_ws(',',
 CASE WHEN s.target = p.target THEN 'duplicate_pair' END, CASE WHEN s.ord IS NOT NULL THEN 'source_duplicate' END, CASE WHEN s.target <> p.target THEN 'conflicting_translation' END,
 CASE WHEN t.ord IS NOT NULL THEN 'target_duplicate' END, CASE WHEN t.source <> p.source AND NOT coalesce(s.target <> p.target, FALSE) THEN 'conflicting_translation' END,
 CASE WHEN {V.SQL_LENGTH.replace('source', 'p.source').replace('target', 'p.target')} THEN 'length' END, CASE WHEN {V.SQL_RATIO.replace('source', 'p.source').replace('target', 'p.target')} > 3.0 THEN 'length_ratio' END) END AS reasons
 FROM pairs p LEFT JOIN accepted s ON s.source = p.source AND s.ord < p.ord LEFT JOIN accepted t ON t.target = p.target AND t.ord < p.ord)"""


@query(f"WITH {SQL_ACCEPTED} SELECT ord, source, target FROM accepted")
def greedy_accept(spark, d):
    rows = pairs(spark, d).where(F.size(validate.row_reasons(RULES)) == 0)
    return validate.greedy_accept(rows)


@query(f"WITH {SQL_REASONS} SELECT ord, reasons FROM judged")
def reject_reasons(spark, d):
    return validate.validate(pairs(spark, d), RULES).select("ord", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {SQL_REASONS} SELECT ord, reasons FROM judged")
def incremental_reasons(spark, d):
    """The pairs of two thirds of the documents, and then the others as incoming: the same as judging all at once."""
    rows = pairs(spark, d)
    first = F.col("doc_id") < 2 * (rows.agg(F.max("doc_id")).first()[0] or 0) // 3
    past = increment.Accepted(spark, _folder(spark, "accepted"))
    parts = [past.take(x, RULES) for x in (rows.where(first), rows.where(~first))]
    return parts[0].unionByName(parts[1]).select("ord", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"WITH {SQL_REASONS} SELECT count(*) AS total_rows, count(*) FILTER (reasons = '') AS accepted_rows, count(*) FILTER (reasons <> '') AS rejected_rows, "
    + ", ".join(f"count(*) FILTER (list_contains(string_split(reasons, ','), '{code}')) AS {name}" for code, name in validate.COUNTERS.items())
    + " FROM judged"
)
def validation_report(spark, d):
    return validate.report(validate.validate(pairs(spark, d), RULES))


MARKUP = [("<b>x</b>", True), ("<br/>", True), ("plain", True), ("a < b", False), ("<b><i>x</b></i>", False), ("<br>", False), ("</a/>", False), ("x > y", False), ("<a href='x'>y</a> <c/>", True), ("</b>", False)]


@query(f"WITH {V.values('v', 'snippet, balanced', MARKUP)} SELECT snippet AS key, balanced FROM v UNION ALL SELECT page_id::VARCHAR, FALSE FROM pages WHERE html IS NOT NULL")
def markup_balance(spark, d):
    """Literal snippets, and all pages (each of which leaves a void element or a doctype open)."""
    literal = spark.createDataFrame([(s,) for s, _ in MARKUP], "key string").withColumn("x", F.col("key"))
    pages = V.table(spark, d, "pages").where(F.col("html").isNotNull()).select(F.col("page_id").cast("string").alias("key"), F.col("html").alias("x"))
    return literal.union(pages).select("key", T.markup_balanced(F.col("x")).alias("balanced"))


def _sql_recall(pattern: str) -> str:
    e, c = f"regexp_extract_all(source, '{pattern}')", f"regexp_extract_all(target, '{pattern}')"
    return f"CASE WHEN len({e}) = 0 THEN 1.0 ELSE list_sum(list_transform(list_distinct({e}), lambda v: least(len(list_filter({e}, lambda y: y = v)), len(list_filter({c}, lambda y: y = v)))))::DOUBLE / len({e}) END"


def _sql_script(x: str) -> str:
    letters = ", ".join(f"{{'s': '{name}', 'l': list_filter(regexp_extract_all({x}, '\\p{{{cls[2:]}}}'), lambda c: regexp_matches(c, '\\p{{L}}'))}}" for name, cls in T.SCRIPT_CLASSES.items())
    found = f"list_transform([{letters}], lambda k: {{'n': len(k.l), 'first': -strpos({x}, k.l[1]), 'script': k.s}})"
    return f"list_max(list_filter({found}, lambda k: k.n > 0)).script"


@query(f"SELECT doc_id, {_sql_script('text')} AS script FROM documents")
def dominant_script(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.dominant_script(F.col("text")).alias("script"))


@query(f"WITH {V.SQL_PAIRS} SELECT CASE WHEN {V.SQL_EMPTY} THEN 'empty,missing_value' WHEN coalesce({_sql_script('source')} NOT IN ('Latn', 'Grek'), FALSE) OR coalesce({_sql_script('target')} NOT IN ('Cyrl'), FALSE) THEN 'language_mismatch' ELSE '' END AS reasons, ord FROM pairs")
def script_reasons(spark, d):
    """The script rule: most targets are not in the script that is asked for; those without letters pass."""
    rules = validate.Rules(0, 1 << 30, 1 << 30, 1e9, check_markup=False, check_script=True, source_scripts=["Latn", "Grek"], target_scripts=["Cyrl"])
    return pairs(spark, d).select("ord", F.array_join(validate.row_reasons(rules), ",").alias("reasons"))


# without look-around: every character outside words is put between two marks, which the pattern then asks for
SQL_NUMBER_PARTS = "\x03(?:\x02[+-]\x03)?(?:\\p{Nd}(?:\\p{Nd}|\x02[ ,.''’]\x03)*\\p{Nd}|\\p{Nd})(?:\x02[.,]\x03\\p{Nd}+)?\x02"


def _sql_numbers(x: str) -> str:
    marked = f"'\x03' || regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_])', '\x02\\1\x03', 'g') || '\x02'"
    return f"list_transform(regexp_extract_all({marked}, '{SQL_NUMBER_PARTS}'), lambda v: replace(replace(v, '\x02', ''), '\x03', ''))"


@query(
    f"WITH {V.SQL_PAIRS}, n AS (SELECT ord, {_sql_numbers('source')} AS e, {_sql_numbers('target')} AS c FROM (SELECT ord, source || ' no. 7 of -1,200.5 (7)' AS source, target || ' 7/7, x-1 1,200.5' AS target FROM pairs)) "
    "SELECT ord, list_sum(list_transform(list_distinct(e), lambda v: least(len(list_filter(e, lambda y: y = v)), len(list_filter(c, lambda y: y = v)))))::DOUBLE / len(e) AS recall FROM n"
)
def numbers_recall(spark, d):
    """All pairs, with some numbers put after both sides."""
    s, t = F.concat("source", F.lit(" no. 7 of -1,200.5 (7)")), F.concat("target", F.lit(" 7/7, x-1 1,200.5"))
    return pairs(spark, d).select("ord", T.preservation(s, t, T.NUMBER).alias("recall"))


SQL_PLACEHOLDER = T.PLACEHOLDER.replace("'", "''")


@query(f"WITH {V.SQL_PAIRS} SELECT ord, {_sql_recall(SQL_PLACEHOLDER)} AS recall FROM (SELECT ord, source || ' {{name}} %s %s' AS source, target || ' %s' AS target FROM pairs)")
def placeholder_recall(spark, d):
    s, t = F.concat("source", F.lit(" {name} %s %s")), F.concat("target", F.lit(" %s"))
    return pairs(spark, d).select("ord", T.preservation(s, t, T.PLACEHOLDER).alias("recall"))


SQL_MARKUP = T.MARKUP


@query(f"SELECT page_id, {_sql_recall(SQL_MARKUP)} AS recall FROM (SELECT page_id, html AS source, substr(html, 1, length(html) // 2) AS target FROM pages WHERE html IS NOT NULL)")
def markup_recall(spark, d):
    pages = V.table(spark, d, "pages").where(F.col("html").isNotNull())
    half = F.expr("substring(html, 1, length(html) div 2)")
    return pages.select("page_id", T.preservation(F.col("html"), half, T.MARKUP).alias("recall"))


@query(f"WITH {V.SQL_PAIRS} SELECT ord, {_sql_recall(T.PUNCTUATION)} AS recall FROM pairs")
def punctuation_recall(spark, d):
    return pairs(spark, d).select("ord", T.preservation(F.col("source"), F.col("target"), T.PUNCTUATION).alias("recall"))


@query(f"WITH {V.SQL_PAIRS} SELECT ord, source = target AS equal FROM pairs")
def exact_match(spark, d):
    return pairs(spark, d).select("ord", T.exact_match(F.col("source"), F.col("target")).alias("equal"))


# ---------------------------------------------------------------- aggregates


@query(f"WITH {V.SQL_PAIRS}, w AS (SELECT {V.SQL_WORDS.format('source')} AS s, {V.SQL_WORDS.format('target')} AS t FROM pairs) SELECT round(avg(s), 6) AS source_mean_words, round(avg(t), 6) AS target_mean_words, sum(s)::BIGINT AS source_words, sum(t)::BIGINT AS target_words, round(sum(t)::DOUBLE / greatest(1, sum(s)), 6) AS ratio FROM w")
def length_stats(spark, d):
    w = pairs(spark, d).select(T.word_count(F.col("source")).alias("s"), T.word_count(F.col("target")).alias("t"))
    return w.agg(F.round(F.avg("s"), 6).alias("source_mean_words"), F.round(F.avg("t"), 6).alias("target_mean_words"), F.sum("s").alias("source_words"), F.sum("t").alias("target_words"), F.round(F.sum("t") / F.greatest(F.lit(1), F.sum("s")), 6).alias("ratio"))


SQL_NUMBER_RECALL = f"list_transform([{{{{'e': {_sql_numbers('source')}, 'c': {_sql_numbers('target')}}}}}], lambda k: CASE WHEN len(k.e) = 0 THEN 1.0 ELSE list_sum(list_transform(list_distinct(k.e), lambda v: least(len(list_filter(k.e, lambda y: y = v)), len(list_filter(k.c, lambda y: y = v)))))::DOUBLE / len(k.e) END)[1]".replace("{{", "{").replace("}}", "}")


@query(f"WITH {V.SQL_PAIRS} SELECT round(avg((source = target)::INT), 6) AS exact_match, round(avg({SQL_NUMBER_RECALL}), 6) AS number_accuracy, round(avg({_sql_recall(T.PUNCTUATION)}), 6) AS punctuation_accuracy, round(avg({_sql_recall(SQL_PLACEHOLDER)}), 6) AS placeholder_accuracy, round(avg({_sql_recall(SQL_MARKUP)}), 6) AS markup_accuracy, count(*) AS sentence_count FROM pairs")
def metric_macro(spark, d):
    out = metrics.text_metrics(pairs(spark, d).select("source", F.col("source").alias("reference"), F.col("target").alias("candidate")))
    names = ["exact_match", "number_accuracy", "punctuation_accuracy", "placeholder_accuracy", "markup_accuracy"]
    return out.select(*(F.round(n, 6).alias(n) for n in names), "sentence_count")


TERMS = [("the", ["of", "And"]), ("de", ["la"]), ("Große", ["klein"]), ("der", ["die", "das"])]


@query(
    f"WITH {V.SQL_PAIRS}, terms(term, forms) AS (VALUES {', '.join('(' + repr(t) + ', ' + repr(f) + ')' for t, f in TERMS)}), "
    f"folded AS MATERIALIZED (SELECT {V.SQL_FOLD.format('source')} AS source, {V.SQL_FOLD.format('target')} AS target FROM pairs), "
    "hits AS (SELECT len(list_filter(forms, lambda f: contains(target, replace(lower(f), 'ß', 'ss')))) > 0 AS ok FROM folded JOIN terms ON contains(source, replace(lower(term), 'ß', 'ss'))) "
    "SELECT count(*) FILTER (ok) AS matched, count(*) AS total, round(coalesce(count(*) FILTER (ok)::DOUBLE / nullif(count(*), 0), 1.0), 9) AS accuracy FROM hits"
)
def terminology(spark, d):
    dictionary = spark.createDataFrame(TERMS, "term string, forms array<string>")
    out = terms.terminology(pairs(spark, d).select("source", F.col("target").alias("candidate")), dictionary)
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query(
    f"WITH {V.SQL_PAIRS}, w AS (SELECT doc_id, unnest(string_split(source, ' ')) AS term, target FROM pairs), "
    f"terms AS (SELECT {V.SQL_FOLD.format('term')} AS term, list(DISTINCT {V.SQL_FOLD.format('form')}) AS forms FROM (SELECT term, min(string_split(target, ' ')[1]) AS form FROM w WHERE length(term) >= 11 GROUP BY term) GROUP BY ALL), "
    f"folded AS MATERIALIZED (SELECT ord, {V.SQL_FOLD.format('source')} AS source, {V.SQL_FOLD.format('target')} AS target FROM pairs), "
    "hits AS (SELECT ord, term, len(list_filter(forms, lambda f: contains(target, f))) > 0 AS ok FROM folded JOIN terms ON contains(source, term)) "
    "SELECT count(*) FILTER (ok) AS matched, count(*) AS total, round(coalesce(count(*) FILTER (ok)::DOUBLE / nullif(count(*), 0), 1.0), 9) AS accuracy FROM hits"
)
def terminology_learned(spark, d):
    """A dictionary that grows with the corpus: each long word of the sources, with the least word that begins a target
    beside it."""
    rows = pairs(spark, d)
    words = rows.select(F.explode(F.split("source", " ")).alias("term"), F.element_at(F.split("target", " "), 1).alias("form")).where(F.length("term") >= 11)
    least = words.groupBy("term").agg(F.min("form").alias("form"))
    dictionary = least.groupBy(T.casefold(F.col("term")).alias("term")).agg(F.collect_set(T.casefold(F.col("form"))).alias("forms"))
    out = terms.terminology(rows.select("source", F.col("target").alias("candidate")), dictionary)
    return out.withColumn("accuracy", F.round("accuracy", 9))


def _sql_13a(x: str) -> str:
    for a, b in (("<skipped>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"' ' || {x} || ' '"
    for p, r in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def _sql_grams(x: str, n: int, glue: str) -> str:
    return f"list_transform(range(1, greatest(1, len({x}) - {n - 2})), lambda i: array_to_string({x}[i:i + {n - 1}], '{glue}'))"


def _sql_shared(n: int, glue: str) -> str:
    g = f"g{n} AS (SELECT id, unnest({_sql_grams('c', n, glue)}) AS gram, 1 AS c, 0 AS r FROM toks UNION ALL SELECT id, unnest({_sql_grams('r', n, glue)}), 0, 1 FROM toks)"
    return f"{g}, m{n} AS (SELECT coalesce(sum(least(c, r)), 0)::BIGINT AS n FROM (SELECT sum(c) AS c, sum(r) AS r FROM g{n} GROUP BY id, gram))"


@query(
    f"WITH {V.SQL_PAIRS}, toks AS MATERIALIZED (SELECT ord AS id, {_sql_13a('target')} AS c, {_sql_13a('source')} AS r FROM pairs), "
    + ", ".join(_sql_shared(n, " ") for n in range(1, 5))
    + " SELECT sum(len(c))::BIGINT AS candidate_length, sum(len(r))::BIGINT AS reference_length, "
    + ", ".join(f"(SELECT n FROM m{n}) AS match_{n}, sum(greatest(0, len(c) - {n - 1}))::BIGINT AS total_{n}" for n in range(1, 5))
    + " FROM toks"
)
def bleu_stats(spark, d):
    return metrics.bleu_statistics(pairs(spark, d).select(F.col("target").alias("candidate"), F.col("source").alias("reference")))


@query(
    rf"WITH {V.SQL_TURNS}, toks AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, string_split(regexp_replace(target, '\s', '', 'g'), '') AS c, string_split(regexp_replace(source, '\s', '', 'g'), '') AS r FROM turns), "
    + ", ".join(_sql_shared(n, "") for n in range(1, 7))
    + " SELECT "
    + ", ".join(f"(SELECT n FROM m{n}) AS match_{n}, sum(greatest(0, len(c) - {n - 1}))::BIGINT AS candidate_{n}, sum(greatest(0, len(r) - {n - 1}))::BIGINT AS reference_{n}" for n in range(1, 7))
    + " FROM toks"
)
def chrf_stats(spark, d):
    return metrics.chrf_statistics(V.turns(spark, d).select(F.col("target").alias("candidate"), F.col("source").alias("reference")))


def _sql_bleu() -> str:
    """BLEU of a row of sums, orders without a match smoothed by halves."""
    zeros = lambda n: " + ".join(f"(match_{k} = 0)::INT" for k in range(1, n + 1))
    logs = " + ".join(f"ln(CASE WHEN match_{n} = 0 THEN 100.0 / (pow(2, {zeros(n)}) * total_{n}) ELSE 100.0 * match_{n} / total_{n} END)" for n in range(1, 5))
    none = " AND ".join(f"match_{n} = 0" for n in range(1, 5)) + " OR " + " OR ".join(f"total_{n} = 0" for n in range(1, 5))
    return f"CASE WHEN {none} THEN 0.0 ELSE least(1.0, exp(1 - reference_length / candidate_length)) * exp(({logs}) / 4) END"


def _sql_chrf() -> str:
    mean = lambda side: "list_avg([" + ", ".join(f"match_{n} / {side}_{n}" for n in range(1, 7)) + "])"
    return f"500.0 * {mean('candidate')} * {mean('reference')} / (4 * {mean('candidate')} + {mean('reference')})"


@query(f"WITH RECURSIVE stats AS ({ORACLE['bleu_stats']}) SELECT round({_sql_bleu()}, 6) AS bleu FROM stats")
def bleu_score(spark, d):
    return metrics.with_bleu(bleu_stats(spark, d)).select(F.round("bleu", 6).alias("bleu"))


@query(f"WITH stats AS ({ORACLE['chrf_stats']}) SELECT round({_sql_chrf()}, 6) AS chrf FROM stats")
def chrf_score(spark, d):
    return metrics.with_chrf(chrf_stats(spark, d)).select(F.round("chrf", 6).alias("chrf"))


@query()
def ter_score(spark, d):
    return metrics.ter(V.turns(spark, d).select(F.col("target").alias("candidate"), F.col("source").alias("reference")))


@query(f"WITH {V.SQL_RUNS} SELECT round(sum(loss * step) / sum(step), 6) AS loss, round(exp(least(sum(loss * step) / sum(step), 50)), 3) AS perplexity FROM runs")
def token_weighted_loss_whole(spark, d):
    """Over all events."""
    out = metrics.weighted_loss(V.runs(spark, d), "loss", "step")
    return out.select(F.round("loss", 6).alias("loss"), F.round("perplexity", 3).alias("perplexity"))


@query(f"WITH {V.SQL_RUNS} SELECT round(sum((event = 'click')::INT)::DOUBLE / greatest(1, count(*)), 9) AS unknown_token_rate FROM runs")
def unknown_rate(spark, d):
    rows = V.runs(spark, d).select((F.col("event") == "click").cast("int").alias("u"), F.lit(1).alias("g"))
    return metrics.unknown_rate(rows, "u", "g").select(F.round("unknown_token_rate", 9).alias("unknown_token_rate"))


# ---------------------------------------------------------------- replay

SQL_NEW = "new AS (SELECT * FROM pairs p WHERE doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM pairs o WHERE o.doc_id % 3 <> 0 AND o.source = p.source AND o.target = p.target)), history AS (SELECT * FROM pairs WHERE doc_id % 3 <> 0)"


def _replay(spark, d):
    """Every pair is current (one third of the documents) or its parent's (the rest)."""
    rows = pairs(spark, d)
    history = rows.where("doc_id % 3 <> 0")
    return replay.new_rows(rows.where("doc_id % 3 = 0"), history).select(rows.columns), history


@query(f"WITH {V.SQL_PAIRS}, {SQL_NEW} SELECT ord, source, target FROM new")
def new_data_antijoin(spark, d):
    return _replay(spark, d)[0].select("ord", "source", "target")


@query(f"WITH {V.SQL_PAIRS}, {SQL_NEW} SELECT ord FROM history h WHERE EXISTS (SELECT 1 FROM new n WHERE n.domain = h.domain AND n.domain <> '')")
def domain_pool_semi_whole(spark, d):
    """With the domains of all new rows."""
    new, history = _replay(spark, d)
    return replay.domain_pool(history, new).select("ord")


def _sql_mixture(count: str, pool: str = "history") -> str:
    return f"WITH {V.SQL_PAIRS}, {SQL_NEW} SELECT ord, FALSE AS replayed FROM new UNION ALL SELECT ord, TRUE FROM (SELECT ord FROM {pool} ORDER BY sha256('7:' || ord), ord LIMIT ({count}))"


def _mixture(spark, d, strategy, **options):
    new, history = _replay(spark, d)
    return replay.mixture(new, history, strategy, 7, "ord", **options)[0].select("ord", "replayed")


@query(_sql_mixture("SELECT count(*) FROM new"))
def replay_balanced(spark, d):
    return _mixture(spark, d, "balanced")


@query(_sql_mixture("SELECT round_even(count(*) * (0.3 / 0.7), 0)::BIGINT FROM new"))
def replay_percentage(spark, d):
    return _mixture(spark, d, "percentage", new_ratio=0.7, history_ratio=0.3)


@query(_sql_mixture("SELECT round_even(count(*) * (0.2 / 0.8), 0)::BIGINT FROM new"))
def replay_weighted(spark, d):
    return _mixture(spark, d, "weighted", new_ratio=0.8, history_ratio=0.2)


@query(_sql_mixture("SELECT 100"))
def replay_fixed(spark, d):
    return _mixture(spark, d, "fixed_count", fixed=100)


@query(_sql_mixture("SELECT count(*) FROM new", "(SELECT * FROM history WHERE domain IN (SELECT domain FROM new))"))
def replay_domain_aware(spark, d):
    return _mixture(spark, d, "domain_aware")


@query(f"WITH {V.SQL_PAIRS}, {SQL_NEW}, n AS (SELECT count(*) AS n FROM new) SELECT 'replay' AS mode, 'balanced' AS strategy, n AS new_examples, (SELECT count(*) FROM history) AS available_historical_examples, n AS sampled_historical_examples, 2 * n AS training_examples, 0.5::DOUBLE AS effective_new_fraction, FALSE AS catastrophic_forgetting_warning FROM n")
def replay_report(spark, d):
    new, history = _replay(spark, d)
    report = replay.mixture(new, history, "balanced", 7, "ord")[1]
    return spark.createDataFrame([tuple(report.values())], "mode string, strategy string, new_examples long, available_historical_examples long, sampled_historical_examples long, training_examples long, effective_new_fraction double, catastrophic_forgetting_warning boolean")


@query(f"WITH {V.SQL_PAIRS} SELECT ord, row_number() OVER (ORDER BY sha256('7:' || ord), ord) - 1 AS position FROM pairs")
def seeded_shuffle(spark, d):
    return replay.shuffled(pairs(spark, d), 7, "ord").select("ord", "position")


# ---------------------------------------------------------------- sources


@query("SELECT u.conv_id, u.turn AS pos, u.text AS source, v.text AS target FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id + 1 AND v.turn = u.turn")
def align_lines(spark, d):
    c = V.table(spark, d, "conversations")
    left = c.select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("source"))
    right = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turn").alias("pos"), F.col("text").alias("target"))
    return left.join(right, ["conv_id", "pos"])


@query(f"WITH {V.SQL_TURNS} SELECT conv_id, turn, target AS source, source AS target FROM turns")
def reverse_direction(spark, d):
    return encode.reversed_direction(V.turns(spark, d)).select("conv_id", "turn", "source", "target")


@query("SELECT event_id, props, json_valid(props) AS sound FROM events")
def json_props_scan(spark, d):
    sound = F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False))
    return V.table(spark, d, "events").select("event_id", "props", F.when(F.col("props").isNotNull(), sound).alias("sound"))


@query(f"WITH {V.SQL_PAIRS} SELECT unnest([source, target]) AS value FROM pairs")
def corpus_interleave(spark, d):
    return sinks.interleaved(pairs(spark, d), "ord")


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(rf"WITH {V.SQL_TURNS}, flat AS (SELECT conv_id, turn, {V.SQL_COLLAPSE.format('source')} AS source, {V.SQL_COLLAPSE.format('target')} AS target FROM turns WHERE source IS NOT NULL AND target IS NOT NULL) SELECT row_number() OVER (ORDER BY conv_id, turn) AS row_number, source, target FROM flat")
def parallel_text_files(spark, d):
    """Turns written as line files, a folder a side, and read back aligned by number."""
    rows = V.turns(spark, d).where("source IS NOT NULL AND target IS NOT NULL")
    rows = rows.select(F.struct("conv_id", "turn").alias("o"), *(T.collapse(F.col(c)).alias(c) for c in ("source", "target")))
    root = _folder(spark, "lines")
    for side in ("source", "target"):
        sinks.write_lines(rows, f"{root}/{side}", "o", side)
    return readers.read_parallel_text(spark, root, "source", "target").select("row_number", "source", "target")


SQL_UNLINED = r"regexp_replace(coalesce(text, ''), '[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', '', 'g')"


def _delimited(spark, rows, delimiter, name, columns, header=None):
    """A folder of delimited files: every cell quoted, line ends kept in cells, in the order of conversations."""
    cells = (F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns)
    lines = rows.select(F.struct("conv_id", "turn").alias("o"), F.concat_ws(delimiter, *cells).alias("line"))
    if header:
        lines = spark.createDataFrame([((-1, -1), header)], lines.schema).unionByName(lines)
    root = _folder(spark, "delimited")
    sinks.write_lines(lines, f"{root}/{name}", "o", "line")
    return root


@query(f"SELECT row_number() OVER (ORDER BY conv_id, turn) AS row_number, {SQL_UNLINED} AS source, coalesce(role, '') AS target, conv_id::VARCHAR AS domain FROM conversations")
def tsv_records(spark, d):
    """Conversations written as TSV with line ends in quoted cells, and read back in blocks."""
    root = _delimited(spark, V.table(spark, d, "conversations"), "\t", "turns.tsv", ["text", "role", "conv_id"])
    return readers.read_tsv(spark, root, "turns.tsv").select("row_number", "source", "target", "domain")


@query(f"""SELECT row_number() OVER (ORDER BY conv_id, turn) + 1 AS row_number, {SQL_UNLINED} AS source, coalesce(role, '') AS target, '{{"conv_id": "' || conv_id || '", "turn": "' || turn || '"}}' AS metadata FROM conversations""")
def csv_records(spark, d):
    rows = V.table(spark, d, "conversations")
    root = _delimited(spark, rows, ",", "turns.csv", ["turn", "text", "conv_id", "role"], "turn,source_text,conv_id,target_text")
    return readers.read_csv(spark, root, "turns.csv").select("row_number", "source", "target", "metadata")


@query(f"WITH {V.SQL_TURNS} SELECT target AS source, source AS target, 'conversation' AS origin, conv_id * 1000 + turn AS row_number, NULL::VARCHAR AS domain FROM turns")
def platform_records(spark, d):
    """Records written as JSON Lines and reloaded in the other direction."""
    rows = V.turns(spark, d).select("source", "target", F.lit("conversation").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_number"), F.lit(None).cast("string").alias("domain"))
    path = _folder(spark, "records")
    sinks.json_lines(rows).write.text(path)
    return readers.read_records(spark, path, reverse=True)


def _log(spark, d, files=None):
    """The events as a log of JSON Lines, in which every tenth line is torn; files: dealt over so many."""
    rows = V.runs(spark, d).select(F.col("run").cast("string").alias("run"), "step", "event", "loss")
    path = _folder(spark, "log")
    torn = F.when(F.col("step") % 10 == 0, F.substr("value", F.lit(1), F.length("value") - 2)).otherwise(F.col("value"))
    lines = rows.select("step", F.to_json(F.struct("run", "step", "event", "loss")).alias("value")).select(torn.alias("value"))
    (lines.repartition(files, "value") if files else lines).write.text(path)
    return path


SQL_LOG = f"{V.SQL_RUNS}, log AS (SELECT run::VARCHAR AS run, step, event, loss FROM runs WHERE step % 10 <> 0)"


@query(f"WITH {SQL_LOG} SELECT * FROM log")
def event_log_read(spark, d):
    """Lines that can't be decoded are skipped."""
    return readers.read_events(spark, _log(spark, d), "run string, step long, event string, loss double")


def _streamed(rows, name):
    """What a stream gives until its input is used up."""
    path = _folder(rows.sparkSession, name)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query(f"WITH {SQL_LOG} SELECT * FROM log")
def event_log_tail(spark, d):
    return _streamed(stream.tail(spark, _log(spark, d)), "tail").select("run", "step", "event", "loss")


@query(f"WITH {SQL_LOG} SELECT run, max(step) AS step, arg_max(event, step) AS event, arg_max(loss, step) AS loss FROM log GROUP BY run")
def event_sink(spark, d):
    """The log as a stream of several batches into the sink, one of which comes twice; the last events it keeps."""
    sink = EventSink(spark, _folder(spark, "sink"))
    rows = stream.tail(spark, _log(spark, d, files=4), maxFilesPerTrigger=1).select("run", "step", "event", "loss")
    sink.start(rows, availableNow=True).awaitTermination()
    sink.write(sink.events(), 0)  # a batch taken before
    return sink.last()


SQL_STOPS = f"""WITH {V.SQL_RUNS.replace('FROM events', 'FROM events WHERE event_id % 10 <> 0')},
b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY run ORDER BY step) AS n FROM runs),
s AS (SELECT run, step, min(loss) OVER (PARTITION BY run ORDER BY step) AS best, n - max(CASE WHEN before IS NULL OR loss < before THEN n END) OVER (PARTITION BY run ORDER BY step) AS streak FROM b),
f AS (SELECT run, min(step) AS stop FROM s WHERE streak >= 5 GROUP BY run), e AS (SELECT s.run, s.step AS stop, s.best FROM s JOIN f ON f.run = s.run AND f.stop = s.step)
SELECT s.run::VARCHAR AS run, s.step, CASE WHEN s.step >= e.stop THEN e.best ELSE s.best END AS best, CASE WHEN s.step >= e.stop THEN 5 ELSE s.streak END::INT AS streak, coalesce(s.step >= e.stop, FALSE) AS stopped FROM s LEFT JOIN e USING (run)"""


@query(SQL_STOPS)
def early_stopping_stream(spark, d):
    """Early stopping with state over the log as a stream; a run's state stays as it was when it stopped."""
    return _streamed(stream.early_stopping(stream.tail(spark, _log(spark, d)), 5), "stops")


@query(SQL_STOPS)
def early_stopping_late(spark, d):
    """The same of a log whose lines are dealt over files at random; the stream is stopped after half of them and
    started again from its checkpoint."""
    from pyspark.sql import Window as W

    rows = V.table(spark, d, "events").where("event_id % 10 <> 0")
    rows = rows.select(F.col("user_id").cast("string").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("number"), F.col("event_id").alias("step"), F.col("event_type").alias("event"), F.col("value").alias("loss"), F.col("ts").alias("timestamp"))
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    half = F.xxhash64("value") % 2 == 0
    path, out = _folder(spark, "shuffled-log"), _folder(spark, "late-stops")
    stopping.stateful(spark)
    lines = written(lines, "lines")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 2)  # a batch, of two for each half
    for part in (half, ~half):
        lines.where(part).repartition(2 * files, "value").write.mode("append").text(path)
        events = stream.tail(spark, path, "run string, number long, step long, event string, loss double, timestamp timestamp", maxFilesPerTrigger=files)
        stops = stopping.early_stopping_late(events, 5, "1000 days")
        stops.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stops.schema).parquet(out)


@query(f"WITH {V.SQL_TURNS} SELECT to_json({{'conv_id': conv_id, 'source': source, 'target': target, 'turn': turn}}) AS value FROM turns")
def json_lines(spark, d):
    return sinks.json_lines(V.turns(spark, d))


# ---------------------------------------------------------------- monitoring


@query(f"WITH {V.SQL_RUNS} SELECT run, max(step) AS step, arg_max(event, step) AS event, arg_max(loss, step) AS loss FROM runs GROUP BY run")
def latest_event(spark, d):
    return monitor.latest(V.runs(spark, d), "run", "step")


SQL_BEST = f"""{V.SQL_RUNS}, b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY run ORDER BY step) AS n FROM runs),
i AS (SELECT *, before IS NULL OR loss < before AS improved FROM b),
s AS (SELECT run, step, improved, min(loss) OVER (PARTITION BY run ORDER BY step) AS best, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY run ORDER BY step) AS streak FROM i)"""


@query(f"WITH {SQL_BEST} SELECT run, step, improved, best, streak::INT AS streak FROM s")
def best_so_far(spark, d):
    return monitor.best_so_far(V.runs(spark, d), "run", "step", "loss").select("run", "step", "improved", "best", F.col("streak").cast("int").alias("streak"))


@query(f"WITH {SQL_BEST} SELECT run, min(step) FILTER (streak >= 5) AS stop FROM s GROUP BY run")
def early_stop_step(spark, d):
    return monitor.early_stop(V.runs(spark, d), "run", "step", "loss", 5)


@query(f"WITH {V.SQL_RUNS} SELECT run, step, round(sum(loss) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 4) AS running_loss FROM runs")
def running_totals(spark, d):
    out = monitor.running_totals(V.runs(spark, d), "run", "step", "loss")
    return out.select("run", "step", F.round("running_loss", 4).alias("running_loss"))


@query(f"WITH {V.SQL_RUNS} SELECT event, count(*) AS n, count(DISTINCT run) AS runs, round(avg(loss), 6) AS mean_loss FROM runs GROUP BY event")
def event_type_summary(spark, d):
    return V.runs(spark, d).groupBy("event").agg(F.count("*").alias("n"), F.countDistinct("run").alias("runs"), F.round(F.avg("loss"), 6).alias("mean_loss"))


@query(f"WITH {V.SQL_RUNS} SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) > 3 AS deleted FROM runs")
def retention_topk(spark, d):
    return monitor.retained(V.runs(spark, d), 3, F.desc("step"), by="run").select("run", "step", "deleted")


@query(f"WITH {V.SQL_RUNS} SELECT run, step FROM runs ORDER BY step DESC, run LIMIT 20")
def newest_n(spark, d):
    return V.runs(spark, d).orderBy(F.desc("step"), "run").limit(20).select("run", "step")


@query(f"WITH {V.SQL_RUNS} SELECT run, step, step % 10 = 0 AS log, step % 25 = 0 AS checkpoint FROM runs")
def step_triggers(spark, d):
    return V.runs(spark, d).select("run", "step", monitor.every(F.col("step"), 10).alias("log"), monitor.every(F.col("step"), 25).alias("checkpoint"))


# ---------------------------------------------------------------- registry and comparison


def _registry(spark, d):
    """A registry of the event table's versions, the last approved one of which is promoted."""
    out = registry.Registry(spark, _folder(spark, "registry"))
    added = V.versions(spark, d)
    out.add(added)
    out.promote(added.where("status = 'approved'").agg(F.max_by("version_id", "step")).first()[0])
    return out


@query(f"WITH {V.SQL_VERSIONS} SELECT version_id, row_number() OVER (ORDER BY major, minor) AS place FROM versions")
def semver_sort(spark, d):
    rows = V.versions(spark, d).withColumn("number", T.semver(F.col("version_id")))
    return replay.numbered(rows, "number", "version_id").select("version_id", (F.col("position") + 1).alias("place"))


@query(f"WITH {V.SQL_VERSIONS} SELECT major::INT AS parent, 'v' || major || '.' || (max(minor) + 1) || '.0' AS label FROM versions GROUP BY major UNION ALL SELECT NULL, 'v' || (max(major) + 1) || '.0.0' FROM versions")
def semver_allocate(spark, d):
    return registry.free_labels(_registry(spark, d).versions())


@query(
    f"WITH {V.SQL_VERSIONS}, names AS (SELECT DISTINCT 'v' || (user_id + 1) || '.' || (event_id % 30) || '.0' AS name FROM events UNION ALL SELECT 'production') "
    "SELECT name, CASE WHEN name = 'production' THEN (SELECT id FROM production) ELSE version_id END AS version_id FROM names LEFT JOIN versions ON version_label = name"
)
def resolve_alias(spark, d):
    """Labels asked for by all events, of versions that exist or don't, and the one in production."""
    held = _registry(spark, d)
    asked = V.runs(spark, d).select(F.format_string("v%d.%d.0", F.col("run") + 1, F.col("step") % 30).alias("name")).distinct()
    return registry.resolved(held.versions(), asked.unionByName(spark.createDataFrame([("production",)], "name string")), held.production())


@query(f"WITH RECURSIVE {V.SQL_VERSIONS}, up AS (SELECT version_id, version_id AS ancestor, 0 AS depth FROM versions UNION ALL SELECT up.version_id, v.parent_version, depth + 1 FROM up JOIN versions v ON v.version_id = up.ancestor WHERE v.parent_version IS NOT NULL) SELECT * FROM up")
def lineage(spark, d):
    return registry.ancestry(_registry(spark, d).versions())


SQL_FIRST = f"{V.SQL_VERSIONS}, chosen AS (SELECT arg_min(version_id, step) AS chosen FROM added WHERE status = 'approved')"


@query(f"WITH {SQL_FIRST} SELECT version_id, CASE WHEN version_id = chosen THEN 'production' WHEN version_id = id THEN 'approved' ELSE status END AS status, protected OR version_id = chosen AS protected FROM versions, chosen, production")
def promote(spark, d):
    """The first approved version takes the place of the last."""
    held = _registry(spark, d)
    held.promote(V.versions(spark, d).where("status = 'approved'").agg(F.min_by("version_id", "step")).first()[0])
    return held.versions().select("version_id", "status", "protected")


@query(f"WITH {SQL_FIRST} SELECT version_id, CASE WHEN version_id = chosen AND version_id <> id THEN 'approved' ELSE status END AS status, protected OR version_id = chosen AS protected FROM versions, chosen, production")
def rollback(spark, d):
    """The first approved version is promoted, and then the one before gone back to, by its label."""
    held = _registry(spark, d)
    was = held.production()
    held.promote(V.versions(spark, d).where("status = 'approved'").agg(F.min_by("version_id", "step")).first()[0])
    held.rollback(was.rpartition("-")[2])
    return held.versions().select("version_id", "status", "protected")


@query(f"WITH {V.SQL_VERSIONS} SELECT status, protected, count(*) AS versions, count(*) FILTER (status IN ('approved', 'production')) AS promotable, count(*) FILTER (status IN ('approved', 'production', 'archived') OR protected) AS returnable FROM versions GROUP BY ALL")
def version_eligibility(spark, d):
    v = _registry(spark, d).versions()
    status = F.col("status")
    return v.groupBy("status", "protected").agg(
        F.count("*").alias("versions"),
        F.count_if(status.isin(*registry.PROMOTABLE)).alias("promotable"),
        F.count_if(status.isin(*registry.RETURNABLE) | F.col("protected")).alias("returnable"),
    )


SQL_METRICS = f"""{V.SQL_PAIRS}, per AS (SELECT domain, row_number % 2 AS half, avg({V.SQL_WORDS.format('source')}) AS words, avg(length(target)) AS chars FROM pairs GROUP BY ALL),
tidy AS (SELECT domain, half, 'words' AS metric, words AS value FROM per UNION ALL SELECT domain, half, 'chars', chars FROM per)"""


@query(f"WITH {SQL_METRICS} SELECT a.domain, a.metric, round(a.value, 6) AS a, round(b.value, 6) AS b, round(b.value - a.value, 6) AS delta FROM tidy a JOIN tidy b USING (domain, metric) WHERE a.half = 0 AND b.half = 1")
def metric_delta(spark, d):
    per = pairs(spark, d).groupBy("domain", (F.col("row_number") % 2).alias("half")).agg(F.avg(T.word_count(F.col("source"))).alias("words"), F.avg(F.length("target")).alias("chars"))
    tidy = per.unpivot(["domain", "half"], ["words", "chars"], "metric", "value")
    out = compare.metric_deltas(tidy.where("half = 0").drop("half"), tidy.where("half = 1").drop("half"), "domain")
    return out.select("domain", "metric", *(F.round(c, 6).alias(c) for c in ("a", "b", "delta")))


LIMITS = {"minimum_chrf_change": 0.0, "maximum_bleu_regression": 0.5, "maximum_number_accuracy_regression": 0.1, "maximum_placeholder_accuracy_regression": 0.0}
SQL_GATES = f"""{V.SQL_PAIRS}, scored AS (SELECT domain, row_number % 2 AS half, avg({_sql_recall(T.PUNCTUATION)}) * 100 AS bleu, avg(least(length(source), length(target)) / greatest(1, length(source), length(target))) * 100 AS chrf, avg({_sql_recall("[0-9]+")}) AS number_accuracy, avg({_sql_recall(SQL_PLACEHOLDER)}) AS placeholder_accuracy FROM pairs GROUP BY ALL),
tidy AS (UNPIVOT scored ON bleu, chrf, number_accuracy, placeholder_accuracy INTO NAME metric VALUE value), {V.values('rules', '"check", metric, sgn, least, required', [(c, m, s, least, LIMITS[c]) for c, m, s, least in compare.GATES])},
g AS (SELECT a.domain, "check", sgn * (b.value - a.value) AS actual, required, least FROM rules JOIN tidy a USING (metric) JOIN tidy b ON b.metric = a.metric AND b.domain IS NOT DISTINCT FROM a.domain WHERE a.half = 0 AND b.half = 1),
gates AS (SELECT domain, "check", round(actual, 6) + 0.0 AS actual, required::DOUBLE AS required, CASE WHEN least THEN actual >= required ELSE actual <= required END AS passed FROM g)"""


def _scores(spark, d):
    """Scores of each language's odd pairs (1) and even ones (0), as if of two versions."""
    s, t = F.col("source"), F.col("target")
    alike = F.least(F.length(s), F.length(t)) / F.greatest(F.lit(1), F.length(s), F.length(t))
    means = {"bleu": T.preservation(s, t, T.PUNCTUATION) * 100, "chrf": alike * 100, "number_accuracy": T.preservation(s, t, "[0-9]+"), "placeholder_accuracy": T.preservation(s, t, T.PLACEHOLDER)}
    per = pairs(spark, d).groupBy("domain", (F.col("row_number") % 2).alias("half")).agg(*(F.avg(v).alias(k) for k, v in means.items()))
    tidy = written(per.unpivot(["domain", "half"], list(means), "metric", "value"), "scores")
    return [tidy.where(F.col("half") == k).drop("half") for k in (0, 1)]


@query(f'WITH {SQL_GATES} SELECT domain, "check", actual, required, passed FROM gates WHERE domain IS NOT NULL')
def promotion_gates(spark, d):
    return compare.gates(*_scores(spark, d), LIMITS, "domain").withColumn("actual", F.round("actual", 6) + 0.0)


@query(f"WITH {SQL_GATES} SELECT domain, bool_and(passed) AS passed FROM gates WHERE domain IS NOT NULL GROUP BY domain")
def all_gates(spark, d):
    return compare.all_passed(compare.gates(*_scores(spark, d), LIMITS, "domain"), "domain")


SQL_ENDS = "ends AS (SELECT user_id, min_by(props, event_id) AS a, max_by(props, event_id) AS b, min_by(event_type, event_id) AS ta, max_by(event_type, event_id) AS tb FROM events GROUP BY user_id)"


@query(f"WITH {SQL_ENDS}, paths AS (SELECT user_id || '.props.k' AS path, json_extract_string(a, '$.k') AS version_a, json_extract_string(b, '$.k') AS version_b FROM ends UNION ALL SELECT user_id || '.type', ta, tb FROM ends) SELECT * FROM paths WHERE version_a IS DISTINCT FROM version_b")
def config_diff(spark, d):
    """Settings of each run's first and last event, flattened."""
    events = V.table(spark, d, "events")

    def flat(pick):
        one = events.groupBy("user_id").agg(pick(F.struct("props", "event_type"), "event_id").alias("e"))
        leaves = F.create_map(F.concat("user_id", F.lit(".props.k")), F.get_json_object("e.props", "$.k"), F.concat("user_id", F.lit(".type")), F.col("e.event_type"))
        return one.select(F.explode(leaves).alias("path", "value"))

    return compare.config_difference(flat(F.min_by), flat(F.max_by))


@query(f"WITH {V.SQL_PAIRS} SELECT ord, source AS candidate_a, target AS candidate_b FROM pairs WHERE source <> target")
def changed_outputs(spark, d):
    rows = pairs(spark, d)
    return compare.changed_outputs(rows.select("ord", F.col("source").alias("candidate")), rows.select("ord", F.col("target").alias("candidate")), "ord")


@query("WITH v AS (SELECT user_id AS id, list(DISTINCT event_type || event_id % 7) FILTER (event_id % 2 = 0) AS a, list(DISTINCT event_type || event_id % 7) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY user_id) SELECT id, list_sort(list_intersect(a, b)) AS common, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS only_b FROM v")
def version_sets(spark, d):
    """What each run's even events and its odd ones have in common."""
    kind = F.concat("event_type", (F.col("event_id") % 7).cast("string"))
    of = lambda half: F.collect_set(F.when(F.col("event_id") % 2 == half, kind))
    rows = V.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(of(0).alias("a"), of(1).alias("b"))
    return compare.dataset_sets(rows).select("id", "common", "only_a", "only_b")


@query(f"WITH {V.SQL_VERSIONS}, ds AS (SELECT lang AS dataset_version, count(*) AS dataset_rows FROM documents GROUP BY lang), tk AS (SELECT source AS tokenizer_version, sum(n_chars)::BIGINT AS vocabulary FROM documents GROUP BY source) SELECT event_id AS experiment_id, status, dataset_rows, vocabulary FROM events LEFT JOIN versions ON version_id = 'aa-bb-aa-to-bb-v' || (user_id + 1) || '.' || (event_id % 30) || '.0' LEFT JOIN documents ON doc_id = user_id LEFT JOIN ds ON lang = dataset_version LEFT JOIN tk ON source = tokenizer_version")
def manifest_join(spark, d):
    """Each event as an experiment with its version, and a dataset and a tokenizer by the document of its run's number."""
    docs = V.table(spark, d, "documents")
    named = V.table(spark, d, "events").join(docs.select(F.col("doc_id").alias("user_id"), F.col("lang").alias("dataset_version"), F.col("source").alias("tokenizer_version")), "user_id", "left")
    experiments = named.select(F.col("event_id").alias("experiment_id"), F.format_string("aa-bb-aa-to-bb-v%d.%d.0", F.col("user_id") + 1, F.col("event_id") % 30).alias("version_id"), "dataset_version", "tokenizer_version")
    datasets = docs.groupBy(F.col("lang").alias("dataset_version")).agg(F.count("*").alias("dataset_rows"))
    tokenizers = docs.groupBy(F.col("source").alias("tokenizer_version")).agg(F.sum("n_chars").alias("vocabulary"))
    out = compare.manifest(experiments, _registry(spark, d).versions(), datasets, tokenizers)
    return out.select("experiment_id", "status", "dataset_rows", "vocabulary")


# ---------------------------------------------------------------- batching and tensors

BUDGET = 4096


def _lengths(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.greatest(F.lit(1), T.word_count(F.coalesce("text", F.lit("")))).cast("long").alias("length"))


@query(
    rf"""WITH RECURSIVE l AS (SELECT doc_id, greatest(1, {V.SQL_WORDS.format("t")})::BIGINT AS length FROM (SELECT doc_id, {V.SQL_COLLAPSE.format("coalesce(text, '')")} AS t FROM documents)),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY length, doc_id) AS n FROM l),
walk AS (SELECT n, doc_id, length, 0::BIGINT AS batch_id, 1::BIGINT AS held FROM o WHERE n = 1 UNION ALL
 SELECT o.n, o.doc_id, o.length, CASE WHEN o.length * (w.held + 1) * 2 > {BUDGET} THEN w.batch_id + 1 ELSE w.batch_id END, CASE WHEN o.length * (w.held + 1) * 2 > {BUDGET} THEN 1 ELSE w.held + 1 END FROM walk w JOIN o ON o.n = w.n + 1)
SELECT doc_id, length, batch_id FROM walk"""
)
def token_batches_sorted(spark, d):
    return batching.sorted_batches(_lengths(spark, d), "length", "doc_id", BUDGET)


@query(
    rf"""WITH l AS (SELECT doc_id, greatest(1, {V.SQL_WORDS.format("t")})::BIGINT AS length FROM (SELECT doc_id, {V.SQL_COLLAPSE.format("coalesce(text, '')")} AS t FROM documents)),
o AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) - 1 AS place FROM l)
SELECT doc_id, place // 100 AS pool, row_number() OVER (PARTITION BY place // 100 ORDER BY length, place) - 1 AS position FROM o"""
)
def length_pools(spark, d):
    return batching.length_pools(_lengths(spark, d), "length", "doc_id", 7).select("doc_id", "pool", F.col("position").cast("long").alias("position"))


@query(
    rf"""WITH RECURSIVE l AS (SELECT doc_id, greatest(1, {V.SQL_WORDS.format("t")})::BIGINT AS length FROM (SELECT doc_id, {V.SQL_COLLAPSE.format("coalesce(text, '')")} AS t FROM documents)),
p AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) - 1 AS place FROM l),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY place // 100, length, place) AS n FROM p),
walk AS (SELECT n, doc_id, length, 0::BIGINT AS batch_id, 1::BIGINT AS held, length AS longest FROM o WHERE n = 1 UNION ALL
 SELECT o.n, o.doc_id, o.length, CASE WHEN greatest(o.length, w.longest) * (w.held + 1) * 2 > {BUDGET} THEN w.batch_id + 1 ELSE w.batch_id END,
  CASE WHEN greatest(o.length, w.longest) * (w.held + 1) * 2 > {BUDGET} THEN 1 ELSE w.held + 1 END,
  CASE WHEN greatest(o.length, w.longest) * (w.held + 1) * 2 > {BUDGET} THEN o.length ELSE greatest(o.length, w.longest) END FROM walk w JOIN o ON o.n = w.n + 1),
t AS (SELECT batch_id, row_number() OVER (ORDER BY sha256('7:' || batch_id), batch_id) - 1 AS turn FROM (SELECT DISTINCT batch_id FROM walk))
SELECT doc_id, length, batch_id, turn FROM walk JOIN t USING (batch_id)"""
)
def token_batches_shuffled(spark, d):
    return batching.shuffled_batches(_lengths(spark, d), "length", "doc_id", BUDGET, 7)


SQL_WHOLE = r"lens AS (SELECT doc_id, doc_id // 10 AS batch, list_transform(string_split({0}, ' '), lambda w: length(w)::INT) AS ids FROM documents WHERE text IS NOT NULL)".replace("{0}", V.SQL_COLLAPSE.format("text"))


@query(f"WITH {SQL_WHOLE}, w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM lens), p AS (SELECT doc_id, list_concat(ids, list_transform(range(0, m - len(ids)), lambda i: 0)) AS padded, m FROM w) SELECT doc_id, padded AS source_padded, padded[1:m - 1] AS target_in, padded[2:m] AS target_out FROM p")
def pad_and_shift_whole(spark, d):
    """All words of every text, in batches of ten documents."""
    docs = V.table(spark, d, "documents").where(F.col("text").isNotNull())
    ids = F.transform(F.split(T.collapse(F.col("text")), " "), F.length)
    rows = docs.select("doc_id", F.expr("doc_id div 10").alias("batch"), ids.alias("ids"))
    return tensor.pad_and_shift(rows, "batch", "ids", "ids").select("doc_id", "source_padded", "target_in", "target_out")


SQL_LOGP = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT vec_id, label, x, list_transform(x, lambda v: v - (ln(list_sum(list_transform(x, lambda u: exp(u - list_max(x))))) + list_max(x))) AS lp FROM x)"


@query(f"WITH {SQL_LOGP} SELECT vec_id, list_position(x, list_max(x)) - 1 AS best, round(lp[1], 9) AS first, round(list_sum(list_transform(lp, lambda v: exp(v))), 9) AS total, list_transform(list_sort(list_transform(range(1, len(x) + 1), lambda i: {{'v': -x[i], 'i': i - 1}}))[1:5], lambda s: s.i::INT) AS top FROM p")
def log_softmax(spark, d):
    e = V.table(spark, d, "embeddings").where(F.col("embedding").isNotNull()).withColumn("lp", tensor.log_softmax(F.col("embedding")))
    total = F.aggregate("lp", F.lit(0.0), lambda a, v: a + F.exp(v))
    return e.select("vec_id", tensor.argmax(F.col("embedding")).alias("best"), F.round(F.element_at("lp", 1), 9).alias("first"), F.round(total, 9).alias("total"), tensor.top_k(F.col("embedding"), 5).alias("top"))


@query(f"WITH {SQL_LOGP} SELECT count(*) AS n, round(avg(-(0.9 * lp[label + 1] + 0.1 / len(lp) * list_sum(lp))), 6) AS loss FROM p WHERE label <> 0")
def cross_entropy_smoothed(spark, d):
    e = V.table(spark, d, "embeddings").where(F.col("embedding").isNotNull() & (F.col("label") != 0))
    loss = tensor.smoothed_cross_entropy(tensor.log_softmax(F.col("embedding")), F.col("label"), 0.1)
    return e.agg(F.count("*").alias("n"), F.round(F.avg(loss), 6).alias("loss"))


@query(f"WITH {SQL_LOGP} SELECT vec_id, round(exp(list_sum(lp) / len(lp)), 9) AS confidence, round(list_sum(lp) / pow((5 + len(lp)) / 6.0, 0.6), 6) AS beam FROM p")
def decode_scores(spark, d):
    e = V.table(spark, d, "embeddings").where(F.col("embedding").isNotNull()).withColumn("lp", tensor.log_softmax(F.col("embedding")))
    total = F.aggregate("lp", F.lit(0.0), lambda a, v: a + v)
    return e.select("vec_id", F.round(tensor.confidence(F.col("lp")), 9).alias("confidence"), F.round(tensor.beam_score(total, F.size("lp"), 0.6), 6).alias("beam"))


@query(f"WITH {V.SQL_RUNS}, s AS (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) AS s FROM runs) SELECT run, step, round(CASE WHEN s <= 10 THEN s / 10.0 ELSE sqrt(10.0 / s) END, 9) AS inverse_sqrt, round(CASE WHEN s <= 10 THEN s / 10.0 ELSE 0.5 * (1 + cos(pi() * least(1.0, (s - 10) / 40.0))) END, 9) AS cosine, round(CASE WHEN s <= 10 THEN s / 10.0 ELSE 1.0 END, 9)::DOUBLE AS constant FROM s")
def lr_schedule(spark, d):
    """The multiplier at each event of a run, counted from 1."""
    steps = monitor.running_totals(V.runs(spark, d).withColumn("one", F.lit(1)), "run", "step", "one").withColumn("s", F.col("running_one"))
    return steps.select("run", "step", *(F.round(tensor.schedule(F.col("s"), k, 10, 50), 9).alias(k) for k in ("inverse_sqrt", "cosine", "constant")))


@query(f"SELECT conv_id, turn AS position, c::INT AS channel, round(CASE WHEN c % 2 = 0 THEN sin(turn * exp((c - c % 2) * {-math.log(10000.0) / 16})) ELSE cos(turn * exp((c - c % 2) * {-math.log(10000.0) / 16})) END, 9) AS value FROM conversations, range(0, 16) b(c)")
def positional_table(spark, d):
    """Of every turn of a conversation, as a position."""
    turns = V.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("position"))
    return tensor.positional_table(turns, "position", 16).withColumn("value", F.round("value", 9))


@query("SELECT a.conv_id, a.turn AS place, b.turn AS other, b.turn > a.turn AS masked FROM conversations a JOIN conversations b USING (conv_id)")
def causal_mask(spark, d):
    """Which turns of its conversation a turn may not see."""
    return tensor.causal_mask(V.table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to line pairs, row rules, near-duplicate split, and counts by language and split."""
    rows = pairs(spark, sf_dir).where(F.size(validate.row_reasons(RULES)) == 0)
    return validate.split(rows).groupBy("domain", "split").agg(F.count("*").alias("rows"), F.sum(T.word_count(F.col("source"))).alias("source_words"))


@query(
    f"WITH {V.SQL_PAIRS}, ok AS (SELECT domain, source, {V.SQL_BUCKET.format(V.SQL_SIGNATURE.format('source'), 42)} AS b FROM pairs WHERE NOT {V.SQL_EMPTY} AND NOT {V.SQL_LENGTH} AND NOT {V.SQL_RATIO} > 3.0) "
    f"SELECT domain, {V.SQL_SPLIT} AS split, count(*) AS rows, sum({V.SQL_WORDS.format('source')})::BIGINT AS source_words FROM ok GROUP BY ALL"
)
def prepared_counts(spark, d):
    return flagship(spark, d)


# ---------------------------------------------------------------- run overview

SQL_OVERVIEW = """overview AS (SELECT run, CASE max_by(event, step) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'training' END AS status, max(step) AS last_step, max_by(event, step) AS last_event FROM runs WHERE run IS NOT NULL GROUP BY run)"""


def _overview(spark, d):
    """Runs of the event table; those whose last event is a purchase or an error have a result."""
    runs = V.runs(spark, d).where("run IS NOT NULL")
    ended = monitor.of_type(monitor.latest(runs, "run", "step"), "purchase", "error")
    ended = ended.select("run", F.when(F.col("event") == "error", "failed").otherwise("completed").alias("status"))
    return monitor.overview(runs.select("run").distinct(), ended, runs, "run", "step")


@query(f"WITH {V.SQL_RUNS}, {SQL_OVERVIEW} SELECT * FROM overview")
def experiment_overview(spark, d):
    return _overview(spark, d).select("run", "status", "last_step", "last_event")


@query(f"WITH {V.SQL_RUNS}, {SQL_OVERVIEW} SELECT run, last_step FROM overview WHERE status = 'training'")
def experiments_training(spark, d):
    return _overview(spark, d).where("status = 'training'").select("run", "last_step")


@query(f"WITH {V.SQL_RUNS}, {SQL_OVERVIEW} SELECT count(*) AS runs, count(*) FILTER (status = 'training') AS active, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status <> 'training') AS finished FROM overview")
def dashboard_counts(spark, d):
    return monitor.overview_counts(_overview(spark, d))


@query(f"WITH {V.SQL_RUNS} SELECT event, count(*) AS events, min(step) AS first_step, max(step) AS last_step FROM runs WHERE event IN ('click', 'view', 'purchase') GROUP BY event")
def event_type_filter(spark, d):
    rows = monitor.of_type(V.runs(spark, d), "click", "view", "purchase")
    return rows.groupBy("event").agg(F.count("*").alias("events"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


# ---------------------------------------------------------------- markup and scripts as validation rules


SQL_TAG = T.TAG_NAME.replace("'", "''")


def _sql_balanced(x: str) -> str:
    """The tags left open, each after a '<'; '!' once a closing tag fits none."""
    name = f"regexp_extract(tag, '{SQL_TAG}', 1)"
    closed = f"CASE WHEN ends_with(acc, '<' || {name}) THEN left(acc, length(acc) - length({name}) - 1) ELSE '!' END"
    step = f"CASE WHEN acc = '!' THEN acc WHEN starts_with(tag, '</') THEN {closed} WHEN ends_with(tag, '/>') THEN acc ELSE acc || '<' || {name} END"
    return f"(list_reduce(list_prepend('', regexp_extract_all({x}, '{SQL_TAG}')), lambda acc, tag: {step}) = '' AND NOT regexp_matches(regexp_replace({x}, '{SQL_TAG}', '', 'g'), '[<>]'))"


SQL_MARKUP_REASONS = f"""RECURSIVE {V.values('v', 'k, snippet', [(k, x) for k, (x, _) in enumerate(MARKUP)])}, given AS (
 SELECT page_id AS ord, html AS source, url AS target FROM pages
 UNION ALL SELECT -1 - page_id, '<a><br/>' || url || '</a>', url FROM pages
 UNION ALL SELECT (page_id + 1) * 4294967296 + k, snippet || ' ' || url, 'plain target number ' || k || ' of ' || url FROM pages, v),
own AS MATERIALIZED (SELECT *, CASE WHEN coalesce(source, '') = '' OR coalesce(target, '') = '' THEN 'empty,missing_value' WHEN {_sql_balanced('source')} AND {_sql_balanced('target')} THEN '' ELSE 'malformed_markup' END AS own FROM given),
walk AS (
 SELECT 0 AS k, ord, source, target, FALSE AS won FROM own WHERE own = ''
 UNION ALL
 SELECT k + 1, ord, source, target, won FROM (
  SELECT *, bool_or(won) OVER (PARTITION BY source) AS s_gone, bool_or(won) OVER (PARTITION BY target) AS t_gone FROM (
   SELECT k, ord, source, target, ord = min(ord) OVER (PARTITION BY source) AND ord = min(ord) OVER (PARTITION BY target) AS won FROM walk WHERE NOT won))
 WHERE won OR NOT (s_gone OR t_gone)),
accepted AS MATERIALIZED (SELECT ord, source, target FROM walk WHERE won)"""


@query(
    f"""WITH {SQL_MARKUP_REASONS} SELECT p.ord AS page_id, CASE WHEN p.own LIKE 'empty%' THEN p.own ELSE concat_ws(',',
 CASE WHEN s.target = p.target THEN 'duplicate_pair' END, CASE WHEN s.ord IS NOT NULL THEN 'source_duplicate' END, CASE WHEN s.target <> p.target THEN 'conflicting_translation' END,
 CASE WHEN t.ord IS NOT NULL THEN 'target_duplicate' END, CASE WHEN t.source <> p.source AND NOT coalesce(s.target <> p.target, FALSE) THEN 'conflicting_translation' END, nullif(p.own, '')) END AS reasons
 FROM own p LEFT JOIN accepted s ON s.source = p.source AND s.ord < p.ord LEFT JOIN accepted t ON t.target = p.target AND t.ord < p.ord"""
)
def markup_reasons(spark, d):
    """The markup rule inside the validator: pages as sources of their addresses (page_id), the addresses between tags that
    fit (-1 - page_id), and with each address every snippet (from page_id + 1 times 2 to the 32 on)."""
    rules = validate.Rules(1, 1 << 30, 1 << 30, 1e9)
    pages = V.table(spark, d, "pages")
    whole = pages.select(F.col("page_id").alias("ord"), F.col("html").alias("source"), F.col("url").alias("target"))
    tagged = F.concat(F.lit("<a><br/>"), "url", F.lit("</a>"))
    fit = pages.select((-1 - F.col("page_id")).alias("ord"), tagged.alias("source"), F.col("url").alias("target"))
    snippets = F.posexplode(F.array(*(F.lit(x) for x, _ in MARKUP))).alias("k", "snippet")
    mixed = pages.select("page_id", "url", snippets).select(
        ((F.col("page_id") + 1) * (1 << 32) + F.col("k")).alias("ord"),
        F.concat("snippet", F.lit(" "), "url").alias("source"),
        F.concat(F.lit("plain target number "), F.col("k").cast("string"), F.lit(" of "), "url").alias("target"),
    )
    judged = validate.validate(whole.unionByName(fit).unionByName(mixed), rules)
    return judged.select(F.col("ord").alias("page_id"), F.array_join("reasons", ",").alias("reasons"))


# ---------------------------------------------------------------- names and lengths


@query(rf"WITH w AS (SELECT doc_id, unnest(string_split({V.SQL_COLLAPSE.format('text')}, ' ')) AS name FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS names, count(*) FILTER (regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._-]*$')) AS sound FROM w GROUP BY doc_id")
def identifier_check(spark, d):
    """All words of every text as names: how many there are, and how many may be identifiers."""
    docs = V.table(spark, d, "documents").where(F.col("text").isNotNull())
    names = F.split(T.collapse(F.col("text")), " ")
    return docs.select("doc_id", F.size(names).cast("long").alias("names"), F.size(F.filter(names, T.is_identifier)).cast("long").alias("sound"))


@query("SELECT DISTINCT a || '-to-' || b AS direction, a AS source_language, b AS target_language FROM (SELECT lang AS a, lead(lang) OVER (ORDER BY doc_id) AS b FROM documents) WHERE a IS NOT NULL AND b IS NOT NULL")
def direction_strings(spark, d):
    """The directions between the languages of neighbouring documents, and the languages read from them."""
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("b"))
    named = docs.join(following, "doc_id").where("lang IS NOT NULL AND b IS NOT NULL").select(T.direction(F.col("lang"), F.col("b")).alias("direction")).distinct()
    languages = T.direction_languages(F.col("direction"))
    return named.select("direction", languages[0].alias("source_language"), languages[1].alias("target_language"))


@query(rf"WITH l AS (SELECT greatest(1, {V.SQL_WORDS.format('t')})::BIGINT AS length FROM (SELECT {V.SQL_COLLAPSE.format("coalesce(text, '')")} AS t FROM documents)) SELECT count(*) AS examples, count(*) FILTER (length > 256) AS skipped_overlength FROM l")
def overlength_report(spark, d):
    return encode.lengths_report(_lengths(spark, d), 256)


@query(rf"WITH l AS (SELECT doc_id, greatest(1, {V.SQL_WORDS.format('t')})::BIGINT AS length FROM (SELECT doc_id, {V.SQL_COLLAPSE.format("coalesce(text, '')")} AS t FROM documents)) SELECT * FROM l WHERE length <= 256")
def overlength_filter(spark, d):
    return encode.within(_lengths(spark, d), 256)


# ---------------------------------------------------------------- vocabulary


@query()
def bpe_vocabulary(spark, d):
    """Special pieces, 200 merges and all characters of the documents; tests hold it against one merge at a time."""
    return vocabulary.vocabulary(V.table(spark, d, "documents"), 200)


SQL_SPOKEN = r"w AS (SELECT unnest(regexp_extract_all(text, '[^\s\x1c-\x1f\x0b\x85\p{Z}]+')) AS w FROM documents)"


@query(f"WITH {SQL_SPOKEN} SELECT '▁' || w AS word, count(*) AS n FROM w GROUP BY w HAVING max(length(w)) <= 100")
def word_counts(spark, d):
    """What the vocabulary is learned from, without words that are counted in parts."""
    return vocabulary.distinct_words(V.table(spark, d, "documents")).where(F.length("word") <= vocabulary.LONGEST)


@query(f"WITH {V.SQL_PAIRS} SELECT count(*) FILTER (source <> '') AS source_sentences, count(*) FILTER (target <> '') AS target_sentences FROM pairs")
def tokenizer_sentences(spark, d):
    return pairs(spark, d).agg(F.count_if(F.col("source") != "").alias("source_sentences"), F.count_if(F.col("target") != "").alias("target_sentences"))


# ---------------------------------------------------------------- versions of data


@query("SELECT doc_id, CASE WHEN doc_id % 101 = 7 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 101 = 7 OR (doc_id % 103 = 5 AND text IS NOT NULL) UNION ALL SELECT -1 - doc_id, 'added' FROM documents WHERE doc_id % 107 = 3")
def version_diff(spark, d):
    """Two versions of the documents by their digest trees: some rows gone, some texts longer, some rows new."""
    docs = V.table(spark, d, "documents")
    i = F.col("doc_id")
    new = docs.where(i % 101 != 7).withColumn("text", F.when(i % 103 == 5, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    new = new.unionByName(docs.where(i % 107 == 3).withColumn("doc_id", -1 - i))
    paths = [_folder(spark, "tree") for _ in range(2)]
    for path, rows in zip(paths, (docs, new), strict=True):
        sinks.write_tree(rows, "doc_id", path)
    return sinks.tree_difference(spark, *paths)

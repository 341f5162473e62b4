"""Derived inputs over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2k and 2k+1 of every document as (source, target): ord, doc_id, row_number, domain, source, target.  A last
    line without another has an empty target."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "lang", F.split("text", "\n").alias("lines"))
    halves = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") + 1) / 2).cast("int") - 1), lambda k: F.struct(F.get("lines", 2 * k).alias("s"), F.coalesce(F.get("lines", 2 * k + 1), F.lit("")).alias("t")))
    rows = docs.select("doc_id", F.col("lang").alias("domain"), F.posexplode(halves).alias("row_number", "p"))
    return rows.select(
        (F.shiftleft("doc_id", 24) + F.col("row_number")).alias("ord"),
        "doc_id",
        F.col("row_number").cast("long").alias("row_number"),
        "domain",
        T.collapse(F.col("p.s")).alias("source"),
        T.collapse(F.col("p.t")).alias("target"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn after it as (conv_id, turn, source, target)."""
    c = table(spark, sf_dir, "conversations")
    ask = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    say = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return ask.join(say, ["conv_id", "turn"])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as training events: run, step, event, loss."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("event"), F.col("value").alias("loss"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions out of events: a run's purchases are the minor versions of its own major number, each the parent of the
    next; their status goes by event."""
    from pyspark.sql import Window as W

    bought = runs(spark, sf_dir).where("event = 'purchase'")
    rows = bought.select("run", "step", (F.row_number().over(W.partitionBy("run").orderBy("step")) - 1).alias("minor"))
    label = lambda minor: F.format_string("v%d.%d.0", F.col("run") + 1, minor)
    whole = lambda minor: F.concat(F.lit("aa-bb-aa-to-bb-"), label(minor))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("step") % len(STATUSES) + 1).cast("int"))
    return rows.select(
        whole(F.col("minor")).alias("version_id"),
        label(F.col("minor")).alias("version_label"),
        F.when(F.col("minor") > 0, whole(F.col("minor") - 1)).alias("parent_version"),
        status.alias("status"),
        (F.col("step") % 10 == 0).alias("protected"),
        "step",
    )


STATUSES = ["approved", "candidate", "rejected", "archived"]


def _sql(v: object) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(_sql(v) for v in r) + ')' for r in rows)})"


SQL_COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
SQL_PAIRS = rf"""pl AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
pk AS (SELECT doc_id, lang, l, unnest(range(0, (len(l) + 1) // 2)) AS k FROM pl),
pairs AS (SELECT doc_id * 16777216 + k AS ord, doc_id, k AS row_number, lang AS domain, {SQL_COLLAPSE.format("l[2 * k + 1]")} AS source, {SQL_COLLAPSE.format("coalesce(l[2 * k + 2], '')")} AS target FROM pk)"""
SQL_WORDS = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END"
SQL_RATIO = "greatest(length(source), length(target))::DOUBLE / greatest(1, least(length(source), length(target)))"
SQL_EMPTY = "(source = '' OR target = '')"
SQL_LENGTH = f"(length(source) < 1 OR length(target) < 1 OR length(source) > 1000 OR length(target) > 1000 OR {SQL_WORDS.format('source')} > 256 OR {SQL_WORDS.format('target')} > 256)"
def _sql_longer(x: str) -> str:
    for c, f in T.FOLDED_LONGER.items():
        x = f"replace({x}, '{c}', '{f}')"
    return x


SQL_FOLD = f"list_transform([translate(lower({{0}}), '{''.join(T.FOLDED_ALIKE)}', '{''.join(T.FOLDED_ALIKE.values())}')], lambda low: CASE WHEN regexp_matches(low, '[{''.join(T.FOLDED_LONGER)}]') THEN {_sql_longer('low')} ELSE low END)[1]"
SQL_SIGNATURE = rf"list_transform([{SQL_FOLD}], lambda folded: coalesce(nullif(regexp_replace(folded, '[^\p{{{{L}}}}\p{{{{N}}}}_]+', '', 'g'), ''), folded))[1]"
SQL_BUCKET = "('0x' || substr(sha256('{1}:' || {0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"
SQL_SPLIT = "CASE WHEN b < 0.9 THEN 'train' WHEN b < 0.9 + 0.05 THEN 'validation' ELSE 'test' END"
SQL_TURNS = "turns AS (SELECT u.conv_id, u.turn, u.text AS source, a.text AS target FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
SQL_RUNS = "runs AS (SELECT user_id AS run, event_id AS step, event_type AS event, value AS loss FROM events)"
SQL_VERSIONS = f"""bought AS (SELECT user_id + 1 AS major, event_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS minor FROM events WHERE event_type = 'purchase'),
added AS (SELECT 'aa-bb-aa-to-bb-v' || major || '.' || minor || '.0' AS version_id, 'v' || major || '.' || minor || '.0' AS version_label,
 CASE WHEN minor > 0 THEN 'aa-bb-aa-to-bb-v' || major || '.' || (minor - 1) || '.0' END AS parent_version, {STATUSES!r}[step % {len(STATUSES)} + 1] AS status, step % 10 = 0 AS protected, step, major, minor FROM bought),
production AS (SELECT arg_max(version_id, step) AS id FROM added WHERE status = 'approved'),
versions AS (SELECT added.* REPLACE (CASE WHEN version_id = id THEN 'production' ELSE status END AS status, protected OR version_id = id AS protected) FROM added, production)"""

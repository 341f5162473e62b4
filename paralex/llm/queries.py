"""The queries opN_<name> of this subpackage, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.llm import archives, jaccard, langid, mixing, mixmodel, packing, periodic, permutation, phrases, secrets, treaps, windows


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.substring_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), width=20)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secret_scan(_table(spark, sf_dir, "documents", "doc_id", "text"), fdr=0.01)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans"), "n_random")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.line_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), width=3)
    return out.select("doc_id", F.col("n_units").alias("n_lines"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the mix needs a document's number of words, not its text
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", F.regexp_count("text", F.lit(mixing.WORD)).alias("n_words"))
    out = mixing.mix_sources(docs, size=F.col("n_words"), weights=(3, 1, 2), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op9_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.phrase_fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumnRenamed("edited_text_sha256", "edited_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), sample_per_language=4000)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op6_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = permutation.permutation_search(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)
    return out.select("query_id", "rank", "vec_id", "score")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_groups(_table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op7_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixmodel.mixing_scores(_table(spark, sf_dir, "documents", "doc_id", "text"), parts=5, part=1)


def op11_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    return treaps.ranked_search(docs, items, k=20)


def repeating(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), of which every tenth by the hash of doc_id repeats some of its words from a word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % period))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    looped = F.element_at(F.transform(F.array(words), loop), 1)  # words are extracted once
    return docs.withColumn("text", F.when(F.col("text").isNotNull() & (h % 10 == 0), looped).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(repeating(_table(spark, sf_dir, "documents", "doc_id", "text")), least=24, exponent=3)

    def sooner(a: Column, b: Column) -> Column:
        """Greater length / period first, told apart exactly; then as they come: by start, then period."""
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        by_place = F.when(F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"]), -1).otherwise(1)
        return F.when(x > y, -1).when(x < y, 1).otherwise(by_place)

    best = F.try_element_at(F.array_sort("runs", sooner), F.lit(1))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op13_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archives.write_archives(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return archives.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_permutation_search": op6_permutation_search,
    "op7_mixing_scores": op7_mixing_scores,
    "op8_best_fit_pack": op8_best_fit_pack,
    "op9_phrase_fingerprints": op9_phrase_fingerprints,
    "op10_language_id": op10_language_id,
    "op11_treap_search": op11_treap_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc_pages": op13_warc_pages,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": """
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
hashed AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM spots),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM hashed) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op4_line_dedup": """
WITH w AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
spots AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM w WHERE len(lines) >= 3),
hashed AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(lines[i:i + 2], chr(10))) AS h FROM spots
  WHERE regexp_matches(array_to_string(lines[i:i + 2], chr(10)), '[^\\x20\\x09-\\x0D]')),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM hashed) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM late),
pos AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w.lines)::BIGINT AS n_lines, (len(w.lines) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op11_treap_search": """
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
g AS (SELECT count(*)::BIGINT AS total_docs, sum(len(terms))::BIGINT AS total_terms FROM d WHERE len(terms) > 0),
q AS MATERIALIZED (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total_docs) // total_terms))))::BIGINT AS score FROM p JOIN w USING (term) JOIN q USING (term), g GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 20
""",
    "op13_warc_pages": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last > page_id THEN last END AS refers_to FROM m
""",
}

"""The operators' queries over the shared tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, line_dedup, mixing, packing, simhash, substring_dedup, topk, toxicity, warc
from .common import held_out, read, write_table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are read once, for their words
    docs, _ = write_table(read(spark, sf_dir, "documents").select("doc_id", "source", mixing.words_of().alias("words")), "words")
    mixed = mixing.plan_mix(docs, schedules=mixing.CURRICULUM_3_1_2, words="words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(read(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary=vocabulary(), with_ids=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(read(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, manifest)
    page, refers_to = warc.page_id_of("record_id"), warc.page_id_of("refers_to_id")
    return records.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers_to.alias("refers_to"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_substrings(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n_items").alias("n_words"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.remove_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n_items").alias("n_lines"), F.col("n_removed").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix, op2_topk, op3_exact_dedup, op4_pack, op5_warc, op6_substring_dedup, op7_line_dedup, op8_simhash, op9_toxicity, op10_language_id)}

ORACLE_SQL = {
    "op1_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
        r AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS curve, [3.0, 1.0, 2.0][1 + curve] AS w FROM s),
        f AS (SELECT *, 2.0 * n / w AS full_at, row_number() OVER (ORDER BY 2.0 * n / w, source IS NULL, source) AS k FROM r),
        l AS (SELECT *, (1.5 * sum(n) OVER () - 2.0 * coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
        v AS (SELECT arg_min(level, k) AS level FROM l WHERE level <= full_at),
        t AS (SELECT source, curve, CAST(n AS BIGINT) AS source_size, least(2.0 * n, v.level * w) AS target FROM l LEFT JOIN v ON true),
        p AS (SELECT d.doc_id, curve, size, source_size, coalesce(target, 0.0) AS target,
                     CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS e,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        k AS (SELECT *, CAST(e * size + greatest(0, least(size, floor(target) - e * source_size - c)) AS BIGINT) AS taken,
                     CASE WHEN target > 0 THEN [3.0, 1.0, 2.0][1 + curve]::DOUBLE * (c::DOUBLE / target) END AS part FROM p)
        -- the curves' weights: 4 - 2t; 0.5 + t; 1 + 4t, from t = 0.5 on 3 - 4 (t - 0.5)
        SELECT doc_id, size, source_size, target, taken,
               CASE WHEN taken > 0 THEN
                    CASE WHEN curve = 0 THEN 2e0 * part / (4e0 + sqrt(greatest(0e0, 16e0 - 4e0 * part)))
                         WHEN curve = 1 THEN 2e0 * part / (0.5e0 + sqrt(greatest(0e0, 0.25e0 + 2e0 * part)))
                         WHEN part >= 1 THEN 0.5e0 + 2e0 * (part - 1e0) / (3e0 + sqrt(greatest(0e0, 9e0 - 8e0 * (part - 1e0))))
                         ELSE 2e0 * part / (1e0 + sqrt(greatest(0e0, 1e0 + 8e0 * part))) END END AS position FROM k""",
    "op2_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM e q JOIN e x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id AND len(q.v) = len(x.v)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
        g AS (SELECT *, count(*) OVER (PARTITION BY n) AS group_size, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(s, CAST(k // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM g""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS k, w FROM d WHERE len(w) >= 13),
        x AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM p),
        f AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS m FROM x),
        c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM f WHERE m < doc_id),
        r AS (SELECT doc_id, count(*) AS n, list(k) AS gone FROM c GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)""",
    "op7_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS k FROM d),
        y AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        m AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM y)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}

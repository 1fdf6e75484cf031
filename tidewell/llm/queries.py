"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontam, license, lm, media, mixing, neardup, pii, quality, sharding, substring, warc, whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    p = p.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return p.select(F.col("doc").cast("long").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.sniff(media.store(_table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = _table(spark, sf_dir, "benchmark")
    found = decontam.every_item(decontam.leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), benchmark), benchmark)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "first_word", "n_words")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = quality.fit(docs.where(~held), _table(spark, sf_dir, "labels").where(~held))
    scored = quality.score(docs.withColumn("held_out", held), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_index(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard_index(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(docs, pii.fit(pii.labelled_examples(docs)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_media": op2_media,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_decontamination": op4_decontamination,
        "op5_quality": op5_quality,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_near_dedup": op7_near_dedup,
        "op8_warc": op8_warc,
        "op9_license_scan": op9_license_scan,
        "op10_sharding": op10_sharding,
        "op11_pii": op11_pii,
        "op12_filter_audit": op12_filter_audit,
        "op13_whitening": op13_whitening,
        "pipeline": pipeline,
    }


#: The SQL of those that SQL can express; tests/llm compares the others with brute force.
SQL = {
    "op6_substring_dedup": r"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
        h AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM p),
        rep AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
        cov AS (SELECT DISTINCT r, i + k AS j FROM rep, range(35) t(k)),
        x AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM x ANTI JOIN cov USING (r, j) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
        g AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN first IS NOT DISTINCT FROM page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM p LEFT JOIN g USING (html)""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        m AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
        lb AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN lb USING (doc_id) GROUP BY ALL),
        l(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
         AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        s AS (SELECT filter_order, i AS step, bits[i] AS f, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) r(i)),
        r AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & (before + f) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & f > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & f > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & f > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & f > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
        toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import bit_sliced_topk, bpe_codec, hard_negatives, langmask, licenses, media, mixing, ngram_rules, parity_join, pu_quality, token_count, turn_repair, warc
from assay.llm.common import crc_bucket

BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = crc_bucket(F.col("doc_id"), 5)
    trusted = ngram_rules.trusted_keys(table(spark, sf_dir, "labels")).where(crc_bucket(F.col("doc_id"), 5) != 0)
    scored = pu_quality.score_texts(docs, trusted, remainder != 0, spark, threshold=0.3)
    return scored.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.with_budget(docs, public_tokenizers.path(BPE), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    made = warc.derivatives(warc.with_responses(pages), drop=("record",))
    return made.select(
        "page_id", "url", "error", "refers_to", "metadata_id", "conversion_id", "source_block_digest", "source_payload_digest",
        "digest_ok", "title", "n_links", "text", F.sha2("metadata_record", 256).alias("metadata_sha256"),
        F.sha2("conversion_record", 256).alias("conversion_sha256"),
    )


def op4_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature media_type type_corrected"
    return media.text_media(docs).select(*columns.split())


def op5_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ruled = ngram_rules.apply_rules(docs, ngram_rules.trusted_keys(table(spark, sf_dir, "labels")))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept log_ratio"
    return ruled.select(*columns.split())


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe_codec.round_trip(docs, public_tokenizers.path(BPE), drop=("text",))
    return bpe_codec.digests(both).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return parity_join.near_duplicates(docs, spark, parity_join.Similarity(k=4, num=85, den=100))


def op8_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fitted = langmask.fit(docs.where(crc_bucket(F.col("doc_id"), 3) != 1).select("text", "lang"), spark)
    found = langmask.identify(docs.select("doc_id", "text"), fitted, drop=("text",))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, drop=("text",))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), spark)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, spark, label, F.col("vec_id") % 50 == 0)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.repair(turn_repair.damage(turns), spark, turns)
    return turn_repair.with_digests(found)


def op13_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bit_sliced_topk.top_k(rows, spark, F.col("vec_id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports the operators of this package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pu_quality": op1_pu_quality,
        "op2_token_count": op2_token_count,
        "op3_warc_derivatives": op3_warc_derivatives,
        "op4_media_sniffing": op4_media_sniffing,
        "op5_ngram_rules": op5_ngram_rules,
        "op6_bpe_round_trip": op6_bpe_round_trip,
        "op7_parity_join": op7_parity_join,
        "op8_language_masks": op8_language_masks,
        "op9_license_scan": op9_license_scan,
        "op10_source_mix": op10_source_mix,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_turn_repair": op12_turn_repair,
        "op13_bit_sliced_topk": op13_bit_sliced_topk,
        "pipeline": pipeline,
    }


_VECTORS = """v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x, CAST(label AS BIGINT) AS own FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)"""
_LINKS = r"""w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT i, j FROM c JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
    l AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
    r(doc_id, root) AS (SELECT DISTINCT i, i FROM l UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.doc_id WHERE r.root < l.j)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_parity_join": f"""WITH RECURSIVE {_LINKS}
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id FROM documents d
            LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)""",
        "op11_hard_negatives": f"""WITH {_VECTORS},
            e AS (SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (own + 1) % 10 ELSE own END AS label FROM v WHERE own IS NOT NULL),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score, a.label = b.label AS same FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
            p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
            SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
            FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
            QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3""",
        "op13_bit_sliced_topk": f"""WITH {_VECTORS},
            s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    }

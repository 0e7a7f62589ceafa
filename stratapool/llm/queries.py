"""The queries of the training-data operators, one opN_<name> each, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    out = simhash.classes(read(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.columns(read(spark, sf_dir))


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shards

    out = shards.assign(read(spark, sf_dir), shards.SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.report(read(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("first").cast("long").alias("n_repeats"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(read(spark, sf_dir))


def remainder(mod: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = read(spark, sf_dir)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    net = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted", "flagged")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = read(spark, sf_dir)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = langid.train(docs, ~held_out)
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read(spark, sf_dir)
    return quality.judge(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(read(spark, sf_dir)).taken()


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokencounts

    return tokencounts.of_documents(read(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_media_chunks": op2_media_chunks,
        "op3_jump_shards": op3_jump_shards,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_toxicity": op6_toxicity,
        "op7_language_id": op7_language_id,
        "op8_quality_rules": op8_quality_rules,
        "op9_mixing": op9_mixing,
        "op10_token_counts": op10_token_counts,
    }


SUBSTRINGS_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d)),
lowest AS (SELECT g, min(doc_id) AS low FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM windows JOIN lowest USING (g) WHERE doc_id > low),
runs AS (SELECT r, count(*) AS n_removed, count(*) FILTER (p - 1 <> coalesce(before, -1)) AS n_repeats FROM (SELECT *, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM gone) GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats FROM d LEFT JOIN runs USING (r) LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    """The others draw at random, are learned, or hash and encode in ways that SQL lacks."""
    return {"op4_substring_dedup": SUBSTRINGS_SQL}

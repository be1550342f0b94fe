"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_suffixes(spark, sf_dir):
    from .suffixes import dedup

    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))


def op4_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op5_maxscore(spark, sf_dir):
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_token_counts(spark, sf_dir):
    from .token_cache import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_warc(spark, sf_dir):
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"))


def op1_toxicity(spark, sf_dir):
    from . import toxicity, toxicity_fit

    docs = table(spark, sf_dir, "documents")
    model = toxicity_fit.fit_tables(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op6_decontamination(spark, sf_dir):
    from .decontaminate import annotate

    out = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("_items", ","), 256)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


def op8_licenses(spark, sf_dir):
    from .licenses import scan

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_license").alias("license"), F.col("_score").alias("score"), F.col("_n_matches").alias("n_matches"))


def op10_quality(spark, sf_dir):
    from .quality import score

    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_posterior").alias("posterior"), F.col("_score").alias("score"), F.col("_keep").alias("keep"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_suffixes, op4_packing, op5_maxscore, op6_decontamination, op7_token_counts, op8_licenses, op9_warc, op10_quality, pipeline)}


def oracle_sql():
    from .licenses import oracle

    return {"op8_licenses": oracle()}

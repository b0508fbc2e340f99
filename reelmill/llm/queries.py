"""The operators over their whole given tables, with the parameters they would run with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm import bpe, decontaminate, fingerprint, html_text, line_dedup, lm, minhash, ngram_join, quality, quotes, ranked_search, secrets, sql, token_alignment
from reelmill.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_sha256(text) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_bpe_forced_boundaries")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.bpe_round_trip(docs, vocabulary_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op4_quality_gam")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_documents(docs.select("doc_id", "text"), labels)


@query("op5_html_text_density")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op3_decontaminate_qgrams")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_minhash_circulant")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query("op7_line_runs", sql.LINE_RUNS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", hex_sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


@query("op10_secret_ownership")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")

    def of_kind(number: int) -> F.Column:
        return F.filter("spans", lambda s: s["kind"] == number)

    base = F.filter("spans", lambda s: s["kind"] < secrets.OPAQUE)
    return found.select(
        "doc_id",
        *[F.size(of_kind(no)).cast("long").alias(f"n_{kind}") for no, kind in enumerate(secrets.KINDS[: secrets.OPAQUE])],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


@query("op2_entropy_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edit(table(spark, sf_dir, "documents"))


@query("op9_deleted_interpolation")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query("op6_quotation_links")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


@query("op13_reversed_search", sql.RANKED_SEARCH)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_alignment.align_tokenizers(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


@query("op12_ngram_jaccard", sql.NGRAM_JACCARD)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), words=3, percent=90)

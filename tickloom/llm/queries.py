"""Registered queries of the subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import alignment, exact_dedup, line_index, merkle, minhash_dedup, mixing, packing, paragraph_dedup, quality, suffix_dedup, token_files, url_reputation, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_hilbert_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)


@query("op3_minhash_bayes", minhash_dedup.NEAR_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


@query("op4_rans_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, folder = token_files.as_files(spark)
    files = token_files.write_ids(table(spark, sf_dir, "documents"), folder, tokenizer("byte_bpe_50k.json"))
    out = scratch.store(token_files.read_ids(files, folder), "answer")
    scratch.drop("files")
    return out


@query("op5_host_reputation", url_reputation.JUDGE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(1)).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.lit(0))
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes).drop("bad_bound")


@query("op7_quality_network")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_multi_index", vector_dedup.PAIRS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_poisson_mixing", mixing.MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


#: DuckDB's form of the contract: groups of equal texts, the largest id stays
EXACT_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""


@query("op10_patricia_exact", EXACT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op6_deep_shallow_repeats")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query("op1_paragraph_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


@query("op11_line_index", line_index.LINES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.drop_repeated_lines(table(spark, sf_dir, "documents"), with_text=False)


@query("op12_merkle_manifest", merkle.MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


@query("op13_galloping_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))

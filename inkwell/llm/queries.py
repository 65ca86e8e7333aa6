"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.oracles import SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_spec(path: str | None = None) -> str:
    """The text of a tokenizer file; by default the installed public byte-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.linedup import line_decisions

    return line_decisions(_read(spark, sf_dir, "documents")).drop("text_key")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.quality import select

    out = select(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.withColumn("log_weight", F.round("log_weight", 6))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents")).drop("text_key", "words_key", "first")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.lm import score_documents

    return score_documents(_read(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op6_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.rabitq import similar_vectors

    return similar_vectors(_read(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.secrets import scan_paths

    found, _ = scan_paths(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.media import media_features, store_texts

    return media_features(store_texts(_read(spark, sf_dir, "documents"))).drop("media_type")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.langid import fit, predict

    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    out = predict(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.bpe import tokenize

    return token_digests(tokenize(_read(spark, sf_dir, "documents"), tokenizer_spec()))


def op11_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.rewrite import rewrite_clients

    done = rewrite_clients(_read(spark, sf_dir, "clients"))
    return done.select("file_no", "version", "n_rows", "n_nulls", F.col("keys_sha256").alias("ids_sha256"), "rows_sha256", "start_columns", "columns", "path", "rewritten")


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.negatives import hard_negatives

    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), "id % 100 = 0")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.packing import pack

    packed = pack(_read(spark, sf_dir, "documents"), tokenizer_spec())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def token_digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_linededup, op2_mixing, op3_quality, op4_minhash, op5_lm, op6_rabitq, op7_secrets, op8_media, op9_langid, op10_bpe, op11_rewrite, op12_hardneg, op13_packing)}
ORACLE_SQL: dict[str, str] = SQL

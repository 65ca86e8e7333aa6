"""The corpus pipeline: quality selection, line dedup, near-dedup, source mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and re-read as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, linedup, minhash, mixing, quality
from inkwell.llm.queries import token_digests, tokenizer_spec
from inkwell.llm.scratch import OPEN, Scratch, clear_since

#: Least similarity of near-duplicates in the pipeline; op4_minhash has its own.
NEAR_PERCENT = 80


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good labels draws.

    Null and empty texts weigh 0 and take part; rows that repeat an id share its chance; rows that tie with the
    last place drawn stay. An empty table gives an empty one.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; those with no text left go.

    Null and empty texts and rows with a null id stay as they are. A row loses its own lines only, even if its id
    repeats; rows that repeat id and text are one text, so the later ones keep what the first keeps.
    """
    return linedup.without_lines(docs, linedup.line_decisions(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more), that of the smallest id.

    Rows with a null id and rows without words stay. Rows that repeat an id are judged by their own texts; of rows
    that repeat an id with the same words one stays.
    """
    return minhash.without_copies(docs, minhash.near_duplicates(docs, percent=NEAR_PERCENT))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix of sources, one for each epoch that reads a document.

    A null source is one of the empty name; rows without tokens cost no budget; rows that repeat an id within a
    source are read together. An empty table gives an empty one.
    """
    return mixing.mix_sources(docs, keep=docs.columns, report=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed rows, one for each; null and empty texts have no token."""
    return token_digests(bpe.tokenize(docs, tokenizer_spec()))


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix),
    ("BPE encoding and decoding", encode),
]

#: Near-dedup, importance resampling and BPE merges aren't expressible in SQL; the tests hold each stage
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        mark = len(OPEN)
        written = scratch.save(stage(spark, docs, sf_dir), name.split()[0])
        clear_since(mark)  # the stage's own tables; its result is written
        if docs is not written and hasattr(docs, "_inkwell_path"):
            scratch.drop(docs)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)

"""Stages against brute force, and the queries' registration."""

import hashlib
from collections import Counter

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm import quality
from inkwell.llm.oracles import SQL
from inkwell.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns

    before, after = seen["quality classifier"]
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.select(whole, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and len(kept) < len(before)

    before, after = seen["line dedup"]
    gone = brute.lines([(i, r.text) for i, r in sorted(before.items())], 24)
    for r in after:
        want = "\n".join(x for n, x in enumerate(before[r.doc_id].text.split("\n")) if not gone.get((r.doc_id, n)))
        assert r.text == want and r.n_chars == len(want)

    before, after = seen["MinHash near-dedup"]
    comp, _ = brute.near({i: r.text for i, r in before.items()}, corpus_pipeline.NEAR_PERCENT)
    assert sorted(r.doc_id for r in after) == sorted(i for i in before if comp[i] == i)

    before, after = seen["mixing sources"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    assert Counter(r.doc_id for r in after) == Counter(r[0] for r in con.sql(SQL["op2_mixing"]).fetchall())
    assert all(r == before[r.doc_id] for r in after)

    before, after = seen["BPE encoding and decoding"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in after:
        text = before[r.doc_id].text
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_with_clashing_columns(spark, tmp_path):
    """Extra columns of internal names, nulls, repeated rows and an empty table pass through every stage."""
    extra = {n: F.lit(k).cast("string") for k, n in enumerate(("_id", "_gone", "epoch", "weight", "block", "kept", "place", "ids", "component", "_kept", "_source"))}
    whole = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumns(extra)
    odd = spark.createDataFrame([(None, "a null id", None, None, 9), (900, None, "en", "src0", None), (901, "", None, "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra)
    whole = whole.unionByName(odd).unionByName(whole.limit(1))
    for case, docs in (("odd", whole), ("empty", whole.where("false"))):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{case}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{case}{k}"))
            if k < 4:
                assert docs.columns == columns
        assert (docs.count() > 0) == (case == "odd")


def test_stages_with_repeated_ids(spark):
    """No stage takes a text along that only shares its id with another."""
    x, u, v = "one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g h"
    docs = spark.createDataFrame([(0, x), (1, x), (1, u), (1, u), (2, v), (2, v + " "), (None, x), (3, None), (3, "")], "doc_id long, text string")
    got = Counter((r.doc_id, (r.text or "").strip()) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == Counter([(0, x), (1, u), (2, v), (None, x), (3, ""), (3, "")])
    a, b = "first line of some length here", "another line of a fair length"
    docs = spark.createDataFrame([(0, a, 1), (1, a + "\nmore", 1), (1, b + "\nrest", 1), (None, a, 1)], "doc_id long, text string, n_chars int")
    got = Counter(map(tuple, corpus_pipeline.drop_lines(spark, docs, SF).collect()))
    assert got == Counter([(0, a, 1), (1, "more", 4), (1, b + "\nrest", 1), (None, a, 1)])


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_held_out_languages(spark):
    out = QUERIES["op9_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()
    assert r[0] > 0.95

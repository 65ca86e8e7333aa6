"""Whole tables against brute force, and parameters."""

import gzip

import numpy as np

import corpus_pipeline
from inkwell.llm import linedup, media, minhash
from inkwell.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


def test_short_lines_are_compared(spark):
    texts = {1: "All rights reserved.\n\n}\n" + "a" * 24, 2: "All rights reserved.\nAll rights reserved!\n  \n}", 3: "a" * 23 + "\n" + "a" * 25 + "\n" + "a" * 23}
    got = {(r.doc_id, r.line_no): r.reason for r in linedup.line_decisions(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute.lines(sorted(texts.items()), 24) and got[2, 0] == got[2, 3] == got[3, 2] == "exact" and got[3, 1] == "near" and got[2, 1] is got[3, 0] is None


def test_every_line_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, texts = QUERIES["op1_linededup"](spark, SF).collect(), {r.doc_id: r.text for r in docs.collect()}
    assert {(r.doc_id, r.line_no): r.reason for r in got} == brute.lines(sorted(texts.items()), 24)
    assert sum(r.reason == "exact" and len(texts[r.doc_id].split("\n")[r.line_no]) < 24 for r in got) == 74


def test_near_stage_links_from_80_percent(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 1000 and n_chars < 6000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    comp, _ = brute.near(texts, 80)
    assert comp != brute.near(texts)[0]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i in texts if comp[i] == i)


def test_bands_follow_the_threshold():
    assert (minhash.bands_for(85), minhash.bands_for(80)) == (25, 37)
    assert all((1 - (p / 100) ** minhash.ROWS) ** minhash.bands_for(p) <= minhash.BAND_MISS for p in range(50, 100))


def test_large_gzip_and_revised_pdf():
    raw = gzip.compress(b"ab" * (10 << 20))
    assert media.sniff(b"x" + raw + b"tail") == [(1, len(raw), "application/gzip")]
    assert media.sniff(raw[:-1]) == []
    noise = np.random.default_rng(1).bytes(300_000)
    stored = gzip.compress(noise)
    assert (0, len(stored), "application/gzip") in media.sniff(stored + noise)
    pdf = b"%PDF-1.4\nstartxref\n9\n%%EOF\n1 0 obj\nendobj\nstartxref\n30\n%%EOF"
    assert media.sniff(pdf + b"tail" + pdf) == [(0, len(pdf), "application/pdf"), (len(pdf) + 4, len(pdf), "application/pdf")]

"""Secret scanning over an incremental blob ledger.

A path's text is a blob, addressed by the SHA-256 of its UTF-8 bytes. The ledger holds which blobs
were scanned under which rule version and what was found. A run scans only the (blob, rule version)
pairs that the ledger lacks, once for all paths and versions of a path that share them, and joins the
findings back to every path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.scratch import Scratch, with_group

RULE_VERSION = "2025.1"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "jwt", "pem", "bearer", "slack")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MORE = {
    "github": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "pem": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    "bearer": ("Bearer ", re.compile(r"Bearer [A-Za-z0-9._~+/=-]{20,}")),
    "slack": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
}
_HEX_RUN = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_RUN = b"\1" * 24

LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in ``KINDS``, end) of every secret, in code points, sorted.

    Each guard is a plain substring test that no matching text fails. No rule rescans a run of characters from
    each of its places, so time is linear in the text.
    """
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _RUN in text.encode("ascii", "replace").translate(_HEX_RUN):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for kind, (guard, rule) in _MORE.items():
        if guard in text:
            found += [(m.start(), KINDS.index(kind), m.end()) for m in rule.finditer(text)]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, text) batches to findings of each blob."""
    for batch in batches:
        spans = [find_spans(t or "") for t in batch.column(1).to_pylist()]
        base = [[s for s in each if s[1] < len(BASE_KINDS)] for each in spans]
        out = {"blob": batch.column(0)}
        for i, kind in enumerate(BASE_KINDS):
            out[f"n_{kind}"] = pa.array([sum(s[1] == i for s in each) for each in base], pa.int64())
        out["base_sha256"] = pa.array([hashlib.sha256(_joined(each).encode()).hexdigest() for each in base])
        out["spans"] = pa.array([_joined(each) for each in spans])
        yield pa.RecordBatch.from_pydict(out)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_paths(paths: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """``(findings, new ledger rows)``.

    ``findings`` has, for each input row, ``<path_col>``, ``blob``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256`` and ``spans``; ``paths`` may hold any number of versions of a path, one row each.
    The new rows, of schema ``LEDGER``, are to be appended to the caller's ledger.

    Only hashes are aggregated to find the unseen blobs. One path of each unseen blob is its carrier;
    texts move at most once, dealt by path, which spreads evenly even if one blob has a third of all
    paths. Rows of hot blobs stay where they are in the join back: what was found in those blobs, a bounded number, goes to them.

    Null text counts as empty; texts of any length are scanned whole. A null path is kept; its blob is scanned if it has no other path too.
    Repeated rows stay, one output row each. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = paths.sparkSession
    scratch = scratch or Scratch(spark, "secrets")
    kind = paths.schema[path_col].dataType.simpleString()
    rows = paths.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    addressed = scratch.save(rows.select("path", "blob"), "addressed")
    blobs = scratch.save(addressed.groupBy("blob").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("_n")), "blobs")
    unseen = blobs.select("blob", "path")
    if ledger is not None:
        done = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        unseen = unseen.join(done, "blob", "left_anti")
    carriers = unseen.select("blob", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("carrier"))
    texts = rows.withColumn("carrier", F.coalesce(F.col("path").cast("string"), F.lit("")))
    once = texts.join(carriers, ["carrier", "blob"]).select("blob", "text")
    new = once.mapInArrow(scan, "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    # a row that is repeated under one path is scanned with it; the ledger has a blob once
    new = scratch.save(new.dropDuplicates(["blob"]).withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"), "ledger")
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version") == rule_version).select(new.columns))
    sized = scratch.save(known.drop("rule_version").join(blobs.select("blob", "_n"), "blob"), "findings")
    scratch.drop(blobs)
    found = with_group(addressed, sized, ["blob"])
    return found.select(F.col("path").cast(kind).alias(path_col), "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"), new

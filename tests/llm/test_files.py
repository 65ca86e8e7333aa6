"""Operators 11 to 13 against plain versions, and their edges."""

import datetime
import hashlib
import math
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkwell.llm import negatives, packing, rewrite
from inkwell.llm.queries import QUERIES, tokenizer_spec
from inkwell.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]


def local(path):
    return path.removeprefix("file://")


def cell(name, x):
    if x is None:
        return "?"
    if name == "balance":
        return str(math.floor(1048576 * x)) if math.isfinite(x) else str(x)
    return str(round((x - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))) if name == "updated_at" else str(x)


def rewritten(rows, files=250):
    """Plain version of the rewrite: file_no -> (version, nulls, ids digest, rows digest)."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["client_id"]).encode()), r["client_id"]))
    per, out = 1 + len(rows) // files, {}
    for k in range(0, len(rows), per):
        no = k // per
        v = zlib.crc32(f"19:{no}".encode()) % 24
        v = 0 if v > 15 else v
        part = [dict(r) for r in rows[k : k + per]]
        for r in part:
            if v & 4:
                r |= {"nation_id": -1, "segment": "none"}
            if v & 8 and r["balance"] is not None:
                r["balance"] = float(np.float32(r["balance"]))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines = "\n".join("|".join(cell(c, r[c]) for c in COLUMNS) for r in part)
        out[no] = (v, sum(r[c] is None for r in part for c in COLUMNS), digest(",".join(str(r["client_id"]) for r in part)), digest(lines))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_rewrite_against_plain_version(spark, sf):
    got = QUERIES["op11_rewrite"](spark, f"/root/testdata/{sf}").collect()
    want = rewritten(pq.read_table(f"/root/testdata/{sf}/clients.parquet").to_pylist())
    assert {r.file_no: (r.version, r.n_nulls, r.ids_sha256, r.rows_sha256) for r in got} == want
    assert {r.version for r in got} >= {0, 1, 2, 4, 8} and all(r.rewritten == (r.version > 0) for r in got)
    folder = os.path.dirname(local(got[0].path))
    assert sorted(x for x in os.listdir(folder) if not x.startswith((".", "_"))) == sorted(os.path.basename(r.path) for r in got)
    for r in got[:40]:
        file = pq.ParquetFile(local(r.path))
        assert rewrite.field_ids(file.schema_arrow) == list(range(1, 11)) and file.schema_arrow.names == COLUMNS == r.columns.split(",")
        assert file.schema_arrow.field("nation_id").type == pa.int64() and file.metadata.num_rows == r.n_rows
        names = r.start_columns.split(",")
        assert ("segment" in names) == (not r.version & 4) and (names[1] == "balance") == bool(r.version & 2)
        assert (names.index("name") > names.index("email")) == (bool(r.version & 1) != bool(r.version & 2))


def test_rewrite_edges(spark):
    day = datetime.datetime(2024, 1, 2, 3, 4, 5, 6)
    rows = [(i, None, "", day, "x" * 200_000, "é|\n?", None, i, None, float("nan") if i % 2 else float("inf")) for i in range(4)]
    rows += [(None,) * 10, (7,) * 2 + (None,) * 8, (7,) * 2 + (None,) * 8, (9, 1, "a", None, "b", "c", "d", 2, "e", -1e300)]
    frame = spark.createDataFrame(rows, "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double")
    extra = frame.withColumns({c: F.lit("mine") for c in ("_file", "_rank", "_crc", "f1", "path", "file_no")})
    got = rewrite.rewrite_clients(extra, files=3).orderBy("file_no").collect()
    assert [r.n_rows for r in got] == [3, 3, 2] and rewrite.rewrite_clients(extra.limit(0)).count() == 0
    back = [x for r in got for x in pq.read_table(local(r.path)).to_pylist()]
    assert back[0]["client_id"] is None and sorted(r["client_id"] for r in back[1:]) == [0, 1, 2, 3, 7, 7, 9]
    assert all(len(r["name"]) == 200_000 and r["updated_at"] == day for r in back if r["client_id"] in (0, 1, 2, 3))


def test_rewrite_of_any_files(spark, tmp_path):
    fields = [rewrite.Field(1, "a", pa.int64()), rewrite.Field(2, "b", pa.string(), "?"), rewrite.Field(5, "c", pa.float64(), 0.5)]
    one = [rewrite.Field(9, "gone", pa.int32()), rewrite.Field(5, "a", pa.float32()), rewrite.Field(1, "z", pa.int16())]
    many = [{"gone": i, "a": i / 2, "z": i % 100 if i % 3 else None} for i in range(100_000)]
    pq.write_table(pa.Table.from_pylist(many, rewrite.arrow_schema(one)), tmp_path / "1.parquet", row_group_size=30_000)
    pq.write_table(pa.Table.from_pylist([], rewrite.arrow_schema(one)), tmp_path / "2.parquet")
    pq.write_table(pa.Table.from_pylist([{"a": 1, "b": None, "c": 2.0}], rewrite.arrow_schema(fields)), tmp_path / "3.parquet")
    stamp = os.stat(tmp_path / "3.parquet").st_mtime_ns
    files = spark.createDataFrame([(i, f"{tmp_path}/{i}.parquet") for i in (1, 2, 3)], "file_no long, path string")
    scratch = Scratch(spark, "any")
    got = {r.file_no: r for r in rewrite.rewrite_files(files, fields, 0, scratch, 3).collect()}
    table = pq.read_table(tmp_path / "1.parquet")
    assert table.schema.names == ["a", "b", "c"] and table["b"].to_pylist() == ["?"] * 100_000
    assert table["c"].to_pylist() == [r["a"] for r in many] and table["a"].to_pylist() == [r["z"] for r in many]
    assert got[1].n_nulls == 33_334 and got[2].n_rows == 0 and got[2].rewritten and not got[3].rewritten
    assert os.stat(tmp_path / "3.parquet").st_mtime_ns == stamp and pq.ParquetFile(tmp_path / "1.parquet").metadata.num_row_groups > 1
    again = {r.file_no: r for r in rewrite.rewrite_files(files, fields, 0, scratch, 3).collect()}
    assert not any(r.rewritten for r in again.values()) and all(again[i].rows_sha256 == got[i].rows_sha256 for i in got)
    rewrite._moved(f"{tmp_path}/1.parquet", f"{tmp_path}/none")  # a commit that runs again finds no draft
    with pytest.raises(ValueError):
        rewrite.column_plan(pa.schema([("a", pa.int64())]), fields)
    with pytest.raises(ValueError):
        rewrite.rewrite_files(files.union(files), fields, 0, scratch, 3)


def test_rows_of_one_key_lie_in_many_ranges(spark):
    rows = spark.range(4000, numPartitions=5).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), F.lit("same").alias("v"))
    ranked, n = rewrite.in_order(rows, ["k"], Scratch(spark, "ranks"))
    got = sorted((r._rank, r.k) for r in ranked.collect())
    assert n == 4000 and [r for r, _ in got] == list(range(4000)) and [k for _, k in got] == sorted(k for _, k in got)


def mined(rows, k=5, percent=80):
    """Plain version of hard-negative mining over (id, vector, label)."""
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1])

    held = [(i, [math.floor(256 * v) for v in x], label, n) for n, (i, x, label) in enumerate(rows) if usable((i, x, label))]
    out = []
    for i, x, label, n in (r for r in held if r[0] % 100 == 0):
        score = lambda r: sum(a * b for a, b in zip(x, r[1]))
        ranked = sorted(((-score(r), r[0], r[3], r[2]) for r in held if len(r[1]) == len(x)))
        positive = [r for r in ranked if r[3] == label and r[2] != n][:k]
        for p in positive:
            fit = [r for r in ranked if r[3] != label and percent * -p[0] <= 100 * -r[0] <= 100 * -p[0]][:k]
            out += [(i, p[1], rank + 1, r[1], -p[0], -r[0]) for rank, r in enumerate(fit)]
    return sorted(out)


def collected(frame):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in frame.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_negatives_of_the_table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    moved = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    assert collected(QUERIES["op12_hardneg"](spark, f"/root/testdata/{sf}")) == mined(moved)


def test_negatives_with_small_nodes(spark, monkeypatch):
    """Many leaves, several blocks, copies in all labels, other dimensions, rows that take no part."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(negatives, "LEAF", 24)
    rows = []
    for i in range(900):
        x = rng.normal(size=6) + 2 * (np.arange(6) == i % 6)
        rows.append((i, [float(v) for v in (np.round(x) if i % 3 else [1.0, 2, 0, 0, 1, 0])], int(rng.integers(0, 4))))
    rows += [(100, [1.0] * 6, 1), (100, [1.0] * 6, 1), (2000, [1.0, 2.0], 1), (2001, [1.0, 2.0], 1), (2002, [1.0, 1.9], 2), (3000, [], 1), (3100, None, 1), (3200, [1.0] * 6, None), (None, [1.0] * 6, 1), (3300, [float("nan")] * 6, 1), (3400, [float("inf")] * 6, 2), (3500, [1.0, None, 1.0, 1.0, 1.0, 1.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("mine") for c in ("row", "cell", "vector", "anchor", "rank")})
    want = mined(rows)
    assert len(want) > 100
    for block in (3, 8192):
        assert collected(negatives.hard_negatives(frame, "id % 100 = 0", block=block)) == want
    assert negatives.hard_negatives(frame.limit(0), "id % 100 = 0").count() == 0 == negatives.hard_negatives(frame, "id < 0").count()


def test_large_components_are_exact(spark):
    rows = [(0, [4e6, 4e6, 1.0], 1), (1, [4e6, 3.9e6, 2.0], 1), (2, [3.9e6, 4e6, 1.00390625], 2), (3, [3.9e6, 4e6, 1.0], 2), (4, [9e6, 9e6, 1.0], 2)]
    assert collected(negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "id % 100 = 0")) == mined(rows[:4])


def test_node_intervals_lose_nothing():
    rng = np.random.default_rng(11)
    a, b = rng.integers(-300, 300, (200, 8)), rng.integers(-300, 300, (500, 8)) + 200 * (np.arange(500) % 5)[:, None]
    la, lb = rng.integers(0, 3, 200), rng.integers(0, 3, 500)
    anchors, rows = negatives.Tree(a, la, 8), negatives.Tree(b, lb, 8)
    scores = a @ rows.x.T
    high = np.sort(scores, axis=1)[:, -20].astype(float)
    i, j = negatives.surviving(anchors, rows, high * 0.9, high, False)
    pairs = set(zip(i.tolist(), j.tolist()))
    place = {int(r): k for k in range(len(anchors.cuts[-1]) - 1) for r in anchors.order[anchors.cuts[-1][k] : anchors.cuts[-1][k + 1]]}
    node = np.searchsorted(rows.cuts[-1], np.arange(500), side="right") - 1
    for x, y in np.argwhere((scores >= (high * 0.9)[:, None]) & (scores <= high[:, None]) & (la[:, None] != rows.labels[None, :])).tolist():
        assert (place[x], int(node[y])) in pairs
    assert len(pairs) < (len(anchors.cuts[-1]) - 1) * (len(rows.cuts[-1]) - 1)


def held_whole(rows, texts, encode, length=2048, end=1):
    """Each id in one piece, sequences gapless, full or of a power of two."""
    ids = {i: encode(t or "") + [end] for i, t in texts.items()}
    at, used = {i: 0 for i in texts}, {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        own = list(struct.unpack(f"<{r.length}I", bytes(r.ids)))
        assert r.start == at[r.doc_id] and own == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert all(n <= length and (n == length or n & (n - 1) == 0) for n in used.values())
    return used


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_packing_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, tokenizer_spec()).collect()
    used = held_whole(rows, {r.doc_id: r.text for r in docs.collect()}, library())
    assert sum(used.values()) // 2048 <= len(used) <= sum(used.values()) // 2048 + 11
    got = {(r.doc_id, r.start): r for r in QUERIES["op13_packing"](spark, SF).collect()}
    assert {k: r.ids_crc32 for k, r in got.items()} == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}


def test_packing_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 3000)
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["ab", "Zürich", "12", "三"]) for _ in range(rng.randint(0, 60))) for i in range(200)}
    texts |= {500: None, 501: "", 502: "a<|endoftext|>b", 503: " " * 30_000, 504: "long text " * 20_000, 505: "x" * 5000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("id", "row", "grp", "ids", "length", "start")})
    held_whole(packing.pack(frame, tokenizer_spec()).collect(), texts, library())
    held_whole(packing.pack(frame, tokenizer_spec(), length=64, end=70_000).collect(), texts, library(), 64, 70_000)
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    rows = packing.pack(twice, tokenizer_spec()).collect()
    assert sum(r.length for r in rows) == 2 * 3 + 2 * 2 and sum(r.doc_id is None for r in rows) >= 2
    assert packing.pack(frame.limit(0), tokenizer_spec()).count() == 0


def test_first_fit_by_tournament():
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 300):
        sizes, plain = [rng.randint(1, 100) for _ in range(n)], []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            home = next((b for b in plain if sum(sizes[k] for k in b) + sizes[i] <= 100), None)
            plain.append([i]) if home is None else home.append(i)
        assert packing.first_fit_decreasing(sizes, 100) == plain

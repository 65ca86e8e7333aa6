"""Embedding near-deduplication with randomised-rotation binary codes (RaBitQ; Gao and Long, 2024).

A unit vector o is rotated at random and stored as the signs x of its coordinates, with the factor
f = <x, o>. For a rotated query q, <x, q> / f estimates <o, q> without bias, and the error is at most
sqrt((1 - f^2) / f^2) * eps / sqrt(D - 1) but for the tail of a standard normal beyond eps. Only pairs
whose upper bound reaches the threshold are computed again from the vectors, in double precision.

Candidates come from tables of sign bits: a pair meets if all bits of one table agree. Bits grow with
the logarithm of the row count, so buckets keep their size, and the number of tables follows from
the chosen miss probability.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.components import connected_components
from inkwell.llm.minhash import Forest
from inkwell.llm.scratch import Scratch, with_group
from inkwell.llm.tiles import in_tiles, over_groups

TILE = 256
BUCKET = 64
EPS = 5.0


@lru_cache(maxsize=256)
def rotation(dim: int, which: int) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    rng = np.random.Generator(np.random.PCG64([97, dim, which]))
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a table, and tables, for n vectors."""
    bits = max(8, ceil(log2(max(n, 1) / BUCKET)))
    agree = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(miss) / log(1 - agree))


def table_keys(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables) keys of unit vectors: bits of rotated signs, hashed if they need more than 63."""
    dim = units.shape[1]
    planes = [units @ rotation(dim, 1 + r).T > 0 for r in range(-(-bits * tables // dim))]
    signs = np.concatenate(planes, axis=1)[:, : bits * tables].reshape(len(units), tables, bits)
    weight = np.uint64(1) << (np.arange(bits, dtype=np.uint64) % np.uint64(63))
    mult = np.where(np.arange(bits) < 63, 1, 0x9E3779B97F4A7C15).astype(np.uint64)
    return (signs * (weight * mult)).sum(axis=2, dtype=np.uint64).view(np.int64)


class Codes:
    """Signs, factors and rotated queries of unit vectors."""

    def __init__(self, signs: np.ndarray, factor: np.ndarray, query: np.ndarray):
        self.signs, self.factor, self.query = signs, factor, query

    @classmethod
    def of(cls, units: np.ndarray) -> Codes:
        turned = units @ rotation(units.shape[1], 0).T
        signs = np.where(turned > 0, 1.0, -1.0).astype(np.float32)
        return cls(signs, np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1]), turned.astype(np.float32))

    def take(self, rows: slice) -> Codes:
        return Codes(self.signs[rows], self.factor[rows], self.query[rows])

    def may_reach(self, threshold: float) -> np.ndarray:
        """Symmetric mask of pairs whose similarity bound, from either side, reaches the threshold."""
        dim = self.signs.shape[1]
        f = np.maximum(self.factor, 1e-9)[:, None]
        estimate = (self.signs @ self.query.T) / np.sqrt(dim) / f
        bound = np.sqrt(np.maximum(1 - f * f, 0)) / f * EPS / np.sqrt(max(dim - 1, 1)) + 1e-2  # 8-bit queries
        upper = estimate + bound >= threshold
        return upper & upper.T


def _units(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dim, vector`` (doubles) and ``vkey``; the last three are null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False) + 0.0
            off = np.concatenate([[0], np.cumsum(sizes)])
            full = np.flatnonzero(sizes > 0)
            top = np.zeros(len(sizes))
            if len(full):
                top[full] = np.maximum.reduceat(np.abs(flat), off[:-1][full])  # nan if any component is
            good = np.isfinite(top) & (top > 0)
            odd = good & ~((top > 1e-100) & (top < 1e100))
            # squares of such components leave the range of doubles; cosine ignores scale
            flat = flat / np.repeat(np.where(odd, top, 1.0), sizes)
            dims = pc.if_else(pa.array(good), pa.array(sizes), pa.scalar(None, pa.int64()))
            raws = [flat[a:b].tobytes() if g else None for a, b, g in zip(off[:-1].tolist(), off[1:].tolist(), good.tolist())]
            keys = [hashlib.blake2b(r, digest_size=16).digest() if r is not None else None for r in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), dims.cast(pa.int32()), pa.array(raws, pa.binary()), pa.array(keys, pa.binary())], names=["id", "dim", "vector", "vkey"])

    return rows.select(F.col(id_col), F.col(vector_col).cast("array<double>")).mapInArrow(run, "id long, dim int, vector binary, vkey binary")


def similar_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, miss: float = 1e-6, scratch: Scratch | None = None) -> DataFrame:
    """``(<id_col>, n_links, component_id, kept)``, one row per input row.

    Two vectors of one dimension are linked if their cosine, in double precision, is at least
    ``threshold``. Equal vectors form one class that is compared once and counted with its size.
    ``component_id`` is the smallest id reachable by links.

    A linked pair at the threshold is missed with probability ``miss`` by the tables; EPS bounds what the
    codes may miss alike. Candidates and links of a bucket stay in its task, which returns, for each
    member, a count and a parent, never pairs; buckets beyond ``TILE`` rows are dealt in tiles.

    Null, empty or zero vectors and those with a null or non-finite component have no links and are
    kept. A row with a null id links with nothing: ``component_id`` null, kept. Rows that repeat an id
    stay, judged by their own vector; each counts. ``<id_col>`` is a number. Other columns are ignored; an empty
    table gives an empty result.
    """
    scratch = scratch or Scratch(rows.sparkSession, "rabitq")
    every = scratch.save(_vectors(rows, id_col, vector_col), "vectors")
    named = every.where("vkey is not null and id is not null")
    # numbers of classes rise with their smallest ids
    classes = named.groupBy("vkey").agg(F.min("id").alias("rep"), F.count("*").alias("size")).orderBy("rep")
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = named.join(classes.select(F.col("rep").alias("id"), "vkey", "node", "size"), ["id", "vkey"]).dropDuplicates(["node"])
    reps = scratch.save(reps.select(F.col("node").alias("id"), "dim", "vector", "size"), "reps")
    bits, tables = table_plan(reps.count(), threshold, miss)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                _, units = _units(part.column(2))
                codes = Codes.of(units)
                scale = np.abs(codes.query).max(axis=1) / 127
                query = np.round(codes.query / np.maximum(scale, 1e-30)[:, None]).astype(np.int8)
                packed = np.packbits(codes.signs > 0, axis=1)
                keys = table_keys(units, bits, tables)
                for a in range(0, len(units), 256):
                    n = len(units[a : a + 256])
                    code = [packed[i].tobytes() + np.float32([codes.factor[i], scale[i]]).tobytes() + query[i].tobytes() for i in range(a, a + n)]
                    yield pa.RecordBatch.from_pydict({"id": part.column(0).slice(a, n), "dim": part.column(1).slice(a, n), "code": pa.array(code, pa.binary()), "keys": pa.array(list(keys[a : a + n]), pa.list_(pa.int64()))})

    coded = scratch.save(reps.mapInArrow(keyed, "id long, dim int, code binary, keys array<long>"), "codes")
    buckets = coded.select("id", "dim", F.posexplode("keys").alias("tab", "bucket"))
    group = ["dim", "tab", "bucket", "lo", "hi"]
    sizes = scratch.save(buckets.groupBy("dim", "tab", "bucket").agg(F.count("*").alias("_n")).where("_n > 1"), "buckets")
    tiled = in_tiles(buckets, ["dim", "tab", "bucket"], "id", TILE, sizes).join(coded.select("id", "code"), "id")

    def survivors(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        dims, lo, hi, side = (table.column(c).to_numpy() for c in ("dim", "lo", "hi", "side"))
        code, keep = table.column("code").to_pylist(), np.zeros(len(table), bool)
        for a, b in zip(bounds[:-1], bounds[1:]):
            dim = int(dims[a])
            nb = -(-dim // 8)
            raw = np.frombuffer(b"".join(code[a:b]), np.uint8).reshape(b - a, -1)
            signs = np.unpackbits(raw[:, :nb], axis=1, count=dim).astype(np.float32) * 2 - 1
            head = np.ascontiguousarray(raw[:, nb : nb + 8]).view(np.float32)
            query = np.ascontiguousarray(raw[:, nb + 8 :]).view(np.int8).astype(np.float32) * head[:, 1:]
            ok = Codes(signs, head[:, 0].astype(np.float64), query).may_reach(threshold)
            ok &= _meets(lo[a], hi[a], side[a:b])
            keep[a:b] = ok.any(axis=1)
        if not keep.any():
            return None
        return table.filter(pa.array(keep)).select(["id", "side", *group]).combine_chunks().to_batches()[0]

    hit = over_groups(tiled.select("id", "code", "side", *group), group, survivors, "id long, side int, dim int, tab int, bucket long, lo int, hi int")
    again = hit.join(reps.select("id", "vector", "size"), "id").select("id", "side", "vector", "size", *group)

    def exact(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        ids, size, tab, lo, hi, side = (table.column(c).to_numpy() for c in ("id", "size", "tab", "lo", "hi", "side"))
        vector, out = table.column("vector"), ([], [], [])
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            raw, units = _units(vector.slice(a, b - a))
            keys, ok = table_keys(units, bits, tables), Codes.of(units).may_reach(threshold)
            ok &= _meets(lo[a], hi[a], side[a:b])
            i, j = np.nonzero(np.triu(ok, 1))
            first = (keys[i] == keys[j]).argmax(axis=1) == tab[a]  # a pair counts in the first table where it meets
            i, j = i[first], j[first]
            norm = np.linalg.norm(raw, axis=1)
            linked = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            links, forest = np.zeros(b - a, np.int64), Forest(b - a)
            np.add.at(links, i, size[a + j])
            np.add.at(links, j, size[a + i])
            for x, y in zip(i.tolist(), j.tolist()):
                forest.join(x, y)
            for x in np.flatnonzero(links).tolist():
                out[0].append(ids[a + x])
                out[1].append(links[x])
                out[2].append(ids[a + forest.find(x)])
        if not out[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "links", "parent"])

    found = scratch.save(over_groups(again, group, exact, "id long, links long, parent long"), "links")
    linked = scratch.save(connected_components(found.select(F.col("id").alias("a"), F.col("parent").alias("b")), scratch), "linked")
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    names = linked.join(classes.select(F.col("node").alias("component"), F.col("rep").alias("component_id")), "component").drop("component")
    of_class = classes.withColumnRenamed("node", "id").join(count, "id", "left").join(names, "id", "left")
    of_class = of_class.select("vkey", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    of_class = scratch.save(of_class, "of_class")
    scratch.keep(every, of_class)
    out = with_group(every.select("id", F.when(F.col("id").isNotNull(), F.col("vkey")).alias("vkey")), of_class, ["vkey"], size="size", how="left")
    whole = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"), F.coalesce(whole == F.col("id"), F.lit(True)).alias("kept"))


def _meets(lo: int, hi: int, side: np.ndarray) -> np.ndarray:
    """Pairs of rows that this tile group is to compare, without the diagonal."""
    apart = ~np.eye(len(side), dtype=bool)
    return apart if lo == hi else apart & (side[:, None] != side[None, :])

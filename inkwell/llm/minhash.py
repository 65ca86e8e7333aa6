"""MinHash near-deduplication with sequential Bayesian verification.

Texts of equal word sequences form one class first, so groups of exact copies cost nothing later.
Signatures of class representatives are banded; of two texts that share a bucket, signature batches are
compared one after the other and the pair is pruned as soon as the posterior probability of a similarity
at or above the threshold falls under ``miss``. Survivors are verified on their shingles as words.

A bucket of n texts doesn't cost n * n: each text is first held against the smallest one of its buckets,
then, where these differ from its component, against the smallest of every bucket. Only buckets in which
texts of several components are left compare more: those outside the bucket's largest component with
all others, in tiles. So a group of copies costs n comparisons, and no pair is left out but those whose ends
are known to be connected. Nothing emits pairs: tasks return the links of a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.components import connected_components
from inkwell.llm.scratch import Scratch, semi_join_ids, text_key, with_group
from inkwell.llm.tiles import over_groups
from inkwell.llm.tokens import mix, sequences, shingle_sets, shingles, slices, split_words, text_buffers

ROWS = 5
#: Probability with which a pair at the threshold shares no band.
BAND_MISS = 5e-7
#: Texts of a tile, and texts that one copy of a representative meets.
TILE, SHARE = 256, 64
#: Up to so many row keys (about 64 bytes each when hashed) are broadcast, after they were counted.
BROADCAST_ROWS = 1_000_000

_BAND = np.random.Generator(np.random.PCG64(43)).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def bands_for(percent: int) -> int:
    """The fewest bands of ``ROWS`` rows that a pair at the threshold escapes with at most ``BAND_MISS``: 25 for 85, 37 for 80."""
    return ceil(log(BAND_MISS) / log1p(-((percent / 100) ** ROWS))) if percent < 100 else 1


@lru_cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(41))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """32-bit minima of multiply-shift hashes of a non-empty set."""
    out = np.full(permutations, 0xFFFFFFFF, dtype=np.uint32)
    a, b = _hashes(permutations)
    for i in range(0, len(shingles), 2048):
        h = (shingles[None, i : i + 2048] * a[:, None] + b[:, None]) >> np.uint64(32)
        np.minimum(out, h.min(axis=1).astype(np.uint32), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, bands) 64-bit keys of (n, bands * ROWS) signatures."""
    rows = signatures.reshape(len(signatures), signatures.shape[1] // ROWS, ROWS).astype(np.uint64)
    acc = np.zeros(rows.shape[:2], np.uint64)
    for r in range(ROWS):
        acc = mix(acc + rows[:, :, r] * _BAND[r])
    return acc


def least_matches(threshold: float, miss: float, permutations: int | None = None) -> list[tuple[int, int]]:
    """For each batch end n, the fewest matches m with P(J >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at t equals
    P(Binomial(n + 1, t) <= m).
    """
    out, permutations = [], permutations or ROWS * bands_for(round(100 * threshold))
    for n in [*range(ROWS * 5, permutations, ROWS * 5), permutations]:
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss or m == n:
                break
            m += 1
        out.append((n, m))
    return out


class Forest:
    """Union-find over local rows."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _posterior_survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that no batch prunes, and their matches."""
    matches, begin = np.zeros(len(i), np.int32), 0
    for end, least in limits:
        matches = matches + (sig[i, begin:end] == sig[j, begin:end]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches, begin = i[keep], j[keep], matches[keep], end
    return i, j, matches


def _matrix(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, permutations: int) -> DataFrame:
    """One row per document: ``id``, ``text_key``, ``n_shingles``, ``words_key`` (of the word sequence) and ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                text = text_buffers(part.column(1))
                sets = list(shingle_sets(*text, shingle_words))
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0).cast(pa.int64()),
                    "text_key": part.column(2),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "words_key": pa.array([hashlib.blake2b(w, digest_size=16).digest() if w else None for w in sequences(*text)], pa.binary()),
                    "sig": pa.array([signature(s, permutations).tobytes() if len(s) else None for s in sets], pa.binary()),
                })

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), text, text_key(text)).mapInArrow(run, "id long, text_key binary, n_shingles long, words_key binary, sig binary")


class _Sets:
    """Shingles of the texts of a table, made when first asked for."""

    def __init__(self, texts: pa.ChunkedArray, width: int):
        self.texts, self.width, self.made = texts, width, {}

    def __getitem__(self, i: int) -> set:
        if i not in self.made:
            self.made[i] = shingles(split_words(self.texts[i].as_py().encode()), self.width)
        return self.made[i]

    def linked(self, i: int, j: int, percent: int) -> bool:
        a, b = self[i], self[j]
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        both = len(a & b)
        return 100 * both >= percent * (len(a) + len(b) - both)


def _links(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not found:
        return None
    at = np.array(found)
    return pa.RecordBatch.from_pydict({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})


def _verified(pairs: DataFrame, payload: DataFrame, limits: list[tuple[int, int]], percent: int, width: int, permutations: int, scratch: Scratch) -> DataFrame:
    """Links ``(a, b)`` among distinct pairs ``(node, rep)``: each ``rep`` meets its nodes in groups of ``SHARE``.

    A representative of many nodes is sent once for each ``SHARE`` of them, so it makes no hot key.
    """
    pairs = scratch.save(pairs, "pairs")
    count = scratch.save(pairs.groupBy("rep").agg(F.count("*").alias("_n")), "reps")
    shares = F.ceil(F.col("_n") / SHARE).cast("int")
    salted = with_group(pairs, count, ["rep"]).select("node", "rep", F.pmod(F.xxhash64("node"), shares.cast("long")).cast("int").alias("share"))
    salted = salted.unionByName(count.select(F.col("rep").alias("node"), "rep", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share")))

    def work(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        ids, reps, sig = table.column("node").to_numpy(), table.column("rep").to_numpy(), _matrix(table.column("sig"), np.uint32, permutations)
        own = np.flatnonzero(ids == reps)  # a group has one such row
        i = np.flatnonzero(ids != reps)
        j = own[np.searchsorted(bounds, i, side="right") - 1]
        sets = _Sets(table.column("text"), width)
        i, j, _ = _posterior_survivors(sig, i, j, limits)
        return _links(ids, [(x, y) for x, y in zip(i.tolist(), j.tolist()) if sets.linked(x, y, percent)])

    rows = salted.join(payload, "node").select("node", "rep", "share", "sig", "text")
    return over_groups(rows, ["rep", "share"], work, "a long, b long", chunk_rows=512)


def _rest(buckets: DataFrame, members: DataFrame, payload: DataFrame, limits: list[tuple[int, int]], percent: int, width: int, permutations: int) -> DataFrame:
    """Links across components in buckets: members outside a bucket's largest component against all of other ones.

    Both sides are dealt in tiles, so a group holds at most ``2 * TILE`` rows or so; the number of groups is that of the tiles
    outside times that of all, which is linear in a bucket's size while few are outside. Tiles are first compared by
    signatures alone; only members with a pair that these leave a chance take their texts to the tile.
    """
    group = ["band", "bucket"]
    rows = with_group(members, buckets, group)
    hashed = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("node")), F.col(n).cast("long")).cast("int")
    rows = rows.withColumns({"outs": F.ceil((F.col("_n") - F.col("main_n")) / TILE).cast("int"), "alls": F.ceil(F.col("_n") / TILE).cast("int")})
    out = rows.where("component <> main").withColumn("lo", hashed(1, "outs")).withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("alls") - 1))).withColumn("out", F.lit(True))
    every = rows.withColumn("hi", hashed(2, "alls")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("outs") - 1))).withColumn("out", F.lit(False))
    tile, columns = [*group, "lo", "hi"], ["node", "component", "main", *group, "lo", "hi", "out"]

    def candidates(table: pa.Table, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, part, main, band, out = (table.column(c).to_numpy(zero_copy_only=False) if c == "out" else table.column(c).to_numpy() for c in ("node", "component", "main", "band", "out"))
        sig = _matrix(table.column("sig"), np.uint32, permutations)
        keys = band_keys(sig)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            left, right = a + np.flatnonzero(out[a:b]), a + np.flatnonzero(~out[a:b])
            for k in range(0, len(left), 256):
                i, j = (x.ravel() for x in np.meshgrid(left[k : k + 256], right, indexing="ij"))
                # of two members outside, one order is enough
                ok = (part[i] != part[j]) & ((part[j] == main[j]) | (ids[i] < ids[j]))
                i, j = i[ok], j[ok]
                ok = (keys[i] == keys[j]).argmax(axis=1) == band[i]  # a pair counts in the first band it shares
                yield _posterior_survivors(sig, i[ok], j[ok], limits)

    def near(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        hit = np.zeros(len(table), bool)
        for i, j, _ in candidates(table, bounds):
            hit[i] = hit[j] = True
        return table.select(columns).filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else None

    def linked(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        ids, part, sets, found = table.column("node").to_numpy(), table.column("component").to_numpy(), _Sets(table.column("text"), width), []
        label = {c: k for k, c in enumerate(np.unique(part).tolist())}
        forest = Forest(len(label))
        place = np.array([label[c] for c in part.tolist()])
        for i, j, matches in candidates(table, bounds):
            order = np.argsort(-matches, kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if forest.find(place[x]) != forest.find(place[y]) and sets.linked(x, y, percent):
                    forest.join(int(place[x]), int(place[y]))
                    found.append((x, y))
        return _links(ids, found)

    signed = out.unionByName(every).select(*columns).join(payload.select("node", "sig"), "node").select(*columns, "sig")
    hits = over_groups(signed, tile, near, "node long, component long, main long, band int, bucket long, lo int, hi int, out boolean", chunk_rows=512)
    return over_groups(hits.join(payload, "node").select(*columns, "sig", "text"), tile, linked, "a long, b long", chunk_rows=512)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, shingle_words: int = 5, miss: float = 1e-9, scratch: Scratch | None = None) -> DataFrame:
    """``(<id_col>, n_shingles, component_id, kept, text_key, words_key, first)``, one row per input row; ``<id_col>`` is a number.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their shingle sets, as
    confirmed on the words of the full sets. ``component_id`` is the smallest id reachable by links, ``kept``
    says that it is the row's own.

    There are as many bands as it takes for a pair at the threshold to be missed by all of them with at most
    ``BAND_MISS``; each pruning step misses it with the posterior probability ``miss``. ``n_shingles`` counts 64-bit
    keyed hashes.

    Null or empty text, or text without words: ``n_shingles`` 0, a component of its own, kept. A text of any length
    is read whole. A null id can't name a component: ``component_id`` null, kept. Rows that repeat an id stay, one
    output row each, judged by their own text; ``text_key`` tells them apart (``scratch.text_key``), and
    ``first`` says that the row's word sequence is the first of its component, whatever ids repeat. Other
    columns are ignored whatever their names; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    n_bands = bands_for(percent)
    permutations = n_bands * ROWS
    how = limits, percent, shingle_words, permutations = least_matches(percent / 100, miss, permutations), percent, shingle_words, permutations
    rows = scratch.save(sketch(docs, id_col, text_col, shingle_words, permutations), "sketch")
    named = rows.where("n_shingles > 0 and id is not null")
    # numbers of classes rise with their smallest ids
    classes = named.groupBy("words_key").agg(F.min("id").alias("rep"), F.count("*").alias("_n")).orderBy("rep")
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    own = named.join(classes.select(F.col("rep").alias("id"), "words_key", "node"), ["id", "words_key"]).dropDuplicates(["node"])
    own = scratch.save(own.select("node", "id", "text_key", "sig"), "own")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column(1), np.uint32, permutations)).view(np.int64)
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.repeat(batch.column(0).to_numpy(), n_bands)), "band": pa.array(np.tile(np.arange(n_bands, dtype=np.int32), len(keys))), "bucket": pa.array(keys.ravel())})

    group = ["band", "bucket"]
    banded = own.select("node", "sig").mapInArrow(bands, "node long, band int, bucket long")
    buckets = scratch.save(banded.groupBy(*group).agg(F.count("*").alias("_n"), F.min("node").alias("least")).where("_n > 1"), "buckets")
    members = scratch.save(with_group(banded, buckets, group).select("node", *group, "least"), "members")
    first = members.groupBy("node").agg(F.min("least").alias("rep"))
    seen = scratch.save(first.join(own.drop("sig"), "node"), "candidates")
    wanted = own.select("node", "sig").join(seen, "node")
    spaced = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    spaced = semi_join_ids(spaced, "id", seen.select("id"))
    payload = scratch.save(wanted.join(spaced, ["id", "text_key"]).dropDuplicates(["node"]).select("node", "sig", "text"), "payload")
    links = scratch.save(_verified(seen.where("rep < node").select("node", "rep"), payload, *how, scratch), "links1")

    part = scratch.save(connected_components(links, scratch), "parts1")
    members = scratch.save(_labelled(members, part), "members1")
    least = F.min(F.struct("node", "component"))
    buckets = scratch.save(members.groupBy(*group).agg(F.count("*").alias("_n"), least.alias("first"), F.max("component").alias("most"), F.min("component").alias("fewest")).where("most <> fewest").select(*group, "_n", F.col("first.node").alias("rep"), F.col("first.component").alias("rep_component")), "buckets1")
    if not buckets.isEmpty():
        members = scratch.save(with_group(members, buckets, group), "members2")
        again = members.where("component <> rep_component").select("node", "rep").distinct().join(seen.select("node", "rep"), ["node", "rep"], "left_anti")
        links = scratch.save(links.unionAll(_verified(again, payload, *how, scratch)), "links2")
        part = scratch.save(connected_components(links, scratch), "parts2")
        members = scratch.save(_labelled(members.select("node", *group), part), "members3")
        share = members.groupBy(*group, "component").agg(F.count("*").alias("n")).groupBy(*group).agg(F.sum("n").alias("_n"), F.max(F.struct("n", "component")).alias("main"))
        buckets = scratch.save(share.select(*group, "_n", F.col("main.n").alias("main_n"), F.col("main.component").alias("main")).where("_n > main_n"), "buckets3")
        if not buckets.isEmpty():
            links = scratch.save(links.unionAll(_rest(buckets, members, payload, *how)), "links3")
            part = scratch.save(connected_components(links, scratch), "parts3")

    names = classes.select(F.col("node").alias("component"), F.col("rep").alias("component_id"))
    of_node = part.join(names, "component").select(F.col("id").alias("node"), "component_id", (F.col("id") == F.col("component")).alias("first"))
    of_class = classes.join(of_node, "node", "left").select("words_key", "_n", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))
    of_class = scratch.save(of_class, "of_class")
    scratch.keep(rows, of_class)
    out = with_group(rows.select("id", "text_key", "n_shingles", "words_key"), of_class, ["words_key"], how="left")
    whole = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", whole.alias("component_id"), F.coalesce(whole == F.col("id"), F.lit(True)).alias("kept"), "text_key", "words_key", F.coalesce("first", F.lit(True)).alias("first"))


def without_copies(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row of each group of ``near_duplicates``, with all columns: that of the smallest id, then of the smallest ``text_key``.

    Rows are matched by id and text, so a repeated id takes no other text along; of rows that repeat both, one stays. Rows
    with a null id and rows without words stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "copies")
    key, row = "_id", "_row"
    while {key, row} & set(docs.columns):
        key, row = key + "_", row + "_"
    judged = found.where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)).select(F.col(id_col).alias(key), F.col("text_key").alias(row), "words_key", (F.col("kept") & F.col("first")).alias("stays"))
    judged = scratch.save(judged, "judged")
    gone = judged.where("not stays").select(key, row)
    several = scratch.save(judged.where("stays").groupBy(key, "words_key").agg(F.count("*").alias("n"), F.min(row).alias("least")).where("n > 1"), "several")
    again = None
    if not several.isEmpty():  # ids that repeat with the same words
        same = judged.where("stays").join(several.select(key, "words_key", "least"), [key, "words_key"])
        gone = gone.unionAll(same.select(key, row))
        again = same.where(F.col(row) == F.col("least")).select(key, row).distinct()
        again = scratch.save(again, "again")
    gone = scratch.save(gone.distinct(), "gone")
    scratch.keep(gone, *([again] if again is not None else []))

    def match(keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if small else keys
        return docs.join(keys, (docs[id_col].cast("long") == keys[key]) & (text_key(docs[text_col]) == keys[row]), how)

    small = gone.count() <= BROADCAST_ROWS
    left = match(gone, "left_anti")
    if again is None:
        return left
    one = match(again, "left_semi").withColumn(row, text_key(F.col(text_col))).dropDuplicates([id_col, row]).drop(row)
    return left.unionByName(one)


def _labelled(members: DataFrame, part: DataFrame) -> DataFrame:
    """Members with their component, by default themselves."""
    return members.join(part.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))

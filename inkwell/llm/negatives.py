"""Hard negatives by dual-tree search over anchors and candidates.

Candidates lie in packed leaves of a tree: its upper part, fitted on a bounded sample, sends each row to a cell;
a cell is packed into leaves of bounded size, each of which carries a small tree of its own. Anchors of a block
form another tree. Nodes of both kinds know a ball around their rows (centre and radius) and the range of
their labels, so a pair of nodes has an interval that holds each inner product between its rows:

    <a, c> - r_a |c| - r_c |a| - r_a r_c  <=  score  <=  <a, c> + r_a |c| + r_c |a| + r_a r_c

Pairs of nodes are walked from both roots down. A pair goes, with all anchors below it at once, if its interval misses
every window that these anchors still look for, or if no labels in it fit. Rows of leaf pairs that remain
are scored exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.scratch import Scratch, drawn, with_group
from inkwell.llm.tiles import over_groups

#: Rows of a packed leaf, rows of the smallest nodes, anchors of a block, and the sample of the upper tree.
LEAF, NODE, BLOCK, SAMPLE = 1024, 32, 8192, 20_000
#: Levels of the upper tree at most.
LEVELS = 12
#: Bytes of a block of anchors, as broadcast.
BLOCK_BYTES = 32 << 20
#: Squared norms beyond this could make scores that no long holds.
LARGEST = float(1 << 62)
#: Squared norms up to this give scores that doubles hold exactly.
EXACT = float(1 << 53)


class Tree:
    """A balanced tree over rows of whole numbers: level l has 2^l runs of ``order``, halves of the runs above.

    Runs with several labels are halved by label, others by the component that varies most.
    """

    def __init__(self, x: np.ndarray, labels: np.ndarray, node: int = NODE):
        n = len(x)
        self.depth = max(0, (max(n, 1) - 1) // node).bit_length()
        order = np.arange(n)
        self.cuts = [np.array([0, n])]
        for _ in range(self.depth):
            cuts = self.cuts[-1]
            halves = [0]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part, half = order[a:b], (b - a) // 2
                if b - a > 1:
                    own = labels[part]
                    by = own if own.min() != own.max() else x[part, np.ptp(x[part], axis=0).argmax()]
                    order[a:b] = part[np.argpartition(by, half)]
                halves += [a + half, b]
            self.cuts.append(np.array(halves))
        self.order, self.x, self.labels = order, x[order], labels[order]
        point = self.x.astype(np.float64)
        self.centre, self.radius, self.norm, self.low, self.high = [], [], [], [], []
        for cuts in self.cuts:
            a, b = cuts[:-1], cuts[1:]
            full = np.flatnonzero(b > a)
            size = np.maximum(b - a, 1)
            centre = np.zeros((len(a), x.shape[1]))
            radius, low, high = np.full(len(a), -np.inf), np.zeros(len(a), np.int64), np.full(len(a), -1, np.int64)
            if len(full):
                starts = a[full]  # runs adjoin, empty ones hold nothing
                centre[full] = np.add.reduceat(point, starts) / size[full, None]
                away = np.sqrt(((point - np.repeat(centre[full], size[full], axis=0)) ** 2).sum(axis=1))
                radius[full] = np.maximum.reduceat(away, starts)
                low[full], high[full] = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
            self.centre.append(centre)
            self.radius.append(radius)
            self.norm.append(np.sqrt((centre**2).sum(axis=1)))
            self.low.append(low)
            self.high.append(high)

    def least(self, values: np.ndarray, level: int, worst: float, take: np.ufunc) -> np.ndarray:
        """The least or greatest of the values (in the rows' own order) in each node of a level."""
        a, b = self.cuts[level][:-1], self.cuts[level][1:]
        full, out = np.flatnonzero(b > a), np.full(len(a), worst)
        if len(full):
            out[full] = take.reduceat(values[self.order], a[full])
        return out


def surviving(anchors: Tree, rows: Tree, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of smallest nodes (anchor node, row node) that may hold a score an anchor looks for.

    ``low`` and ``high`` bound what each anchor looks for, whether among rows of its own label or of others.
    """
    i = j = np.zeros(1, np.int64)
    la = lb = 0
    while True:
        lows, highs = anchors.least(low, la, np.inf, np.minimum), anchors.least(high, la, -np.inf, np.maximum)
        ra, rb = anchors.radius[la][i], rows.radius[lb][j]
        some = np.isfinite(ra) & np.isfinite(rb)
        i, j, ra, rb = i[some], j[some], ra[some], rb[some]
        mid = np.einsum("ij,ij->i", anchors.centre[la][i], rows.centre[lb][j])
        na, nb = anchors.norm[la][i], rows.norm[lb][j]
        far = ra * nb + rb * na + ra * rb
        far += 1e-9 * (np.abs(mid) + far + (na + ra) * (nb + rb)) + 1e-6  # rounding of centres and products
        keep = (mid + far >= lows[i]) & (mid - far <= highs[i])
        if same:
            keep &= (anchors.low[la][i] <= rows.high[lb][j]) & (rows.low[lb][j] <= anchors.high[la][i])
        else:
            keep &= ~((anchors.low[la][i] == anchors.high[la][i]) & (rows.low[lb][j] == rows.high[lb][j]) & (anchors.low[la][i] == rows.low[lb][j]))
        i, j = i[keep], j[keep]
        down_a, down_b = la < anchors.depth, lb < rows.depth
        if not len(i) or not (down_a or down_b):
            return i, j
        if down_a:
            i, j, la = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j]), la + 1
        if down_b:
            i, j, lb = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1]), lb + 1


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = lambda x: float((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    if most(a) * most(b) < EXACT**2:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The first ``k`` rows found for each of n slots: higher scores first, then smaller ids, then smaller row numbers."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()  # a score under ``least`` can't be among the first k
        self.slot = self.score = self.id = self.row = np.zeros(0, np.int64)
        self.count = np.zeros(n, np.int64)

    def add_all(self, new: list[tuple[np.ndarray, ...]]) -> None:
        """Takes ``(slot, score, id, row)`` of what a leaf holds."""
        if not any(len(x[0]) for x in new):
            return
        slot, score, ids, row = (np.concatenate(x) for x in zip((self.slot, self.score, self.id, self.row), *new))
        order = np.lexsort((row, ids, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        kept = np.arange(len(slot)) - first < self.k
        order, self.slot = order[kept], slot[kept]
        self.score, self.id, self.row = score[order], ids[order], row[order]
        self.count = np.bincount(self.slot, minlength=len(self.count))
        full = np.flatnonzero(self.count == self.k)
        self.least[full] = np.maximum(self.least[full], self.score[np.searchsorted(self.slot, full, side="right") - 1])


def _whole(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, dim, vector`` of rows that take part; vectors are 32-bit whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False) + 0.0
            off = np.concatenate([[0], np.cumsum(sizes)])
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(flat * 256)
                square = np.concatenate([[0.0], x * x])
            bad = np.zeros(len(sizes), bool)
            for a in np.unique(np.searchsorted(off, np.flatnonzero(~np.isfinite(x) | (np.abs(x) >= 2.0**31)), side="right") - 1).tolist():
                bad[a] = True
            norms = np.array([square[a + 1 : b + 1].sum() for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
            good = np.flatnonzero(~bad & (norms < LARGEST) & (sizes > 0))
            x = np.where(np.isfinite(x) & (np.abs(x) < 2.0**31), x, 0).astype("<i4")
            raws = [x[off[i] : off[i + 1]].tobytes() for i in good.tolist()]
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes[good], pa.int32()), pa.array(raws, pa.binary())], names=["id", "label", "dim", "vector"])

    picked = rows.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.col(vector_col).cast("array<double>")).dropna()
    return picked.mapInArrow(run, "id long, label long, dim int, vector binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), -1).astype(np.int64)


def _splits(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and bound of each inner node of an upper tree, in heap order; the last column is the label."""
    column, bound = np.zeros((1 << levels) - 1, np.int64), np.full((1 << levels) - 1, np.iinfo(np.int64).max)
    held = {0: np.arange(len(x))}
    for node in range(len(column)):
        rows = held.pop(node)
        if len(rows) > 1:
            spread = np.ptp(x[rows], axis=0)
            column[node] = len(spread) - 1 if spread[-1] else spread.argmax()
            values = np.sort(x[rows, column[node]])
            bound[node] = values[(len(values) - 1) // 2]
            if bound[node] == values[-1]:
                bound[node] -= 1  # a bound that parts the most frequent value from what is below it
        right = x[rows, column[node]] > bound[node]
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return column, bound


def _cells(x: np.ndarray, column: np.ndarray, bound: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    while len(column) and node.min(initial=len(column)) < len(column):
        node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > bound[node])
    return node - len(column)


def celled_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows ``(row, id, label, dim, vector)``, of a written table, with their ``cell`` in an upper tree for each dimension.

    A tree is fitted on at most ``SAMPLE`` rows of all, drawn by hash; the 1000 most frequent dimensions have one.
    """
    total = rows.count()
    sizes = dict(map(tuple, rows.groupBy("dim").count().orderBy(F.desc("count")).limit(1000).collect()))
    sample = rows.where(drawn(F.col("row"), total, SAMPLE)).select("dim", "label", "vector")
    trees = {}
    for dim, part in sample.toPandas().groupby("dim") if total else ():
        x = np.column_stack([_matrix(pa.array(part.vector)), part.label.to_numpy()])
        trees[int(dim)] = _splits(x, min(LEVELS, max(0, int(np.ceil(np.log2(max(1, sizes.get(dim, 0) / LEAF)))))))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(len(batch), np.int64)
            for dim in np.unique(dims).tolist():
                if dim in trees:
                    at = np.flatnonzero(dims == dim)
                    part = batch.take(pa.array(at))
                    cell[at] = _cells(np.column_stack([_matrix(part.column("vector")), part.column("label").to_numpy()]), *trees[dim])
            yield batch.append_column("cell", pa.array(cell))

    return scratch.save(rows.mapInArrow(routed, "row long, id long, label long, dim int, vector binary, cell long"), "celled")


def packed_leaves(celled: DataFrame, equal: int, scratch: Scratch) -> DataFrame:
    """Leaves ``(dim, cell, piece, ids, labels, row, vectors)`` of the rows that can be among the first of any anchor.

    Rows of equal vector and label tie for each anchor, so only the ``equal`` smallest ids of them can be found: the others
    have no place in the leaves. A cell of more than ``LEAF`` rows is dealt into several leaves.
    """
    first = F.row_number().over(Window.partitionBy("dim", "cell", "label", "vector").orderBy("id", "row"))
    celled = scratch.save(celled.withColumn("_first", first).where(F.col("_first") <= equal).drop("_first"), "candidates")
    counts = scratch.save(celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("_n")), "cells")
    pieces = counts.withColumn("_pieces", F.ceil(F.col("_n") / LEAF))
    group = ["dim", "cell", "piece"]
    dealt = with_group(celled, pieces, ["dim", "cell"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("_pieces"))).drop("_n", "_pieces")

    def leaves(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        out = []
        dim, cell, piece = (table.column(c).to_numpy() for c in group)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = table.slice(a, b - a)
            ids, labels, row = (own.column(c).to_numpy() for c in ("id", "label", "row"))
            by = np.lexsort((row, ids))  # of one outcome, whatever the order of arrival
            tree = Tree(_matrix(own.column("vector"))[by], labels[by])
            order = by[tree.order]
            out.append({"dim": int(dim[a]), "cell": int(cell[a]), "piece": int(piece[a]), "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "row": row[order].tobytes(), "vectors": tree.x.astype("<i4").tobytes()})
        return pa.RecordBatch.from_pylist(out, pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("piece", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "row", "vectors"))]))

    return scratch.save(over_groups(dealt, group, leaves, "dim int, cell long, piece long, ids binary, labels binary, row binary, vectors binary"), "leaves")


def _leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Tree]]:
    for batch in batches:
        for leaf in batch.to_pylist():
            ids, labels, row = (np.frombuffer(leaf[c], np.int64) for c in ("ids", "labels", "row"))
            if len(ids):
                tree = Tree(np.frombuffer(leaf["vectors"], "<i4").reshape(len(ids), -1).astype(np.int64), labels)
                yield leaf["dim"], ids[tree.order], tree.labels, row[tree.order], tree


class Block:
    """Anchors of one dimension, with their tree."""

    def __init__(self, row: np.ndarray, x: np.ndarray, labels: np.ndarray):
        self.row, self.x, self.labels, self.tree = row, x, labels, Tree(x, labels)

    def scored(self, rows: Tree, low: np.ndarray, high: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Anchor numbers, places of rows, and their scores, of all node pairs that survive."""
        i, j = surviving(self.tree, rows, low, high, same)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        a, b = self.tree.cuts[-1], rows.cuts[-1]
        for k in np.unique(i).tolist():
            mine = self.tree.order[a[k] : a[k + 1]]
            places = np.concatenate([np.arange(b[m], b[m + 1]) for m in j[i == k].tolist()])
            yield mine, places, dots(self.x[mine], rows.x[places])


def _positives(leaves: DataFrame, blocks: dict[int, Block], least: dict[int, np.ndarray], k: int) -> DataFrame:
    """The best rows of each anchor's label, found task by task: ``(anchor, score, id, row)``."""
    shared = leaves.sparkSession.sparkContext.broadcast((blocks, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, least = shared.value
        best = {d: Best(len(b.row), k, least[d]) for d, b in blocks.items()}
        for dim, ids, labels, row, tree in _leaf_rows(batches):
            if dim not in blocks:
                continue
            block, found, new = blocks[dim], best[dim], []
            for mine, places, score in block.scored(tree, found.least, np.full(len(block.row), np.inf), True):
                a, p = np.nonzero((score >= found.least[mine][:, None]) & (block.labels[mine][:, None] == labels[places]) & (block.row[mine][:, None] != row[places]))
                new.append((mine[a], score[a, p], ids[places[p]], row[places[p]]))
            found.add_all(new)
        for d, found in best.items():
            if len(found.slot):
                yield pa.RecordBatch.from_pydict({"anchor": blocks[d].row[found.slot], "score": found.score, "id": found.id, "row": found.row})

    return leaves.mapInArrow(run, "anchor long, score long, id long, row long")


def _negatives(leaves: DataFrame, blocks: dict[int, Block], wanted: dict[int, np.ndarray], k: int, percent: int) -> DataFrame:
    """The best rows of other labels below each positive score, task by task: ``(anchor, positive_score, score, id, row)``.

    ``wanted`` has a row of positive scores for each anchor; the least long fills it up and asks for nothing.
    """
    shared = leaves.sparkSession.sparkContext.broadcast((blocks, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, wanted = shared.value
        best, top = {}, {}
        for d, w in wanted.items():
            asks = w >= 0  # of a negative score, percent of it lies above it
            floor = np.where(asks, -(-percent * w.astype(object) // 100), np.inf).astype(np.float64)
            best[d] = Best(w.size, k, floor.ravel())
            top[d] = np.where(asks, w, -np.inf).max(axis=1, initial=-np.inf)
        for dim, ids, labels, row, tree in _leaf_rows(batches):
            if dim not in blocks:
                continue
            block, found, w, new = blocks[dim], best[dim], wanted[dim], []
            low = found.least.reshape(w.shape).min(axis=1, initial=np.inf)
            for mine, places, score in block.scored(tree, low, top[dim], False):
                other = block.labels[mine][:, None] != labels[places]
                for s in range(w.shape[1]):
                    slot = mine * w.shape[1] + s
                    a, p = np.nonzero(other & (score <= w[mine, s][:, None]) & (score >= found.least[slot][:, None]))
                    new.append((slot[a], score[a, p], ids[places[p]], row[places[p]]))
            found.add_all(new)
        for d, found in best.items():
            if len(found.slot):
                width = wanted[d].shape[1]
                yield pa.RecordBatch.from_pydict({"anchor": blocks[d].row[found.slot // width], "positive_score": wanted[d].ravel()[found.slot], "score": found.score, "id": found.id, "row": found.row})

    return leaves.mapInArrow(run, "anchor long, positive_score long, score long, id long, row long")


def _ranked(found: DataFrame, keys: list[str], k: int, name: str = "rank") -> DataFrame:
    return found.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row"))).where(F.col(name) <= k)


def hard_negatives(rows: DataFrame, is_anchor: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components x of vectors become floor(256 * x); a score is the whole inner product with the anchor. Anchors are the rows where
    the SQL condition ``is_anchor`` holds over ``id`` and ``label``. An anchor's positives are its first
    ``positives`` other rows of the same label; for each, the first ``negatives`` rows of other labels whose score lies
    between ``percent`` hundredths of the positive's and the positive's own are returned. Higher scores come
    first, ties go to the smaller id, then to one of the rows that repeat it.

    Rows with a null id, label or vector, a null or non-finite component, or components so large that scores leave a
    long (2^31 and more, or a squared norm of 2^62 and more) take no part, nor do empty vectors. Vectors meet those of their own dimension.
    Rows that repeat an id are rows of their own, as anchors too. Other columns are ignored; an empty
    table, or one without anchors, gives an empty result.

    Anchors run in blocks of ``block``, each broadcast (at most ``block`` vectors and 32 MB) and held against all leaves;
    leaves stay where they lie, and tasks return at most ``positives`` and ``positives * negatives`` rows for an anchor. The
    search is exact; a first pass over one leaf of each anchor's own cell gives bounds that prune the others.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "negatives")
    whole = scratch.save(_whole(rows, id_col, vector_col, label_col), "whole")
    numbered = whole.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "label", "dim", "vector")
    celled = celled_rows(numbered, scratch)
    leaves = packed_leaves(celled, max(positives, negatives) + 1, scratch)
    anchors = scratch.save(celled.where(is_anchor), "anchors")
    n_anchors, widest = anchors.agg(F.count(F.lit(1)), F.max("dim")).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * (widest or 1))))
    blocks_of = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n_anchors // max(1, block * 3 // 4)))))
    parts = anchors.withColumn("block", blocks_of)
    out = None
    for number, n in sorted(map(tuple, parts.groupBy("block").count().collect())):
        for at in range(0, n, block):  # a block of more rows than bound runs in turns
            part = _ranked_slice(parts.where(F.col("block") == number), at, block) if n > block else parts.where(F.col("block") == number)
            found = _one_block(part, leaves, positives, negatives, percent, scratch)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _ranked_slice(part: DataFrame, at: int, block: int) -> DataFrame:
    return part.orderBy("row").offset(at).limit(block)


def _one_block(part: DataFrame, leaves: DataFrame, positives: int, negatives: int, percent: int, scratch: Scratch) -> DataFrame:
    held = part.select("row", "label", "dim", "cell", "vector").toPandas().sort_values("row")  # at most a block
    blocks, names = {}, {}
    for dim, own in held.groupby("dim"):
        blocks[int(dim)] = Block(own.row.to_numpy(), _matrix(pa.array(own.vector)), own.label.to_numpy())
        names |= {r: (int(dim), i) for i, r in enumerate(own.row.tolist())}
    none = {d: np.full(len(b.row), -np.inf) for d, b in blocks.items()}
    home = leaves.where("piece = 0").where(F.col("cell").isin([int(c) for c in held.cell.unique()]))
    seeds = _ranked(_positives(home, blocks, none, positives), ["anchor"], positives).where(F.col("rank") == positives)
    for anchor, score in seeds.select("anchor", "score").collect():
        d, i = names[anchor]
        none[d][i] = score
    pairs = scratch.save(_ranked(_positives(leaves, blocks, none, positives), ["anchor"], positives), "positives")
    wanted = {d: np.full((len(b.row), positives), -1, np.int64) for d, b in blocks.items()}
    for anchor, rank, score in pairs.select("anchor", "rank", "score").collect():  # at most positives rows an anchor
        d, i = names[anchor]
        wanted[d][i, rank - 1] = score
    # equal scores ask for the same rows: once is enough
    for w in wanted.values():
        w[:, 1:][w[:, 1:] == w[:, :-1]] = -1
    exact = F.col("score").cast("decimal(20,0)") * 100 >= F.col("positive_score").cast("decimal(20,0)") * percent  # doubles bound it but for rounding
    found = scratch.save(_ranked(_negatives(leaves, blocks, wanted, negatives, percent).where(exact), ["anchor", "positive_score"], negatives), "negatives")
    named = pairs.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = part.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    both = named.join(found.select("anchor", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"])
    return both.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

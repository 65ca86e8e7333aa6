"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent a and normalised: w_s = p_s^a / sum(p^a). From 0 to 1,
the entropy of w falls from that of even weights to that of the shares, and so does the largest
repetition of a source. The exponent is the least one, found by bisection in [0, 1], at which the
entropy is at most its target and no source exceeds the repetition limit.

A source of quota q tokens and t tokens at hand is read in floor(q / t) whole epochs and one part epoch. Every
epoch is a block permutation of its own: rows are dealt by hash into about sqrt(n) blocks, blocks are
read in the order of their hashes, rows of a block in the order of theirs; the part epoch ends where
the quota is met. So what is left to decide for a row is a comparison with three numbers of its source, and
its position is the number of rows in earlier blocks and its place in its own: no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.scratch import Scratch

GRID, PASSES = 32, 8
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def hashed(*parts: Column) -> Column:
    """A 60-bit number from the MD5 of parts joined by '|', the same in any engine; null parts are empty."""
    text = F.concat_ws("|", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, entropy_share: float, repetition: float, budget_ratio: float = 1.0) -> float:
    """The exponent for a table of source token counts ``t``.

    Target entropy: ``entropy_share`` of the way from the shares' entropy to that of even weights.
    ``budget_ratio`` is the budget over all tokens. Each pass evaluates a grid of exponents in one
    aggregation and keeps the cell in which the condition begins to hold.
    """
    total, n = sources.agg(F.sum("t"), F.count("*")).first()
    if not total:
        return 1.0
    rows = sources.where("t > 0").select((F.col("t") / F.lit(float(total))).alias("p"))

    def curve(grid: list[float]) -> list[tuple[float, float]]:
        one = rows.select("p", F.explode(F.array(*map(F.lit, grid))).alias("a"))
        pa = F.pow("p", F.col("a"))
        got = one.groupBy("a").agg(F.sum(pa).alias("z"), F.sum(pa * F.col("a") * F.log("p")).alias("u"), F.max(pa / F.col("p")).alias("m")).collect()  # one row for each of the grid
        from math import log

        by = {r.a: (log(r.z) - r.u / r.z, r.m / r.z * budget_ratio) for r in got}
        return [by[a] for a in grid]

    (flat, _), (sharp, _) = curve([0.0, 1.0])
    target = sharp + entropy_share * (flat - sharp)
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        ok = [h <= target + 1e-12 and r <= repetition for h, r in curve(grid)]
        first = next((i for i, good in enumerate(ok) if good), GRID)
        if first == 0:
            return grid[0]
        lo, hi = grid[first - 1], grid[first]
    return hi


def plan(rows: DataFrame, entropy_share: float, repetition: float, budget_tokens: int | None, scratch: Scratch) -> DataFrame:
    """One row per source of ``_source, _row, _tokens`` rows: weight, whole epochs, and where the part epoch ends."""
    sources = scratch.save(rows.groupBy("_source").agg(F.sum("_tokens").alias("t"), F.count("*").alias("n")), "sources")
    total = sources.agg(F.sum("t")).first()[0] or 0
    budget = total if budget_tokens is None else budget_tokens
    if total and budget > repetition * total:
        raise ValueError(f"a budget of {budget} tokens reads some source more than {repetition} times, whatever the weights: all sources have {total}")
    a = exponent(sources, entropy_share, repetition, budget / total if total else 1.0)
    power = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(total or 1)), F.lit(a))).otherwise(0.0)
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    quota = sources.select("_source", "t", F.ceil(F.sqrt("n")).cast("long").alias("blocks"), (power / F.lit(norm)).alias("weight"))
    quota = quota.withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-6)).cast("long"))
    quota = quota.withColumn("epochs", F.when(F.col("t") > 0, F.floor(F.col("quota") / F.col("t"))).otherwise(1).cast("long"))
    quota = scratch.save(quota.withColumn("rest", F.when(F.col("t") > 0, F.col("quota") - F.col("epochs") * F.col("t")).otherwise(0)), "quota")

    dealt = _dealt(_with_sources(rows, quota.select("_source", "epochs", "blocks", "rest").where("rest > 0")), "epochs")
    block = scratch.save(dealt.groupBy("_source", "_block").agg(F.sum("_tokens").alias("size"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest")), "blocks")
    turn = hashed(F.col("_source"), F.col("epochs"), F.col("_block"))
    read = block.withColumn("turn", turn).withColumn("upto", F.sum("size").over(Window.partitionBy("_source").orderBy("turn", "_block").rowsBetween(Window.unboundedPreceding, 0)))
    # of each source, the first block that the quota doesn't cover whole
    edge = read.where(F.col("upto") > F.col("rest")).groupBy("_source").agg(F.min(F.struct("turn", "_block", (F.col("rest") - F.col("upto") + F.col("size")).alias("left"))).alias("e")).select("_source", "e.turn", F.col("e._block").alias("edge"), "e.left")
    edge = scratch.save(edge, "edges")
    inner = _with_sources(dealt, edge).where(F.col("_block") == F.col("edge"))
    inner = inner.withColumn("upto", F.sum("_tokens").over(Window.partitionBy("_source").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)))
    last = inner.where(F.col("upto") <= F.col("left")).groupBy("_source").agg(F.max("_key").alias("last_key"))
    return scratch.save(quota.join(edge, "_source", "left").join(last, "_source", "left"), "plan")


def _dealt(rows: DataFrame, epoch: str) -> DataFrame:
    """Adds ``_block`` and ``_key`` for the epoch of that column; the part epoch's number is ``epochs``."""
    rows = rows.withColumn("_key", hashed(F.col("_source"), F.col(epoch), F.lit("row"), F.col("_row")))
    return rows.withColumn("_block", F.pmod("_key", F.greatest("blocks", F.lit(1))))


def _with_sources(rows: DataFrame, table: DataFrame) -> DataFrame:
    """A join on the source with a table of one row per source, broadcast only if counted to be small."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table, "_source")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy_share: float = 0.5, repetition: float = 4.0, budget_tokens: int | None = None, keep: list[str] | None = None, report: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """The mixed rows: columns ``keep`` (default id and source) and, with ``report``, ``n_tokens``, ``weight``, ``epoch``, ``block``, ``position``.

    A row comes once for each epoch that reads it. The budget is by default the tokens at hand, counted
    over whole texts of any length. ``block`` is the row's block in the epoch, ``position`` its place, from 1, in the
    source's permutation for the epoch. A budget that no weights can realise within ``repetition`` is a ValueError.

    Null sources are one source of the empty name. Rows without tokens are never short of budget: in a
    source that has tokens they come with each epoch that reaches them, in one that has none once.
    Repeated rows have one key, so a part epoch takes all or none of them, at neighbouring positions. Columns of the
    docs whose names clash are kept as they are, since internal names begin with an underscore; an empty table
    gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    keep = [id_col, source_col] if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("_kept"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"), F.col(id_col).cast("string").alias("_row"), token_count(F.col(text_col).cast("string")).alias("_tokens"))
    sized = scratch.save(rows.select("_source", "_row", "_tokens"), "sizes")
    chosen = plan(sized, entropy_share, repetition, budget_tokens, scratch)
    rows = _dealt(_with_sources(rows, chosen), "epochs")
    turn = hashed(F.col("_source"), F.col("epochs"), F.col("_block"))
    whole = F.col("turn").isNull() & (F.col("rest") > 0)  # the quota covers every block
    before = (turn < F.col("turn")) | ((turn == F.col("turn")) & (F.col("_block") < F.col("edge")))
    part = (F.col("rest") > 0) & F.coalesce(whole | before | ((F.col("_block") == F.col("edge")) & (F.col("_key") <= F.col("last_key"))), F.lit(False))
    times = F.col("epochs") + F.when(part, 1).otherwise(0)
    rows = rows.where(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    if not report:
        return rows.select("_kept.*")
    rows = scratch.save(_dealt(rows.select("_kept", "_source", "_row", "_tokens", "_epoch", "blocks", "weight"), "_epoch").drop("blocks"), "rows")
    block = ["_source", "_epoch", "_block"]
    sizes = rows.groupBy(*block).agg(F.count("*").alias("_n")).withColumn("_turn", hashed(*map(F.col, block)))
    ahead = F.sum("_n").over(Window.partitionBy("_source", "_epoch").orderBy("_turn", "_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    sizes = sizes.withColumn("_ahead", ahead).drop("_n", "_turn")
    place = F.row_number().over(Window.partitionBy(*block).orderBy("_key", "_row"))
    rows = rows.withColumn("_place", place).join(sizes, block)
    return rows.select("_kept.*", F.col("_tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), F.col("_epoch").alias("epoch"), F.col("_block").cast("long").alias("block"), (F.col("_ahead") + F.col("_place")).cast("long").alias("position"))

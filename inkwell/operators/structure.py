"""Sections, abstracts, terms and acronyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import lexicons as L
from inkwell.functions import text as T


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.templates(), "paper_type string, ord int, section string, lo int, hi int")


def structure_check(docs: DataFrame, paper_type: str = "empirical", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Expected sections of a type, whether present, their words against the budget; and the document's totals.

    Title isn't looked for; Methods stands for Methodology.
    """
    spark = docs.sparkSession
    alias = lambda c: F.when(c == "Methods", "Methodology").otherwise(c)
    expected = template_table(spark).where((F.col("paper_type") == paper_type) & (F.col("section") != "Title")).select("ord", "section", "lo", "hi", alias(F.col("section")).alias("canon"))
    found = T.sections(docs, id_col, text_col).withColumn("canon", alias(F.col("name")))
    found = found.groupBy(id_col, "canon").agg(F.min("ord").alias("found_at"), F.sum(T.words(F.col("body"))).alias("n"))
    slots = docs.select(id_col, F.explode(F.array(*[F.struct(F.lit(r.ord).alias("ord"), F.lit(r.section).alias("section"), F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi"), F.lit(r.canon).alias("canon")) for r in expected.orderBy("ord").collect()])).alias("e")).select(id_col, "e.*")
    rows = slots.join(found, [id_col, "canon"], "left")
    status = F.when(F.col("found_at").isNull(), "missing").when(F.col("lo").isNull(), "present").when(F.col("n") < F.col("lo"), "under").when(F.col("n") > F.col("hi"), "over").otherwise("ok")
    return rows.select(id_col, F.col("ord").cast("long").alias("ord"), "section", F.col("n").cast("long").alias("n_words"), status.alias("status"), F.col("found_at").cast("long").alias("found_at"))


def extra_sections(docs: DataFrame, paper_type: str = "empirical", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, section, found_at)``: recognised sections that the type doesn't expect, by name or alias."""
    alias = lambda name: "Methodology" if name == "Methods" else name
    expected = {x for kind, _, section, _, _ in L.templates() if kind == paper_type for x in (section, alias(section))}
    return T.sections(docs, id_col, text_col).where(~F.col("name").isin(sorted(expected))).select(id_col, F.col("name").alias("section"), F.col("ord").cast("long").alias("found_at"))


def structure_totals(check: DataFrame, id_col: str = "doc_id") -> DataFrame:
    present = F.col("found_at").isNotNull()
    order = F.sort_array(F.collect_list(F.when(present, F.struct("ord", "found_at"))))["found_at"]
    rows = check.groupBy(id_col).agg(F.count_if(present).alias("present"), F.count_if(~present).alias("missing"), order.alias("found_at"))
    return rows.select(id_col, "present", "missing", F.round(100.0 * F.col("present") / F.greatest(F.col("present") + F.col("missing"), F.lit(1)), 6).alias("completeness"), (F.col("found_at") == F.array_sort("found_at")).alias("order_ok"))


def abstract_scorecard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Moves found in the abstract (its section, else the whole text), its length and score."""
    part = T.sections(docs, id_col, text_col).where("name = 'Abstract'").select(id_col, "body")
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(part, id_col, "left").withColumn("abstract", F.coalesce("body", F.trim("text")))
    rows = rows.where("abstract <> ''").withColumns({k: F.col("abstract").rlike(f"(?i){p}") for k, p in L.MOVES.items()})
    n = F.size(F.filter(T.tokens(F.col("abstract")), lambda w: w.rlike("[A-Za-z0-9]"))).cast("long")
    rows = rows.withColumns({"n_words": n, "moves": sum((F.col(k).cast("long") for k in L.MOVES), F.lit(0)).cast("long")})
    status = F.when(F.col("n_words") < 150, "under").when(F.col("n_words") > 250, "over").otherwise("ok")
    score = F.floor(F.col("moves") * 14 + F.when(status == "ok", 30).otherwise(15) + 0.5).cast("long")
    return rows.select(id_col, F.col("body").isNotNull().alias("had_heading"), *L.MOVES, "n_words", "moves", status.alias("status"), score.alias("score"))


def acronyms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, acronym, uses, expansions, issue)`` of every acronym; issue is null if there is none.

    Places come from splitting the text at the acronym, so they agree with a scan from the left.
    """
    text = F.col(text_col)
    uses = docs.select(id_col, text.alias("text"), F.explode(F.regexp_extract_all(text, F.lit(L.ACRONYM), F.lit(1))).alias("acronym")).where(~F.col("acronym").isin(L.IGNORED_ACRONYMS))
    uses = uses.groupBy(id_col, "acronym").agg(F.count("*").alias("uses"))
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(L.DEFINITION), F.lit(1)).alias("long"), F.regexp_extract_all(text, F.lit(L.DEFINITION), F.lit(2)).alias("acronym"))
    defs = docs.select(id_col, F.explode(both).alias("d")).select(id_col, "d.acronym", F.lower(F.trim(F.regexp_replace("d.long", r"\s+", " "))).alias("long"))
    defs = defs.groupBy(id_col, "acronym").agg(F.countDistinct("long").alias("expansions"))
    # used before defined: some use stands before the first "(ACRONYM"
    rows = uses.join(defs, [id_col, "acronym"], "left").join(docs.select(id_col, text.alias("text")), id_col)
    before = F.expr("substring_index(text, concat('(', acronym), 1)")
    early = F.exists(F.regexp_extract_all(before, F.lit(L.ACRONYM), F.lit(1)), lambda a: a == F.col("acronym"))
    issue = F.when(F.col("expansions").isNull() & ~F.col("acronym").isin(L.COMMON_CAPITALS), "undefined").when(F.col("expansions") > 1, "differing").when(F.col("expansions").isNotNull() & early, "used before defined")
    return rows.select(id_col, "acronym", "uses", F.coalesce("expansions", F.lit(0)).alias("expansions"), issue.alias("issue"))


def term_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 20) -> DataFrame:
    """Spellings with and without hyphens of one term: ``(id, term, variants, total, rank)``."""
    spelt = F.regexp_extract_all(F.col(text_col), F.lit(r"[A-Za-z][A-Za-z\-]+[A-Za-z]"), F.lit(0))
    bare = lambda w: F.replace(F.lower(w), F.lit("-"), F.lit(""))
    # of two spellings of a term one has a hyphen; only terms so written anywhere in a document are counted in its texts
    hyphened = docs.where(F.col(text_col).contains("-")).select(id_col, F.explode(spelt).alias("s")).where(F.col("s").contains("-"))
    wanted = hyphened.select(id_col, bare(F.col("s")).alias("term")).where(F.length("term") >= 4).groupBy(id_col).agg(F.collect_set("term").alias("_terms"))
    own = docs.join(wanted.withColumnRenamed(id_col, "_id"), F.col(id_col).eqNullSafe(F.col("_id")))
    rows = own.select(id_col, "_terms", F.explode(spelt).alias("s")).withColumn("term", bare(F.col("s"))).where(F.array_contains("_terms", F.col("term"))).select(id_col, "term", F.lower("s").alias("s"))
    rows = rows.groupBy(id_col, "term", "s").agg(F.count("*").alias("n")).groupBy(id_col, "term").agg(F.count("*").alias("variants"), F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("total"), "term"))
    return rows.where("variants > 1 and total >= 3").withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def chunk_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The section whose words each chunk shares most, the first on a tie; null if none is shared."""
    toks = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    c = T.chunks(docs, id_col, text_col)
    a = c.select(id_col, "chunk_id", F.explode(toks(F.col("chunk"))).alias("t"))
    b = T.sections(docs, id_col, text_col).select(id_col, "name", "ord", F.explode(toks(F.col("body"))).alias("t"))
    shared = a.join(b, [id_col, "t"]).groupBy(id_col, "chunk_id", "name", "ord").agg(F.count("*").alias("shared"))
    best = shared.groupBy(id_col, "chunk_id").agg(F.max(F.struct("shared", (-F.col("ord")).alias("o"), "name")).alias("b"))
    rows = c.join(best, [id_col, "chunk_id"], "left")
    return rows.select(id_col, F.col("chunk_id").cast("long").alias("chunk_id"), T.words(F.col("chunk")).cast("long").alias("n_words"), F.col("b.name").alias("section"))


def paper_types(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keywords: dict[str, list[str]] = L.TYPE_KEYWORDS, top: int = 3) -> DataFrame:
    """Types by the number of their keywords in the text, ties in the listed order: the first ``top``."""
    low = F.lower(text_col)
    scores = [F.struct(F.lit(i).alias("ord"), F.lit(k).alias("paper_type"), sum((low.contains(w).cast("int") for w in ws), F.lit(0)).cast("long").alias("score")) for i, (k, ws) in enumerate(keywords.items())]
    rows = docs.select(id_col, F.explode(F.slice(F.array_sort(F.array(*scores), lambda a, b: F.when(a.score != b.score, b.score - a.score).otherwise(a.ord - b.ord).cast("int")), 1, top)).alias("s"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("s.score"), "s.ord"))
    return rows.select(id_col, rank.cast("long").alias("rank"), "s.paper_type", "s.score", F.round(F.least(F.col("s.score") / 5, F.lit(0.95)), 6).alias("confidence"))


def of_type(docs: DataFrame, per_type: list[tuple], columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a small table by type (its first column ``paper_type``) for each text's likeliest type; a null text counts as empty."""
    kinds = paper_types(docs.withColumn(text_col, F.coalesce(text_col, F.lit(""))), id_col, text_col, top=1).select(id_col, "paper_type")
    return kinds.join(F.broadcast(docs.sparkSession.createDataFrame(per_type, f"paper_type string, {columns}")), "paper_type").select(id_col, "paper_type", *[c.split()[0] for c in columns.split(", ")])


def first_match(text: Column, chain: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first label of a chain of which a keyword stands in the text."""
    out = None
    for label, words in chain:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)

"""Corpus statistics, unions and synthetic cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T


def dataset_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and mean length by language, by source and over all, in one pass."""
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


def reference_corpus(user: DataFrame, bundled: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """User references alone or with the bundled ones; ``distinct`` drops repeats."""
    out = user if bundled is None else bundled.unionByName(user)
    return out.distinct() if distinct else out


def plagiarism_cases(docs: DataFrame, pairs: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """Four graded variations of each text of at least ``least`` characters."""
    head = F.substring(text_col, 1, 500)
    case = lambda name, expected, text: F.struct(F.lit(name).alias("variation"), F.lit(expected).alias("expected"), text.alias("case"))
    cases = F.array(case("exact_copy", 1.0, head), case("paraphrased", 0.7, T.paraphrase(head, pairs)), case("similar_topic", 0.4, F.concat(F.lit("A related text about: "), F.substring(text_col, 1, 80))), case("different_topic", 0.1, F.lit("An unrelated text about gardening and weather.")))
    return docs.where(F.length(text_col) >= least).select(id_col, F.explode(cases).alias("c")).select(id_col, "c.*")


def paper_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Title, abstract, keywords, year, DOI, cleaned content and word count of each paper.

    Abstract and keywords run lazily up to the next blank line, heading or end.
    """
    c = F.col(text_col)
    block = lambda name: F.trim(F.regexp_extract(c, rf"(?is)\b{name}\s*:\s*(.*?)(?=\n\s*\n|\n[A-Z][A-Za-z ]+:|$)", 1))
    title = F.trim(F.regexp_extract(c, r"(?im)^\s*(?:title\s*:\s*)?(\S.*)$", 1))
    keys = F.filter(F.transform(F.split(block("keywords"), r"[,;]"), lambda k: F.trim(k)), lambda k: k != "")
    return docs.select(id_col, title.alias("title"), block("abstract").alias("abstract"), keys.alias("keywords"), F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1).alias("year"), F.regexp_extract(c, r"(?i)10\.\d{4,9}/[^\s,;\])]+", 0).alias("doi"), T.clean_paper(c).alias("content"), T.words(c).cast("long").alias("word_count"))

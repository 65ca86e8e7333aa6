"""Text columns and table-generating text operators, all inside Catalyst.

Word characters are letters, numbers and underscore of any script, written out as a class, so that
every engine agrees on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.lexicons import LOOSE_HEADERS, SECTIONS, STOP_WORDS

WORD = r"[\p{L}\p{N}_]"
#: Written out, since Java looks such classes up in a table; ranges are tested one after the other, which takes six times as long.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def either(words: list[str]) -> str:
    """A regex alternation of literal phrases."""
    import re

    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def normalise(c: Column) -> Column:
    """Lower case without punctuation, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def clean_paper(c: Column) -> Column:
    """White space collapsed, unusual punctuation, page marks and a leading number dropped."""
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\s.,;:!?\-()\[\]]", "")
    c = F.regexp_replace(c, r"Page \d+", "")
    return F.trim(F.regexp_replace(c, r"^\d+\s*", ""))


def heading(c: Column) -> Column:
    """A heading line without numbering, bullets and markdown, lower case."""
    c = F.regexp_replace(F.trim(c), r"^[#>*\-•\d.)(\s:]+", "")
    return F.lower(F.trim(F.regexp_replace(c, r"[*_#:.\s]+$", "")))


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def preview(c: Column, n: int = 90) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def context(text: Column, start: Column, length: Column, around: int = 50) -> Column:
    """Text around a match (0-based start), with dots where it was cut."""
    lo = F.greatest(start - around, F.lit(0))
    hi = F.least(start + length + around, F.length(text))
    return F.concat(F.when(lo > 0, "...").otherwise(""), text.substr(lo + 1, hi - lo), F.when(hi < F.length(text), "...").otherwise(""))


def strip_fence(c: Column) -> Column:
    """The inside of a text that is one code fence."""
    inner = F.regexp_extract(F.trim(c), r"(?s)^```[A-Za-z0-9_-]*\s*\n(.*?)\n?```$", 1)
    return F.when(F.trim(c).rlike(r"(?s)^```[A-Za-z0-9_-]*\s*\n.*```$"), inner).otherwise(F.trim(c))


def drop_echoed_heading(c: Column, name: Column) -> Column:
    """The text without a first line that repeats its section's name."""
    first = F.substring_index(F.ltrim(c), "\n", 1)
    return F.when(heading(first) == F.lower(name), F.trim(F.ltrim(c).substr(F.length(first) + 2, F.length(c)))).otherwise(c)


def typographic(c: Column) -> Column:
    """Typographic characters of prose as plain ones; code spans are left alone.

    Prose and code alternate when the text is split at backquotes; every other part is code.
    """
    parts = F.split(c, "`")

    def plain(x: Column) -> Column:
        for a, b in ((" ", " "), ("[‘’]", "'"), ("[“”]", '"'), ("…", "..."), (r"(\d)\s*–\s*(\d)", "$1-$2"), (r"\s*—\s*", ", "), (r"\s+–\s+", ", "), (r"[ \t]+(?=\n)", "")):
            x = F.regexp_replace(x, a, b)
        return x

    return F.regexp_replace(F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, plain(x)).otherwise(x)), "`"), r"[ \t]+$", "")


def neutralise(c: Column) -> Column:
    """Triple quotes disarmed and control characters dropped."""
    return F.regexp_replace(F.replace(c, F.lit('"""'), F.lit("'''")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def paraphrase(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Raw substring replacements, one after the other."""
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def words(c: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.regexp_count(c, F.lit(r"\S+"))


def sentence_array(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def sentence_count(c: Column) -> Column:
    """Number of parts of ``sentence_array`` that aren't blank, counted by their ends."""
    ends = F.length(c) - F.length(F.regexp_replace(c, r"[.!?](?=\s)", ""))
    blank = F.substring(c, -1, 1).isin(*" \t\n\x0b\f\r")
    closed = F.when(blank, F.substring(F.rtrim(c, F.lit(" \t\n\x0b\f\r")), -1, 1).isin(".", "!", "?")).otherwise(False)
    return ends + F.when(closed | (F.trim(c) == ""), 0).otherwise(1)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, sent)``: non-empty sentences and their place in the text."""
    return docs.select(id_col, F.posexplode(sentence_array(F.col(text_col))).alias("pos", "sent")).withColumn("sent", F.trim("sent")).where("sent <> ''")


def tokens(c: Column) -> Column:
    """Words with inner hyphens, apostrophes and dots."""
    return F.regexp_extract_all(c, F.lit(rf"{WORD}+(?:[-'’.]{WORD}+)*"), F.lit(0))


def analysed(c: Column, stop: bool = True) -> Column:
    """Lower-case words of two or more characters, stop words gone."""
    got = F.regexp_extract_all(F.lower(c), F.lit(rf"{WORD}{{2,}}"), F.lit(0))
    return F.filter(got, lambda w: ~w.isin(STOP_WORDS)) if stop else got


def grams(c: Column, n_max: int) -> Column:
    """All 1- to n-grams of an array of words."""
    if n_max == 1:
        return c

    def all_of(ws: Column) -> Column:
        runs = lambda n: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (n - 1), F.lit(0))), lambda w, i: F.concat_ws(" ", w, *[F.get(ws, i + k) for k in range(1, n)]))
        return F.concat(ws, *[runs(n) for n in range(2, n_max + 1)])

    # bound to a variable, so that the words are cut once and not for each use
    return F.get(F.transform(F.array(c), all_of), 0)


def syllables(w: Column) -> Column:
    """Vowel groups of a word's letters, less a silent e, at least one."""
    x = F.regexp_replace(F.lower(w), "[^a-z]", "")
    n = F.regexp_count(x, F.lit("[aeiouy]+")) - F.when(x.endswith("e") & ~x.endswith("le"), 1).otherwise(0)
    return F.when(F.length(x) == 0, 0).when(F.length(x) <= 3, 1).otherwise(F.greatest(n, F.lit(1)))


def ascii_words(c: Column) -> Column:
    """The text's tokens as runs of ASCII letters and digits with a space after each; tokens without any go.

    The same words as ``tokens`` cuts, by passes over the whole text and without an array of them.
    """
    # a letter or digit is not dropped here if it is an ASCII one or one of the two whose lower case holds one; a word character outside
    # the basic plane has two places to look back at
    bare = F.regexp_replace(c, rf"_|[[^\x00-\x7F]&&[\p{{L}}\p{{N}}]&&[^\u0130\u212A]]|[-'’.](?<={WORD}{{1,2}}.)(?={WORD})", "")
    runs = F.regexp_replace(F.concat(bare, F.lit(" ")), f"[^{LETTERS}{LETTERS.upper()}0123456789\u0130\u212A]+", " ")

    def rare(t: Column) -> Column:
        kept = F.translate(F.regexp_replace(t, "(?<![^ ])[\u0130\u212A]+ ", ""), "\u0130\u212A", "ik")
        return F.ltrim(F.when(t.contains("\u0130") | t.contains("\u212A"), kept).otherwise(t))

    # bound to a variable, so that the runs are made once
    return F.get(F.transform(F.array(runs), rare), 0)


def syllable_marks(letters: Column) -> Column:
    """Words of lower-case ASCII letters with an ``a`` for each syllable that ``syllables`` counts, spaces kept."""
    a, v, c = f"[{LETTERS}]", "[aeiouy]", "[bcdfghjklmnpqrstvwxz]"
    # short words; a syllable and a silent e after it; any other syllable; a word without vowels
    return F.regexp_replace(letters, rf"(?<!{a}){a}{{1,3}}(?!{a})|{c}*+{v}++{c}++(?:(?<!l)e|{v}+e)(?!{a})|{c}*+{v}++{c}*+|{c}++", "a")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, para)``: blocks between blank lines of at least 5 words; if fewer than two, lines instead."""
    return docs.select(id_col, F.posexplode(paragraph_array(F.col(text_col))).alias("pos", "para"))


def paragraph_array(c: Column) -> Column:
    """The paragraphs of a text, see ``paragraphs``."""
    long = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: words(p) >= 5)
    either_of = lambda x: F.when(F.size(x["a"]) < 2, x["b"]).otherwise(x["a"])
    # bound to a variable, so that each is cut once
    return F.get(F.transform(F.array(F.struct(long(F.split(F.trim(c), r"\n\s*\n")).alias("a"), long(F.split(F.trim(c), "\n")).alias("b"))), either_of), 0)


def section_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, line, canon)``: canon is the canonical section name of a heading line, else null."""
    table = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    rows = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return rows.withColumn("canon", F.when(words(F.col("line")) <= 8, F.try_element_at(table, heading(F.col("line")))))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ord, name, body)``: bodies of equal names joined in order; text before the first heading goes."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = section_lines(docs, id_col, text_col).withColumn("name", F.last("canon", ignorenulls=True).over(w)).where("name is not null")
    lines = F.sort_array(F.collect_list(F.when(F.col("canon").isNull(), F.struct("pos", "line"))))
    return rows.groupBy(id_col, "name").agg(F.min("pos").alias("ord"), F.trim(F.array_join(lines["line"], "\n")).alias("body"))


def loose_sections(docs: DataFrame, headers: list[str] = LOOSE_HEADERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, name, body)``: any line under 100 characters that contains a header word opens a section of its name.

    Lines before the first belong to ``content``; a section without lines goes; of equal names the last body stays.
    """
    from pyspark.sql.window import Window

    rows = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line")).withColumn("bare", F.regexp_replace("line", r"^\s+|\s+$", ""))
    rows = rows.withColumn("opens", F.lower("bare").rlike(either(headers)) & (F.length("bare") < 100))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.sum(F.col("opens").cast("int")).over(w))
    part = rows.groupBy(id_col, "part").agg(F.max(F.when(F.col("opens"), F.col("bare"))).alias("name"), F.sort_array(F.collect_list(F.when(~F.col("opens"), F.struct("pos", "line")))).alias("lines"))
    part = part.where(F.size("lines") > 0).select(id_col, "part", F.coalesce("name", F.lit("content")).alias("name"), F.array_join(F.col("lines")["line"], "\n").alias("body"))
    return part.groupBy(id_col, "name").agg(F.max_by("body", "part").alias("body"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_words: int = 130, overlap: int = 1) -> DataFrame:
    """``(id, chunk_id, chunk)``: sentences gathered to ``target_words`` words, the last ``overlap`` carried over; repeats go."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        opened, n = F.array_append(acc.open, s), acc.n + words(s)
        carried = F.slice(opened, -overlap, overlap) if overlap else F.array().cast("array<string>")
        full = F.struct(F.array_append(acc.done, F.array_join(opened, " ")).alias("done"), carried.alias("open"), words(F.array_join(carried, " ")).alias("n"))
        return F.when(n >= target_words, full).otherwise(F.struct(acc.done.alias("done"), opened.alias("open"), n.alias("n")))

    def close(acc: Column) -> Column:
        rest = F.array_join(acc.open, " ")
        left = (F.size(acc.open) > F.when(F.size(acc.done) > 0, overlap).otherwise(0))
        return F.array_distinct(F.when(left, F.array_append(acc.done, rest)).otherwise(acc.done))

    sents = F.filter(F.transform(sentence_array(F.col(text_col)), lambda s: F.trim(s)), lambda s: s != "")
    rows = docs.select(id_col, F.aggregate(sents, empty, add, close).alias("chunks"))
    return rows.select(id_col, F.posexplode("chunks").alias("chunk_id", "chunk"))


def reference_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, entry)``: blocks if there is a blank line, else lines; numbering stripped, at least 4 words."""
    text = F.trim(F.col(text_col))
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda b: F.regexp_replace(F.trim(b), r"\s+", " "))
    parts = F.when(text.rlike(r"\n\s*\n"), blocks).otherwise(F.split(text, "\n"))
    bare = F.transform(parts, lambda e: F.trim(F.regexp_replace(F.trim(e), r"^[\[(]?\s*\d+\s*[\]).:]\s*", "")))
    return docs.select(id_col, F.posexplode(F.filter(bare, lambda e: words(e) >= 4)).alias("pos", "entry"))


def content_tokens(c: Column, stop: list[str]) -> Column:
    """The set of a text's lower-case ASCII words of over two characters, stop words gone."""
    got = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(got, lambda t: (F.length(t) > 2) & ~t.isin(stop)))


def trim_to_words(c: Column, limit: int) -> Column:
    """Whole sentences of at most ``limit`` words; if the first is longer, its first ``limit`` words."""
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def add(acc: Column, s: Column) -> Column:
        over = acc.stop | (acc.n + words(s) > limit)
        return F.struct(F.when(over, acc.kept).otherwise(F.array_append(acc.kept, s)).alias("kept"), F.when(over, acc.n).otherwise(acc.n + words(s)).alias("n"), over.alias("stop"))

    kept = F.aggregate(sentence_array(F.trim(c)), empty, add, lambda a: F.array_join(a.kept, " "))
    cut = F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, limit), " ")
    return F.when(words(c) <= limit, F.trim(c)).when(kept == "", cut).otherwise(kept)

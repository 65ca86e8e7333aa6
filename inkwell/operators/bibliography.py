"""Bibliographic references: formatting, best records, verification against a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as T
from inkwell.functions.lexicons import REFERENCE_STOP_WORDS

REFERENCE = "id long, title string, authors array<struct<given:string,family:string>>, year string, journal string, publisher string, doi string, url string"
#: The ways a page names what it is (fixed values): ``citation_author`` as well as ``author``, and so on.
META = r'(?i)<meta\s+name="(?:citation_)?%s"\s+content="([^"]*)"'
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HOST = r"^[a-z][a-z0-9+.-]*://([^/?#]+)"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
DOI = r"(?i)10\.\d{4,9}/[^\s,;\])]+"


def _join(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")


def initials(given: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(F.replace(F.coalesce(given, F.lit("")), F.lit("."), F.lit(" ")), r"\s+"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " ")


def _listed(names: Column, last: str) -> Column:
    """Up to six names, a longer list closed by et al.; ``last`` joins the final one."""
    n = F.size(names)
    short = F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(last), F.element_at(names, -1)))
    return F.when(n == 0, "").when(n > 6, F.concat(F.array_join(F.slice(names, 1, 6), ", "), F.lit(", et al."))).otherwise(short)


def formatted(style: str) -> Column:
    """A reference row as one line in APA, IEEE or MLA style."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = F.filter("authors", lambda a: F.coalesce(a.family, F.lit("")) != "")
    title, year, doi, url = text("title"), text("year"), text("doi"), text("url")
    source = F.when(text("journal") != "", text("journal")).otherwise(text("publisher"))
    link = F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(url)
    end = lambda c, s: F.when(c != "", F.concat(c, F.lit(s)))
    if style == "IEEE":
        names = _listed(F.transform(named, lambda a: F.trim(F.concat(initials(a.given), F.lit(" "), a.family))), ", ")
        more = (source != "") | (year != "")
        line = _join(end(names, ","), F.concat(F.lit('"'), title, F.when(more, ',"').otherwise('."')), F.when(source != "", F.concat(source, F.when(year != "", ",").otherwise("."))), end(year, "."))
        return F.concat(line, F.when(doi != "", F.concat(F.lit(" doi: "), doi, F.lit("."))).when(url != "", F.concat(F.lit(" [Online]. Available: "), url, F.lit("."))).otherwise(""))
    if style == "MLA":
        first, second = F.get("authors", F.lit(0)), F.get("authors", F.lit(1))
        whole = lambda a: F.regexp_replace(F.trim(F.concat(F.coalesce(a.family, F.lit("")), F.lit(", "), F.coalesce(a.given, F.lit("")))), ",+$", "")
        n = F.size("authors")
        names = F.when(n <= 0, "").when(n == 1, whole(first)).when(n == 2, F.concat(whole(first), F.lit(", and "), _join(second.given, second.family))).otherwise(F.concat(whole(first), F.lit(", et al.")))
        line = _join(end(names, "."), F.concat(F.lit('"'), title, F.lit('."')), end(source, ","), end(year, "."))
        return F.concat(line, F.when(link != "", F.concat(F.lit(" "), link, F.lit("."))).otherwise(""))
    names = _listed(F.transform(named, lambda a: F.regexp_replace(F.trim(F.concat(a.family, F.lit(", "), initials(a.given))), ",+$", "")), ", & ")
    line = _join(names, F.when(year != "", F.concat(F.lit("("), year, F.lit(")."))), F.concat(title, F.lit(".")), end(source, "."))
    return F.concat(line, F.when(link != "", F.concat(F.lit(" "), link)).otherwise(""))


def cited_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages as references: title, authors, year, journal and DOI as a page's head states them, its host as the publisher.

    What a page does not state is empty, for a null page all of it. The last word of an author's name is the family's.
    """

    def plain(c: Column) -> Column:
        for entity, char in ENTITIES:
            c = F.replace(c, F.lit(entity), F.lit(char))
        return F.trim(F.regexp_replace(c, r"\s+", " "))

    html, url = F.coalesce(html_col, F.lit("")), F.coalesce(url_col, F.lit(""))
    meta = lambda name: plain(F.regexp_extract(html, META % name, 1))
    names = F.filter(F.transform(F.regexp_extract_all(html, F.lit(META % "author"), F.lit(1)), plain), lambda n: n != "")
    authors = F.transform(names, lambda n: F.struct(F.trim(F.regexp_replace(n, r"\S+$", "")).alias("given"), F.regexp_extract(n, r"\S+$", 0).alias("family")))
    year = F.regexp_extract(meta("(?:publication_)?date"), r"(?:19|20)\d\d", 0)
    return pages.select(
        F.col(id_col).alias("id"), plain(F.regexp_extract(html, TITLE, 1)).alias("title"), authors.alias("authors"), year.alias("year"), meta("journal_title").alias("journal"),
        F.regexp_extract(F.lower(url), HOST, 1).alias("publisher"), F.regexp_replace(F.regexp_extract(meta("doi"), DOI, 0), r"\.+$", "").alias("doi"), url.alias("url"))


def best_records(refs: DataFrame, id_col: str = "id") -> DataFrame:
    """One record for each title key, with a DOI first, then most authors, then the earliest; at the key's first place.

    Untitled records stay. ``(id, place)``: the chosen record and its group's first id.
    """
    key = T.title_key(F.col("title"))
    rows = refs.withColumn("_key", F.md5(F.when(key == "", F.concat(F.lit("#"), F.col(id_col).cast("string"))).otherwise(key)))
    rank = F.struct((F.coalesce(F.col("doi"), F.lit("")) != "").alias("doi"), F.coalesce(F.size("authors"), F.lit(0)).alias("n"), (-F.col(id_col)).alias("neg"))
    return rows.groupBy("_key").agg(F.max(rank).alias("b"), F.min(id_col).alias("place")).select((-F.col("b.neg")).alias(id_col), "place")


def verdicts(entries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(entry_id, verdict, confidence, matched_id, doi_mismatch)`` of entries (``entry_id, entry``) against a catalogue.

    An equal DOI decides; else the best F1 of title words, found by a join on words.
    """
    doi = F.lower(F.regexp_replace(F.regexp_extract("entry", DOI, 0), r"\.+$", ""))
    e = entries.select("entry_id", doi.alias("entry_doi"), T.content_tokens(F.col("entry"), REFERENCE_STOP_WORDS).alias("et"))
    c = catalogue.select(F.col("id").alias("matched_id"), F.lower(F.coalesce("doi", F.lit(""))).alias("found_doi"), T.content_tokens(F.col("title"), REFERENCE_STOP_WORDS).alias("tt"))
    by_doi = e.where("entry_doi <> ''").join(c.where("found_doi <> ''"), F.col("entry_doi") == F.col("found_doi")).select("entry_id", "matched_id", "found_doi", F.lit(1.0).alias("f1"), F.size("tt").alias("nt"), F.lit(True).alias("by_doi"))
    shared = e.select("entry_id", F.size("et").alias("ne"), F.explode("et").alias("t")).join(c.select("matched_id", "found_doi", F.size("tt").alias("nt"), F.explode("tt").alias("t")), "t").groupBy("entry_id", "matched_id", "found_doi", "ne", "nt").agg(F.count("*").alias("o"))
    by_title = shared.select("entry_id", "matched_id", "found_doi", F.round(2.0 * F.col("o") / (F.col("nt") + F.greatest("ne", F.lit(1))), 6).alias("f1"), "nt", F.lit(False).alias("by_doi"))
    rank = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("by_doi"), F.desc("f1"), "matched_id"))
    best = by_doi.unionByName(by_title).withColumn("r", rank).where("r = 1").drop("r")
    rows = e.join(best, "entry_id", "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    verdict = F.when(F.col("by_doi") | ((F.col("f1") >= 0.7) & (F.col("nt") >= 4)), "Verified").when(F.col("f1") >= 0.4, "Possible match").otherwise("Not found")
    rows = rows.withColumn("verdict", verdict)
    clash = (F.col("verdict") == "Verified") & ~F.col("by_doi") & (F.col("entry_doi") != "") & (F.col("found_doi") != "") & (F.col("entry_doi") != F.col("found_doi"))
    return rows.select("entry_id", "verdict", F.col("f1").alias("confidence"), "matched_id", F.coalesce(clash, F.lit(False)).alias("doi_mismatch"))


def checked_lists(docs: DataFrame, catalogue: DataFrame, limit: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict counts of the first ``limit`` entries of each reference list, and whether more were left unchecked.

    Lists of different documents are checked together: an entry's number is its document's times ``limit`` plus its place.
    """
    entries = T.reference_entries(docs, id_col, text_col)
    sizes = entries.groupBy(id_col).agg(F.count("*").alias("entries"))
    first = entries.where(F.col("pos") < limit).select((F.col(id_col) * limit + F.col("pos")).alias("entry_id"), "entry")
    of = F.floor(F.col("entry_id") / limit).cast("long").alias(id_col)
    counts = verdicts(first, catalogue).groupBy(of).agg(*[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("Verified", "verified"), ("Possible match", "possible"), ("Not found", "not_found"))])
    return sizes.join(counts, id_col).select(id_col, "entries", "verified", "possible", "not_found", (F.col("entries") > limit).alias("truncated"))

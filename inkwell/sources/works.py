"""Works searches as a data source: a partition for each page of each topic, read by the tasks.

``spark.read.format("inkwell_works").option("url", …).option("topics", json.dumps([…])).load()`` after ``register(spark)``. A page that
can't be read gives one row with its ``error`` and stops nothing; a page without a titled work gives one empty row, so that
each page asked for is seen in the result.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkwell.sources.providers import Retryable, with_retries

SCHEMA = "topic string, page int, place int, title string, authors array<struct<given:string,family:string>>, year string, journal string, publisher string, doi string, url string, type string, abstract string, error string"
#: Records of one page at most.
MOST_ROWS = 25
#: Status codes worth another attempt.
AGAIN = {408, 425, 429, 500, 502, 503, 504}
#: When this process last asked, for the pause between its requests.
LAST = {"at": 0.0}


def clamp_rows(rows: int) -> int:
    return max(1, min(MOST_ROWS, rows))


def _text(v) -> str:
    return "" if v is None else str(v).strip()


def _first(v) -> str:
    return _text(v[0]) if isinstance(v, list) and v else ""


def _objects(v) -> list[dict]:
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def registry_records(body: dict) -> list[dict]:
    """Records of a registry's answer (``message.items``, fields as lists)."""
    out = []
    for w in _objects((body.get("message") or {}).get("items")):
        authors = [(_text(a.get("given")), _text(a.get("family"))) for a in _objects(w.get("author"))]
        dated = (w.get("issued") or {}).get("date-parts") or [[]]
        out.append({
            "title": _first(w.get("title")), "authors": [a for a in authors if any(a)], "year": _first(dated[0]), "journal": _first(w.get("container-title")),
            "publisher": _text(w.get("publisher")), "doi": _text(w.get("DOI")), "url": _text(w.get("URL")), "type": _text(w.get("type")), "abstract": _text(w.get("abstract"))})
    return out


def archive_records(body: dict) -> list[dict]:
    """Records of an open archive's answer (``results``, plain fields, whole names)."""
    out = []
    for w in _objects(body.get("results")):
        names = [_text(a.get("name")) for a in _objects(w.get("authors"))]
        split = [(n.split(",", 1)[1].strip(), n.split(",", 1)[0].strip()) if "," in n else (n.rpartition(" ")[0], n.rpartition(" ")[2]) for n in names if n]
        journals = _objects(w.get("journals"))
        out.append({
            "title": _text(w.get("title")), "authors": split, "year": _text(w.get("yearPublished")), "journal": _text(journals[0].get("title")) if journals else "",
            "publisher": _text(w.get("publisher")), "doi": _text(w.get("doi")), "url": _text(w.get("downloadUrl")), "type": _text(w.get("documentType")), "abstract": _text(w.get("abstract"))})
    return out


#: Answer's form: query parameter, page size, offset, records.
FORMS = {"registry": ("query", "rows", "offset", registry_records), "archive": ("q", "limit", "offset", archive_records)}


@dataclass
class Page(InputPartition):
    topic: str
    page: int


class WorksReader(DataSourceReader):
    """Pages by offset. Each process waits ``pause`` seconds between its requests and repeats those worth it, as the server asks."""

    def __init__(self, options: dict):
        self.url, self.form = options["url"], options.get("form", "registry")
        if self.form not in FORMS:
            raise ValueError(f"form is one of {sorted(FORMS)}")
        self.rows = clamp_rows(int(options.get("rows", 8)))
        self.timeout, self.pause, self.attempts = float(options.get("timeout", 20)), float(options.get("pause", 0.2)), int(options.get("attempts", 4))
        self.token = options.get("token")
        if "asked" in options:
            self.asked = [Page(t, int(p)) for t, p in json.loads(options["asked"])]
        else:
            topics = [t.strip() for t in json.loads(options["topics"])]
            self.asked = [Page(t, p) for t in dict.fromkeys(topics) if t for p in range(int(options.get("pages", 1)))]

    def partitions(self) -> list[Page]:
        return self.asked

    def _body(self, asked: Page) -> str:
        query, size, offset, _ = FORMS[self.form]
        address = f"{self.url}?{urllib.parse.urlencode({query: asked.topic, size: self.rows, offset: asked.page * self.rows})}"
        headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        time.sleep(max(0.0, LAST["at"] + self.pause - time.monotonic()))
        LAST["at"] = time.monotonic()
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=self.timeout) as r:
                return r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            after = e.headers.get("Retry-After") if e.headers else None
            if e.code in AGAIN:
                raise Retryable(f"status {e.code}", float(after) if after and after.isdigit() else None) from e
            return f"Error: status {e.code}"
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Retryable(f"not reached: {getattr(e, 'reason', e)}") from e

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition is None:
            return
        body, error, found = with_retries(lambda: self._body(partition), self.attempts), None, []
        if body.startswith("Error:"):
            error = body
        else:
            try:
                got = json.loads(body)
                found = [r for r in FORMS[self.form][3](got if isinstance(got, dict) else {}) if r["title"]]
            except (ValueError, AttributeError, TypeError, LookupError) as e:
                error = f"Error: invalid answer ({type(e).__name__})"
        key = (partition.topic, partition.page)
        if not found:
            yield (*key, None, None, None, None, None, None, None, None, None, None, error)
        for place, r in enumerate(found[: self.rows]):
            authors = [{"given": g, "family": f} for g, f in r["authors"]]
            yield (*key, place, r["title"], authors, r["year"], r["journal"], r["publisher"], r["doi"], r["url"], r["type"], r["abstract"], None)


class WorksSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inkwell_works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorksReader:
        return WorksReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorksSource)


def search(spark: SparkSession, url: str, topics: list[str], pages: int = 1, **options) -> DataFrame:
    """All rows of the topics' pages. Empty topics are left out, repeated ones asked once."""
    register(spark)
    reader = spark.read.format("inkwell_works").option("url", url).option("topics", json.dumps(topics)).option("pages", pages)
    return reader.options(**options).load()


def sweep(spark: SparkSession, url: str, topics: list[str], folder: str, pages: int = 1, **options) -> DataFrame:
    """Appends the pages that ``folder`` doesn't hold yet, failed ones again, and returns all that it holds.

    A sweep that was stopped goes on where its last written call ended, and no page is asked for twice once it is held. The list of pages is
    the caller's own, so it passes the driver; records do not.
    """
    register(spark)
    wanted = [(t, p) for t in dict.fromkeys(t.strip() for t in topics) if t for p in range(pages)]
    plan = spark.createDataFrame(wanted, "topic string, page int")
    held = read_sweep(spark, folder)
    missing = plan.join(held.where("error IS NULL").select("topic", "page").distinct(), ["topic", "page"], "left_anti")
    asked = [(r.topic, r.page) for r in missing.orderBy("topic", "page").collect()]
    if asked:
        spark.read.format("inkwell_works").option("url", url).option("asked", json.dumps(asked)).options(**options).load().write.mode("append").parquet(folder)
    return read_sweep(spark, folder)


def read_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """What a sweep's folder holds; a page's error goes once the page has been read."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(folder)
    done = rows.where("error IS NULL").select("topic", "page").distinct().withColumn("_done", F.lit(True))
    # failed attempts of one page count once
    failed = rows.where("error IS NOT NULL").join(done, ["topic", "page"], "left_anti").dropDuplicates(["topic", "page"])
    return rows.where("error IS NULL").unionByName(failed.select(*rows.columns))


def works(rows: DataFrame) -> DataFrame:
    """The records alone, those of one DOI or title once: the first by topic, page and place."""
    from pyspark.sql.window import Window

    from inkwell.functions.text import title_key

    key = F.when(F.coalesce("doi", F.lit("")) != "", F.lower("doi")).otherwise(title_key(F.col("title")))
    first = F.row_number().over(Window.partitionBy(key).orderBy("topic", "page", "place"))
    return rows.where("title IS NOT NULL").withColumn("_n", first).where("_n = 1").drop("_n", "error")

"""Boundaries to what needs a network or a large model, with offline behaviour.

A provider is any object with the method below; it is called inside tasks on batches. Without one,
results say that it is unavailable; nothing is made up.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFLINE = "AI features are not available: no backend is configured."


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Retryable(Exception):
    """A failure worth another attempt; ``after`` are the seconds the server asks for."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


def wait_seconds(attempt: int, after: float | None = None, hint: float | None = None, cap: float = 30.0) -> float:
    """The server's wait, else its hint and a quarter second, else 2 ** attempt; at most ``cap``."""
    return min(cap, after if after is not None else hint + 0.25 if hint is not None else 2.0**attempt)


def with_retries(call: Callable[[], str], attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result, or a sentinel string after the last failure."""
    for n in range(attempts):
        try:
            return call()
        except Retryable as e:
            if n == attempts - 1:
                return f"Error: {e}"
            sleep(wait_seconds(n, e.after))
    return "Error: no attempt was made"


def generate(rows: DataFrame, prompt_col: str, provider: Generator | None = None, out_col: str = "reply") -> DataFrame:
    """Adds a reply to each row; without a provider, the sentinel."""
    if provider is None:
        return rows.withColumn(out_col, F.lit(OFFLINE))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = provider.generate([p or "" for p in b.column(names.index(prompt_col)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string())], names=[*names, out_col])

    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(out_col)).schema)


class InOrder:
    """Backends by name, asked one after the other: what one answers with a sentinel, or fails on, goes to the next.

    What none answers keeps the last sentinel.
    """

    def __init__(self, backends: list[tuple[str, Generator]]):
        self.backends = backends

    @staticmethod
    def failed(reply: str | None) -> bool:
        from inkwell.functions.lexicons import UNAVAILABLE

        low = (reply or "").strip().lower()
        return not low or low.startswith(tuple(UNAVAILABLE))

    def generate(self, prompts: list[str]) -> list[str]:
        out = [OFFLINE] * len(prompts)
        open_ = list(range(len(prompts)))
        for name, backend in self.backends:
            if not open_:
                break
            try:
                said = backend.generate([prompts[i] for i in open_])
            except Exception as e:  # a backend is another's code: whatever it raises, the next one is asked
                said = [f"Error: backend '{name}': {e}"] * len(open_)
            for i, reply in zip(open_, said, strict=True):
                out[i] = reply or OFFLINE
            open_ = [i for i in open_ if self.failed(out[i])]
        return out

    def status(self) -> dict[str, bool]:
        """Which backends say that they are available; one that can't tell counts as available."""
        return {name: bool(getattr(b, "available", lambda: True)()) for name, b in self.backends}


def embed(rows: DataFrame, text_col: str, provider: Embedder | None = None, batch: int = 16) -> DataFrame:
    """Adds ``embedding`` (null without a provider)."""
    if provider is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = provider.embed([t or "" for t in part.column(names.index(text_col)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.list_(pa.float32()))], names=[*names, "embedding"])

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("array<float>").alias("embedding")).schema)


def search_catalogue(queries: DataFrame, catalogue: DataFrame, rows: int = 8) -> DataFrame:
    """``(query_id, id, shared, rank)``: titled records by shared words, at most 25; the offline form of a works search."""
    from pyspark.sql.window import Window

    from inkwell.functions.lexicons import REFERENCE_STOP_WORDS
    from inkwell.functions.text import content_tokens

    q = queries.select("query_id", F.explode(content_tokens(F.col("query"), REFERENCE_STOP_WORDS)).alias("t"))
    c = catalogue.where(F.trim(F.coalesce("title", F.lit(""))) != "").select("id", F.explode(content_tokens(F.col("title"), REFERENCE_STOP_WORDS)).alias("t"))
    shared = q.join(c, "t").groupBy("query_id", "id").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "id"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= max(1, min(25, rows)))


class Scrubber:
    """An offline backend for repairs: it deletes the listed items from the prompt it is asked to rewrite."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.rewritten(p) for p in prompts]

    @staticmethod
    def rewritten(prompt: str) -> str:
        import re

        from inkwell.functions.lexicons import PLACEHOLDER

        found = re.search(r'(?s)\nListed items: ([^\n]*)\n.*?Prompt:\n"""(.*)"""', prompt)
        if found is None:
            return ""
        text = found[2]
        for item in found[1].split(", "):
            if item == "placeholder token":
                text = re.sub(PLACEHOLDER, " ", text)
            elif "dash" not in item:
                text = re.sub(rf"(?i)(?<!\w){re.escape(item)}(?!\w)", "", text)
        return text


class WordJudge:
    """An offline judge: the share of a criterion's content words that stand in the paper, in hundredths, rounded down."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.judged(p) for p in prompts]

    @staticmethod
    def judged(prompt: str) -> str:
        import json
        import re

        from inkwell.functions.lexicons import REFERENCE_STOP_WORDS

        found = re.search(r'(?s)\nCriterion: ([^\n]*)\n.*?\n"""\n(.*)\n"""', prompt)
        if found is None:
            return ""
        content = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2 and w not in REFERENCE_STOP_WORDS}
        wanted = content(found[1])
        there = wanted & content(found[2])
        return json.dumps({"reasoning": f"{len(there)} of {len(wanted)} words", "score": 100 * len(there) // max(1, len(wanted)), "evidence": " ".join(sorted(there)), "location": "", "severity": "", "fix": ""})

"""JSON inside model replies: a balanced-bracket scan that regular expressions can't express, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def balanced(text: str, opening: str = "{", closing: str = "}") -> Iterator[str]:
    """Outermost bracketed spans from the left; brackets inside JSON strings don't count."""
    depth, start, quoted, escaped = 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
        elif c == '"' and depth:
            quoted, escaped = True, False
        elif c == opening:
            if depth == 0:
                start = i
            depth += 1
        elif c == closing and depth:
            depth -= 1
            if depth == 0:
                yield text[start : i + 1]


def best_object(text: str | None, wanted: tuple[str, ...]) -> str | None:
    """The last object with all wanted keys, else the last with the final one, as compact JSON."""
    found = []
    for span in balanced(text or ""):
        try:
            found.append(json.loads(span))
        except ValueError:
            continue
    whole = [o for o in found if all(k in o for k in wanted)]
    some = [o for o in found if wanted[-1] in o]
    pick = whole or some
    return json.dumps(pick[-1], ensure_ascii=False) if pick else None


def best_array(text: str | None) -> str | None:
    """The longest array of objects."""
    found = []
    for span in balanced(text or "", "[", "]"):
        try:
            got = json.loads(span)
        except ValueError:
            continue
        if got and all(isinstance(x, dict) for x in got):
            found.append(got)
    return json.dumps(max(found, key=len), ensure_ascii=False) if found else None


def object_column(*wanted: str):
    """A column function: text to the JSON of its best object."""

    @F.pandas_udf(T.StringType())
    def pick(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: best_object(t, wanted))

    return pick


@F.pandas_udf(T.StringType())
def array_column(texts: pd.Series) -> pd.Series:
    return texts.map(best_array)

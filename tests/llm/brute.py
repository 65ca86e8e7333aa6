"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near(texts, percent=85):
    s = {i: shingles(t) for i, t in texts.items()}

    def linked(a, b):
        x, y = s[a], s[b]
        if not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(x & y)
        return 100 * both >= percent * (len(x) + len(y) - both)

    return components(sorted(texts), linked), {i: len(v) for i, v in s.items()}


def edits(a, b, most=2):
    """Edit distance, as far as ``most``."""
    if abs(len(a) - len(b)) >= most:
        return most
    if most == 2:
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return 0 if a == b else 1 if a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] else 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return min(row[-1], most)


def lines(rows, least, bound=1):
    """(row, line) -> reason or None of lines that aren't blank, for rows (row, text) in the order of the corpus."""
    every = [(d, n, x) for d, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip()]
    seen, first, out = {}, [], {}
    for d, n, x in every:
        if x in seen:
            out[d, n] = "exact"
            continue
        seen[x] = True
        out[d, n] = "near" if len(x) >= least and any(edits(x, y, bound + 1) <= bound for y in first) else None
        if len(x) >= least:
            first.append(x)
    return out

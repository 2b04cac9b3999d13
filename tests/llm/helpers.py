"""Plain versions of the operators, and inputs with every odd case."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal texts."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return [
        (1, "alpha beta gamma delta", "en", "a", 22),
        (2, "alpha  beta\tgamma\ndelta", "en", "b", 22),
        (2, "alpha  beta\tgamma\ndelta", "en", "b", 22),
        (3, None, "en", "a", None),
        (4, "", "de", None, 0),
        (5, " \t\n ", None, None, 4),
        (6, long, "en", "a", len(long)),
        (7, long, "en", "a", len(long)),
        (8, "x" * 200_000, None, "", 200_000),
        (None, "alpha beta gamma delta", None, None, None),
        (None, None, None, None, None),
        (9, "Ünïcode ÄÖ 😀 words", "de", "b", 19),
        (10, "one", "en", "c", 3),
    ]


def odd(spark, **extra):
    """odd_rows with extra columns named as an operator's outputs are."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows(), DOC).withColumns({k: F.lit(v) for k, v in extra.items()})


def empty(spark):
    return spark.createDataFrame([], DOC)


def grouped(rows: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """Near duplicates by comparing all sets: id -> (size of its set, component)."""
    sets = {}
    for d, t in rows:
        w = WORD.findall(ascii_lower(t or ""))
        k = min(size, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    for d, s in sets.items():
        for o, common in Counter(o for g in s for o in holders[g] if o < d).items():
            if 100 * common >= percent * (len(s) + len(sets[o]) - common):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def base_spans(text: str | None) -> list[str]:
    """The base personal data of a text, by the plain patterns."""
    out, text = [], text or ""
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def hits(text: str | None, items: list[tuple]) -> tuple[int, int, list]:
    """n_words, n_hit and items of one document by trying every window of every item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    own, hit, found = words(text), set(), set()
    for ident, t in items:
        w = words(t)
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1) if w else ():
            if tuple(own[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(ident)
    return len(own), len(hit), sorted(map(str, found))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def agrees(spark, query, sql: str, sf_dir: str) -> None:
    """A query's rows are those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir), con.sql(sql)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    a = sorted(map(str, (tuple(r) for r in got.select(*names).collect())))
    assert a == sorted(map(str, want.select(*[f'"{n}"' for n in names]).fetchall()))

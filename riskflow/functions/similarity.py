"""Fuzzy similarity of short strings, 0 to 1, always asked for distinct strings only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from .narration import category_by_keyword

LEAST_PARTIAL, LEAST_SAME = 0.80, 0.92


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of b's positions for each letter of a."""
    places: dict[str, int] = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << k
    row = 0
    for c in a:
        x = row | places.get(c, 0)
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of the shared words against either side's words."""
    x, y = set(a.lower().split()), set(b.lower().split())
    both, one, two = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    left, right = f"{both} {one}".strip(), f"{both} {two}".strip()
    return max(ratio(left, right), ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0)


def partial_ratio(short: str, long: str) -> float:
    """The best window of the longer string."""
    if len(short) > len(long):
        short, long = long, short
    return max((ratio(short, long[k : k + len(short)]) for k in range(len(long) - len(short) + 1)), default=0.0) if short else 0.0


def assign_category(rows: DataFrame) -> DataFrame:
    """rows with ``category``: by keyword, else the first category of the best partial match of at least 80 %, else uncategorized.

    rows: narration and direction. Only distinct narrations without a keyword are compared.
    """
    keyed = rows.withColumn("_key", category_by_keyword(F.col("narration"), F.col("direction")))

    @F.pandas_udf("string")
    def fuzzy(narration: pd.Series, direction: pd.Series) -> pd.Series:
        def one(text: str, way: str) -> str:
            best, name = 0.0, "uncategorized"
            for category, (only, words) in config.CATEGORIES.items():
                if only in ("any", way):
                    score = max(partial_ratio(w, text.lower()) for w in words)
                    if score >= LEAST_PARTIAL and score > best:
                        best, name = score, category
            return name

        return pd.Series([one(t or "", w) for t, w in zip(narration, direction, strict=True)])

    missed = keyed.where("_key is null").select("narration", "direction").distinct().select(F.col("narration").alias("_n"), F.col("direction").alias("_d"), fuzzy("narration", "direction").alias("_fuzzy"))
    joined = keyed.join(missed, F.col("narration").eqNullSafe(F.col("_n")) & F.col("direction").eqNullSafe(F.col("_d")), "left")
    return joined.select(*rows.columns, F.coalesce("_key", "_fuzzy").alias("category"))


def merge_variants(names: DataFrame, least: float = LEAST_SAME) -> DataFrame:
    """statement_id, name, key: names of one statement that mean the same, the longest first; never across statements."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys: list[str] = []
        out = {}
        for name in sorted(pdf.name, key=lambda s: (-len(s), s)):
            out[name] = next((k for k in keys if token_set_ratio(name, k) >= least), name)
            if out[name] == name:
                keys.append(name)
        return pd.DataFrame({"statement_id": pdf.statement_id.iloc[0], "name": list(out), "key": list(out.values())})

    return names.where("name is not null").select("statement_id", "name").distinct().groupBy("statement_id").applyInPandas(merge, "statement_id long, name string, key string")


def match_templates(headers: DataFrame, templates: dict[str, list[str]], least: float = 0.85) -> DataFrame:
    """file, template, score: the template whose headers are on average nearest to a file's, if near enough.

    headers: file and header (its cells). Distinct header rows are compared with every template.
    """

    @F.pandas_udf("template string, score double")
    def best(cells: pd.Series) -> pd.DataFrame:
        def one(row) -> tuple:
            scored = [(sum(max((token_sort_ratio(h, c) for c in row), default=0.0) for h in own) / len(own), name) for name, own in templates.items()]
            score, name = max(scored, key=lambda s: s[0])
            return (name if score >= least else None), score

        return pd.DataFrame([one(r) for r in cells], columns=["template", "score"])

    found = headers.select("header").distinct().withColumn("_m", best("header"))
    return headers.join(found, "header").select("file", "_m.template", "_m.score")

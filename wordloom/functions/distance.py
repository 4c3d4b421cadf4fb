"""Edit distances with transpositions, as Arrow functions, and exact blocking for small distances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def damerau_levenshtein(a: str, b: str) -> int:
    """Unrestricted: what a transposition moved may be edited again."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            before = last.get(y, 0)
            swap = rows[before][match] + (i - before - 1) + 1 + (j - match - 1)
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swap))
            if x == y:
                match = j
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


def optimal_alignment(a: str, b: str) -> int:
    """Restricted: each place is edited once."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j - 1] + (x != y), row[j - 1] + 1, before[j] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


@pandas_udf(T.LongType())
def dl_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau_levenshtein(x, y) for x, y in zip(a, b)], dtype="Int64")


@pandas_udf(T.LongType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else optimal_alignment(x, y) for x, y in zip(a, b)], dtype="Int64")


def deletions(term: Column, most: int) -> Column:
    """The term with up to `most` (1 or 2) characters left out. Terms within that distance of each other share one, so an equi-join on them misses none."""
    one = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array(term), one(term))
    if most > 1:
        parts = F.concat(parts, F.flatten(F.transform(one(term), one)))
    return F.array_distinct(parts)

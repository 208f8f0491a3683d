"""Scores of generated against reference texts."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from geoquarry.operators.kernels import lcs


def word_split(text: Column) -> Column:
    """The stand-in word splitter: words of any script, single Han characters; another may take its place."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[一-鿿]|[^\s\p{P}一-鿿]+"), F.lit(0))


def rouge_n(predicted: Column, reference: Column, n: int) -> Column:
    """F of shared n-grams of two word arrays, counted as multisets; 0 where either side has none."""

    def one(a, b) -> float:
        if a is None or b is None or len(a) < n or len(b) < n:
            return 0.0
        a, b = list(a), list(b)
        x, y = (Counter(zip(*[w[i:] for i in range(n)])) for w in (a, b))
        shared = sum(min(c, y[g]) for g, c in x.items())
        p, r = shared / (len(a) - n + 1), shared / (len(b) - n + 1)
        return 2 * p * r / (p + r) if shared else 0.0

    def run(predicted: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(predicted, reference)], dtype=float)

    return F.pandas_udf(run, DoubleType())(predicted, reference)


@F.pandas_udf(DoubleType())
def rouge_l(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    """F of the longest common subsequence of words."""

    def one(a, b) -> float:
        if a is None or b is None or not len(a) or not len(b):
            return 0.0
        n = lcs(list(a), list(b))
        p, r = n / len(a), n / len(b)
        return 2 * p * r / (p + r) if n else 0.0

    return pd.Series([one(a, b) for a, b in zip(predicted, reference)])


@F.pandas_udf(DoubleType())
def bleu4(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    """Character BLEU of up to four characters, of one prediction against one reference.

    A precision that is zero becomes 1 / (2^k n), k counting the zero ones, as
    in the third common smoothing. Without a shared character the score is 0.
    """

    def one(a: str | None, b: str | None) -> float:
        if not a or not b:
            return 0.0
        total, k = 0.0, 1
        for n in (1, 2, 3, 4):
            grams = Counter(a[i : i + n] for i in range(len(a) - n + 1))
            known = Counter(b[i : i + n] for i in range(len(b) - n + 1))
            hit = sum(min(c, known[g]) for g, c in grams.items())
            size = max(1, sum(grams.values()))
            if not hit:
                if n == 1:
                    return 0.0
                k *= 2
            total += math.log(hit / size if hit else 1 / (k * size)) / 4
        brief = 1.0 if len(a) > len(b) else math.exp(1 - len(b) / len(a))
        return math.exp(total) * brief

    return pd.Series([one(a, b) for a, b in zip(predicted, reference)])

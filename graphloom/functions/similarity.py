"""Matching-block similarity, 0 to 100, where edit distance would give other values.

ratio() is twice the matched characters over all characters (Ratcliff and Obershelp's matching blocks);
weighted_ratio() is the best of it and of its variants for parts and for tokens, scaled down. Both are
Arrow-batched UDFs: the algorithm is not one that built-in functions can express.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def ratio_of(a: str | None, b: str | None) -> int:
    if a is None or b is None:
        return 0
    return round(100 * SequenceMatcher(None, a, b).ratio()) if a or b else 100


def _part_of(a: str, b: str) -> int:
    """The best ratio of the shorter text with a stretch of the longer as long as it, beginning where matching blocks do."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 0
    starts = {max(0, y - x) for x, y, _ in SequenceMatcher(None, short, long_).get_matching_blocks()}
    best = max(SequenceMatcher(None, short, long_[s : s + len(short)]).ratio() for s in starts)
    return 100 if best > 0.995 else round(100 * best)


def _plain(text: str) -> str:
    """Letters and digits in lower case, all else as space, none at the ends."""
    return re.sub(r"(?u)\W", " ", text).lower().strip()


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def _token_sets(a: str, b: str, score) -> int:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(rest))}".strip() for rest in (x - y, y - x))
    return max(score(both, one), score(both, two), score(one, two))


def weighted_ratio_of(a: str | None, b: str | None) -> int:
    p, q = _plain(a or ""), _plain(b or "")
    if not p or not q:
        return 0
    lengths = max(len(p), len(q)) / min(len(p), len(q))
    tokens, part = 0.95, 0.9 if lengths <= 8 else 0.6
    found = [float(ratio_of(p, q))]
    if lengths < 1.5:
        found += [ratio_of(_sorted_tokens(p), _sorted_tokens(q)) * tokens, _token_sets(p, q, ratio_of) * tokens]
    else:
        found += [_part_of(p, q) * part, _part_of(_sorted_tokens(p), _sorted_tokens(q)) * tokens * part, _token_sets(p, q, _part_of) * tokens * part]
    return round(max(found))


@F.pandas_udf(IntegerType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(IntegerType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

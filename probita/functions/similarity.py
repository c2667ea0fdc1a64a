"""Name similarity: the share of letters two texts have in common, in order.

The value is 2 * LCS / (len1 + len2), the greater of the one for the lower-cased texts and the one
for their sorted words. Spark has no expression for it (edit distance with substitutions differs),
so the two texts go through one vectorised function. Everything around it stays native: the
lower-casing, the word sorting, the length bounds and the choice of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probita.functions.scalars import column, known, words


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), dtype=np.uint32)
    for row, text in enumerate(texts):
        if text:
            out[row, : len(text)] = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return out


def _lcs_words(left: list[str], right: list[str]) -> np.ndarray:
    """Common-subsequence lengths of many pairs at once; the left texts have at most 64 letters."""
    width = max(len(t) for t in left)
    a, b = _codes(left, width), _codes(right, max(len(t) for t in right))
    lengths = np.array([len(t) for t in left], dtype=np.uint64)
    powers = np.left_shift(np.uint64(1), np.arange(width, dtype=np.uint64))
    full = np.where(lengths == 64, np.uint64(0xFFFFFFFFFFFFFFFF),
                    np.left_shift(np.uint64(1), np.minimum(lengths, np.uint64(63))) - np.uint64(1))
    state = full.copy()
    for at in range(b.shape[1]):
        letter = b[:, at]
        hits = ((a == letter[:, None]) & (letter[:, None] != 0)) @ powers & state
        state = ((state + hits) | (state - hits)) & full
    return np.bitwise_count(full ^ state).astype(np.int64)


def _lcs_long(left: str, right: str) -> int:
    places: dict[str, int] = {}
    for at, letter in enumerate(left):
        places[letter] = places.get(letter, 0) | (1 << at)
    full = (1 << len(left)) - 1
    state = full
    for letter in right:
        hits = state & places.get(letter, 0)
        state = ((state + hits) | (state - hits)) & full
    return len(left) - state.bit_count()


def _ratios(lefts: list[str], rights: list[str]) -> np.ndarray:
    """Ratio of each pair; short pairs go through the array version in groups of like length."""
    scores = np.zeros(len(lefts))
    grouped = []
    for row, (a, b) in enumerate(zip(lefts, rights)):
        if a == b:
            scores[row] = 1.0
        elif a and b:
            if min(len(a), len(b)) <= 64 and max(len(a), len(b)) <= 512:
                grouped.append(row)
            else:
                scores[row] = 2.0 * _lcs_long(a, b) / (len(a) + len(b))
    grouped.sort(key=lambda row: max(len(lefts[row]), len(rights[row])))
    for start in range(0, len(grouped), 4096):
        rows = grouped[start: start + 4096]
        short = [min(lefts[r], rights[r], key=len) for r in rows]
        long = [max(lefts[r], rights[r], key=len) if len(lefts[r]) != len(rights[r]) else rights[r] for r in rows]
        short = [lefts[r] if len(lefts[r]) == len(rights[r]) else s for r, s in zip(rows, short)]
        total = np.array([len(a) + len(b) for a, b in zip(short, long)])
        scores[rows] = 2.0 * _lcs_words(short, long) / total
    return scores


def _distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each pair, and for every code a row it occurs in."""
    first, second = pd.factorize(left)[0].astype(np.int64), pd.factorize(right)[0].astype(np.int64)
    _, rows, codes = np.unique(first * (second.max() + 1) + second, return_index=True, return_inverse=True)
    return codes, rows


def best_ratio(left: pd.Series, right: pd.Series, left_sorted: pd.Series, right_sorted: pd.Series) -> pd.Series:
    """Greater of the plain and the sorted-word ratio; NULL where a side is NULL.

    Equal pairs of a batch are compared once.
    """
    out = np.full(len(left), np.nan)
    filled = np.flatnonzero((left.notna() & right.notna()).to_numpy())
    if not len(filled):
        return pd.Series(out)
    columns = [c.to_numpy(dtype=object)[filled] for c in (left, right, left_sorted, right_sorted)]
    codes, rows = _distinct(columns[0], columns[1])
    a, b, a_sorted, b_sorted = ([c[r] for r in rows] for c in columns)
    scores = _ratios(a, b)
    again = [r for r in range(len(a)) if scores[r] < 1.0 and (a_sorted[r] != a[r] or b_sorted[r] != b[r])]
    if again:
        scores[again] = np.maximum(scores[again], _ratios([a_sorted[r] for r in again], [b_sorted[r] for r in again]))
    out[filled] = scores[codes]
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _best_ratio(left: pd.Series, right: pd.Series, left_sorted: pd.Series, right_sorted: pd.Series) -> pd.Series:
    return best_ratio(left, right, left_sorted, right_sorted)


@F.pandas_udf(T.DoubleType())
def _best_alias_ratio(name: pd.Series, name_sorted: pd.Series, aliases: pd.Series, aliases_sorted: pd.Series) -> pd.Series:
    sizes = np.array([0 if a is None else len(a) for a in aliases])
    out = np.zeros(len(name))
    if sizes.sum():
        owner = np.repeat(np.arange(len(name)), sizes)

        def flat(lists: pd.Series) -> pd.Series:
            return pd.Series([text for texts in lists if texts is not None for text in texts], dtype=object)

        best = best_ratio(pd.Series(name.to_numpy(dtype=object)[owner]), flat(aliases),
                          pd.Series(name_sorted.to_numpy(dtype=object)[owner]), flat(aliases_sorted))
        np.maximum.at(out, owner, np.nan_to_num(best.to_numpy()))
    return pd.Series(np.where(name.isna(), np.nan, out))


def sorted_words(value: Column | str) -> Column:
    return F.array_join(F.array_sort(words(F.lower(column(value)))), " ")


def prepared(prefix: str, name: str, value: Column | str) -> dict[str, Column]:
    """The two forms a text is compared in, NULL where it is empty: made once per row, not once per pair."""
    text = known(value)
    return {f"{prefix}{name}_low": F.lower(text), f"{prefix}{name}_words": sorted_words(text)}


def prepared_similarity(left: str, right: str) -> Column:
    """Similarity of two prepared texts; 0 where a side is missing."""
    columns = [F.col(f"{side}_{form}") for form in ("low", "words") for side in (left, right)]
    return F.coalesce(_best_ratio(*columns), F.lit(0.0))


def prepared_bound(left: str, right: str) -> Column:
    """A value the similarity of two prepared texts cannot exceed, from their lengths alone."""
    def bound(form: str) -> Column:
        a, b = F.length(f"{left}_{form}"), F.length(f"{right}_{form}")
        return 2.0 * F.least(a, b) / F.greatest(a + b, F.lit(1))
    # Two texts without any word count as equal in their sorted form.
    wordless = (F.length(f"{left}_words") == 0) & (F.length(f"{right}_words") == 0)
    return F.coalesce(F.when(wordless, 1.0).otherwise(F.greatest(bound("low"), bound("words"))), F.lit(0.0))


def prepared_aliases(prefix: str, aliases: Column | str) -> dict[str, Column]:
    listed = F.filter(column(aliases), lambda a: a.isNotNull() & (a != ""))
    return {f"{prefix}aliases_low": F.transform(listed, F.lower), f"{prefix}aliases_words": F.transform(listed, sorted_words)}


def prepared_alias_similarity(name: str, aliases: str) -> Column:
    """Best similarity of the name to any alias; 0 where there is no alias."""
    return F.coalesce(_best_alias_ratio(f"{name}_low", f"{name}_words", f"{aliases}_low", f"{aliases}_words"), F.lit(0.0))


def similarity(left: Column | str, right: Column | str) -> Column:
    """Similarity of two plain text columns; 0 where a side is missing, else the greater ratio."""
    left, right = known(left), known(right)
    return F.coalesce(_best_ratio(F.lower(left), F.lower(right), sorted_words(left), sorted_words(right)), F.lit(0.0))


def vector_similarity(left: Column | str, right: Column | str) -> Column:
    """Cosine of two vectors, held to 0..1; NULL where one is missing or has no length."""
    left, right = column(left), column(right)

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    size = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(left, right) / F.nullif(size, F.lit(0.0))))

"""License scan: winnowed fingerprints find candidates, banded alignment says how much of a template is there, and where.

The templates are a fixed list, so their inverted index is small and goes to every task; a document is scanned where it
is read. Words outside the templates' vocabulary can't be part of a fingerprint, so most of a text is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probita.llm.decontam import words
from probita.llm.license_texts import TEMPLATES

#: Words in a fingerprint, and fingerprints of which the smallest is kept: a run of GRAM + WINDOW - 1 common words is always found.
GRAM, WINDOW = 3, 2
#: Templates of at most SHORT words have fingerprints of SHORT_GRAM words and all are kept: COVERAGE of five words leaves no longer run for sure.
SHORT, SHORT_GRAM = 16, 2
#: Least share of a template's words that must be aligned.
COVERAGE = 0.8
#: Words that an alignment may drift from its seeds, at least; longer templates may drift by a tenth of their length.
BAND = 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

SCHEMA = "doc_id {id}, license string, template int, start int, end int, matched int, coverage double"


@dataclass(frozen=True)
class Index:
    """Templates as word numbers, and their fingerprints with the places they stand at."""

    names: list[str]
    templates: list[np.ndarray]
    numbers: dict[bytes, int]
    prints: np.ndarray
    template: np.ndarray
    place: np.ndarray
    short_prints: np.ndarray
    short_template: np.ndarray
    short_place: np.ndarray

    @staticmethod
    def of(templates: Sequence[tuple[str, str]] = TEMPLATES, gram: int = GRAM, window: int = WINDOW) -> Index:
        """Templates of fewer words than a fingerprint can't be found and are refused."""
        said = [words(text) for _, text in templates]
        if any(len(s) < gram + window - 1 for s in said):
            raise ValueError("a template is shorter than what is always found")
        numbers = {w: i + 1 for i, w in enumerate(sorted({w for s in said for w in s}))}
        arrays = [np.array([numbers[w] for w in s], np.int64) for s in said]
        sides = []
        for short, (g, w) in ((False, (gram, window)), (True, (SHORT_GRAM, 1))):
            found = sorted((h, t, p) for t, a in enumerate(arrays) if (len(a) <= SHORT) == short for h, p in zip(*winnowed(a, g, w), strict=True))
            sides += [np.array([f[k] for f in found], kind) for k, kind in enumerate((np.uint64, np.int64, np.int64))]
        return Index([n for n, _ in templates], arrays, numbers, *sides)


def winnowed(numbers: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and places kept of a sequence; words numbered 0 break it."""
    n = len(numbers) - gram + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, broken = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(gram):
        part = numbers[k:k + n]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        broken |= part == 0
    h[broken] = _NONE
    if n < window:
        place = np.array([int(h.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, window)
        place = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    place = place[h[place] != _NONE]
    return h[place], place


def aligned(template: np.ndarray, document: np.ndarray, low: int, high: int, band: int) -> tuple[int, int, int]:
    """(matched words, first word, past the last word) of the best local alignment on the diagonals from ``low`` to ``high``, give or take ``band``.

    A match counts 1, a mismatch or a gap -1. Of equal alignments the one that ends first in the template, then in the document.
    """
    width, m = high - low + 2 * band + 1, len(template)
    shift = np.arange(width)
    held = np.zeros((m + 1, width + 1), np.int64)
    equal = np.zeros((m, width), bool)
    for i in range(m):
        column = i + low - band + shift
        inside = (column >= 0) & (column < len(document))
        equal[i] = inside & (document[np.clip(column, 0, len(document) - 1)] == template[i])
        row = np.maximum(np.maximum(held[i, :-1] + np.where(equal[i], 1, -1), held[i, 1:] - 1), 0)
        held[i + 1, :-1] = np.maximum.accumulate(row + shift) - shift  # gaps in the template, each a step to the right
    i, b = np.unravel_index(int(held[1:, :-1].argmax()), (m, width))
    i, b, matched = int(i) + 1, int(b), 0
    past = i + low - band + b
    first = past
    while i > 0 and held[i, b] > 0:
        if held[i, b] == held[i - 1, b] + (1 if equal[i - 1, b] else -1):
            matched += bool(equal[i - 1, b])
            i -= 1
            first = i + low - band + b
        elif held[i, b] == held[i - 1, b + 1] - 1:
            i, b = i - 1, b + 1
        else:
            b -= 1
            first = i + low - band + b
    return matched, first, past


def _seeds(prints: np.ndarray, places: np.ndarray, known: np.ndarray, template: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
    """(template, diagonal) of every fingerprint of a text that a template has."""
    first, past = np.searchsorted(known, prints, "left"), np.searchsorted(known, prints, "right")
    times = past - first
    at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times - first, times)
    return list(zip(template[at].tolist(), (np.repeat(places, times) - place[at]).tolist(), strict=True))


def matches(text: str | None, index: Index, coverage: float = COVERAGE, gram: int = GRAM, window: int = WINDOW, band: int = BAND) -> list[tuple[str, int, int, int, int, float]]:
    """(license, template, start, end, matched words, coverage) of a text, in order; places in characters, the end exclusive."""
    said = words(text)
    numbers = np.array([index.numbers.get(w, 0) for w in said], np.int64)
    seeds = sorted(_seeds(*winnowed(numbers, gram, window), index.prints, index.template, index.place)
                   + _seeds(*winnowed(numbers, SHORT_GRAM, 1), index.short_prints, index.short_template, index.short_place))
    found = []
    k = 0
    while k < len(seeds):
        t, low = seeds[k]
        reach = max(band, len(index.templates[t]) // 10)
        high = low
        while k < len(seeds) and seeds[k][0] == t and seeds[k][1] <= low + reach:
            high = seeds[k][1]
            k += 1
        matched, begin, end = aligned(index.templates[t], numbers, low, high, reach)
        share = matched / len(index.templates[t])
        if share >= coverage:
            found.append((matched, share, -t, begin, end))
    # Of matches that overlap, the one with more matched words, then with the larger share, then the template listed first.
    kept: list[tuple[int, int, int, int, float]] = []
    taken = np.zeros(len(said) + 1, bool)
    for matched, share, t, begin, end in sorted(set(found), key=lambda f: (-f[0], -f[1], -f[2], f[3])):
        if not taken[begin:end].any():
            taken[begin:end] = True
            kept.append((begin, end, -t, matched, share))
    if not kept:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(index.names[t], t, spans[b][0], spans[e - 1][1], n, c) for b, e, t, n, c in sorted(kept)]


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """A row for every license match: ``doc_id``, ``license``, ``template`` (its number), ``start``, ``end``, ``matched``, ``coverage``.

    Texts are read whole; NULL and empty texts and texts without a license have no row, repeated rows have theirs each.
    A license that stands several times in a text has a row for each place. Matches don't overlap.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(Index.of(templates))  # the templates, whatever the corpus

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, rows = [], []
            for i, text in enumerate(part.column(1)):
                for match in matches(text.as_py(), sent.value, coverage):
                    at.append(i)
                    rows.append(match)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                                             names=["doc_id", "license", "template", "start", "end", "matched", "coverage"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(batches, SCHEMA.format(id=kind))

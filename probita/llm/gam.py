"""Quality scores by a generalised additive model with pairwise interactions.

A text is a row of plain measures (lengths, shares of kinds of characters, repetition). Shallow trees are boosted in
turn, one measure at a time, round after round; all trees of a measure add up to one table over its bins. The pairs of
measures that explain most of what is left get tables of their own, boosted in the same way. A score is the logistic
of a sum of table entries.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probita.session import scratch_path

#: Labelled rows that the tables are fitted on, chosen by a hash of id and text.
SAMPLE = 20_000
BINS, LEAVES = 32, 4
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE = 0.1
#: Bins a side of a pair's table.
PAIR_BINS = 8
#: Added to every leaf's weight, so that bins with few rows move little.
SHRINK = 1.0
LIMIT = 0.3
#: Characters read at a time, which bounds what a very long text takes besides its words.
AT_ONCE = 1 << 22

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (9, 32), "line": (10,),
    "stop": map(ord, ".,;:"), "shout": map(ord, "!?"), "rule": map(ord, "|_~"), "symbol": map(ord, "#$%&*@^+=<>"), "bracket": map(ord, "()[]{}\\/"),
    "quote": map(ord, "\"'`-"), "control": [c for c in range(32) if c not in (9, 10, 13)] + [127], "high": range(128, 256),
}
_KIND_OF = np.zeros((256, len(_KINDS)), np.int64)
for _at, _codes in enumerate(_KINDS.values()):
    _KIND_OF[list(_codes), _at] = 1

MEASURES = ["log_bytes", "log_words", "mean_word", "log_longest_word", *[f"share_{k}" for k in _KINDS], "upper_of_letters", "distinct_words", "top_word",
            "repeated_neighbours", "distinct_pairs", "log_lines", "distinct_lines", "capital_words", "bare_words", "single_letters"]


def measures(text: str | None) -> list[float]:
    """The measures of a whole text, in the order of ``MEASURES``; zeros for NULL and empty texts."""
    if not text:
        return [0.0] * len(MEASURES)
    seen = np.zeros(256, np.int64)
    size = 0
    for at in range(0, len(text), AT_ONCE):
        part = text[at:at + AT_ONCE].encode("utf-8", "surrogatepass")
        seen += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        size += len(part)
    kinds = seen @ _KIND_OF
    upper, lower = int(kinds[0]), int(kinds[1])
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    lengths = list(map(len, words)) or [0]
    counts = Counter(words)
    pairs = n - 1
    return [float(x) for x in (
        np.log1p(size), np.log1p(n), sum(lengths) / max(n, 1), np.log1p(max(lengths)), *(kinds / size), upper / max(upper + lower, 1),
        len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1),
        sum(map(str.__eq__, words, words[1:])) / max(pairs, 1), len(set(zip(words, words[1:], strict=False))) / max(pairs, 1),
        np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1),
        sum(map(str.istitle, words)) / max(n, 1), sum(map(str.isalpha, words)) / max(n, 1), lengths.count(1) / max(n, 1))]


@dataclass
class Tables:
    """Cuts and table of every measure, the pairs with theirs, and the constant."""

    cuts: list[np.ndarray]
    single: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    double: np.ndarray = field(default_factory=lambda: np.zeros((0, PAIR_BINS, PAIR_BINS)))
    constant: float = 0.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1 for each row of measures, by additions over bins of all rows at once."""
        total = np.full(len(rows), self.constant)
        for j, cuts in enumerate(self.cuts):
            total += self.single[j][np.searchsorted(cuts, rows[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.double, strict=True):
            total += table[np.searchsorted(self.pair_cuts[a], rows[:, a], "right"), np.searchsorted(self.pair_cuts[b], rows[:, b], "right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))

    def dumped(self) -> str:
        return json.dumps({"cuts": [c.tolist() for c in self.cuts], "single": self.single.tolist(), "pairs": self.pairs,
                           "pair_cuts": [c.tolist() for c in self.pair_cuts], "double": self.double.tolist(), "constant": self.constant})

    @staticmethod
    def read(said: str) -> Tables:
        x = json.loads(said)
        return Tables([np.array(c, float) for c in x["cuts"]], np.array(x["single"], float), [tuple(p) for p in x["pairs"]],
                      [np.array(c, float) for c in x["pair_cuts"]], np.array(x["double"], float).reshape(-1, PAIR_BINS, PAIR_BINS), x["constant"])


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Values that begin a bin; equal values share one."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A step per bin: the bins cut into at most ``leaves`` runs, each time where the loss falls most."""
    g, h = np.concatenate(([0.0], np.cumsum(gradient))), np.concatenate(([0.0], np.cumsum(weight)))
    ends = [0, len(gradient)]

    def worth(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, -1
        left, right = (g[at] - g[a]) ** 2 / (h[at] - h[a] + SHRINK), (g[b] - g[at]) ** 2 / (h[b] - h[at] + SHRINK)
        gain = left + right - (g[b] - g[a]) ** 2 / (h[b] - h[a] + SHRINK)
        best = int(gain.argmax())
        return float(gain[best]), int(at[best])

    open_runs = {(0, len(gradient)): worth(0, len(gradient))}
    while len(ends) <= leaves:
        (a, b), (gain, at) = max(open_runs.items(), key=lambda x: (x[1][0], -x[0][0]))
        if gain <= 1e-12:
            break
        ends.append(at)
        del open_runs[a, b]
        open_runs[a, at], open_runs[at, b] = worth(a, at), worth(at, b)
    step = np.zeros(len(gradient))
    ends.sort()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SHRINK)
    return step


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """How much the best cross of two cuts lowers the loss, and its steps over the grid."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        inner, right, below, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [inner, right - inner, below - inner, whole - right - below + inner]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(gradient)
    steps = [(x, y + SHRINK) for x, y in zip(parts(g), parts(h), strict=True)]
    gain = sum(x * x / y for x, y in steps) - g[-1, -1] ** 2 / (h[-1, -1] + SHRINK)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    made = np.empty_like(gradient)
    for (x, y), rows, columns in zip(steps, (slice(0, a + 1), slice(0, a + 1), slice(a + 1, None), slice(a + 1, None)),
                                     (slice(0, b + 1), slice(b + 1, None), slice(0, b + 1), slice(b + 1, None)), strict=True):
        made[rows, columns] = x[a, b] / y[a, b]
    return float(gain[a, b]), made


def boosted(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> Tables:
    """Tables fitted to rows of measures with labels 0 and 1; a constant of one half where there are no rows."""
    n, m = rows.shape
    cuts = [_cuts(rows[:, j], BINS) if n else np.empty(0) for j in range(m)]
    coarse = [_cuts(rows[:, j], PAIR_BINS) if n else np.empty(0) for j in range(m)]
    out = Tables(cuts, np.zeros((m, BINS)), pair_cuts=coarse)
    if not n:
        return out
    share = (labels.sum() + 0.5) / (n + 1)
    out.constant = float(np.log(share / (1 - share)))
    total = np.full(n, out.constant)
    bins = [np.searchsorted(cuts[j], rows[:, j], "right") for j in range(m)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(m):
            if len(cuts[j]):
                gradient, weight = slopes()
                step = RATE * _tree(np.bincount(bins[j], gradient, len(cuts[j]) + 1), np.bincount(bins[j], weight, len(cuts[j]) + 1), LEAVES)
                out.single[j, :len(step)] += step
                total += step[bins[j]]
    few = [np.searchsorted(coarse[j], rows[:, j], "right") for j in range(m)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        sides = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(few[a] * sides[1] + few[b], values, sides[0] * sides[1]).reshape(sides)

    gradient, weight = slopes()
    worth = sorted(((-_quadrants(grid(a, b, gradient), grid(a, b, weight))[0], a, b) for a, b in combinations(range(m), 2)))
    out.pairs = sorted((a, b) for gain, a, b in worth[:pairs] if gain < -1e-9)
    out.double = np.zeros((len(out.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(out.pairs):
            gradient, weight = slopes()
            step = RATE * _quadrants(grid(a, b, gradient), grid(a, b, weight))[1]
            out.double[k, :step.shape[0], :step.shape[1]] += step
            total += step[few[a], few[b]]
    return out


def measured(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (``_0``, ``_1`` ... in that order), ``key`` (a hash of the text) and ``row``, the measures of the whole text, for every row."""
    keep = docs.columns if keep is None else keep
    names = [f"_{i}" for i in range(len(keep))]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            flat = np.array([measures(x.as_py()) for x in part.column(0)], float).reshape(-1)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.FixedSizeListArray.from_arrays(pa.array(flat), len(MEASURES)).cast(pa.list_(pa.float64()))], names=[*names, "key", "row"])

    text = F.col(text_column).cast("string")
    narrow = docs.select(text.alias("_text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.xxhash64(text).alias("key"))
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(keep, names, strict=True))
    return narrow.mapInArrow(batches, f"{kinds}key bigint, row array<double>")


def fit(rows: DataFrame, sample: int = SAMPLE) -> Tables:
    """Tables from ``label`` (0, 1) and ``row``; ``key`` (a long) chooses the sample, so that the same rows give the same tables.

    Rows beyond ``sample`` are chosen by hash, in each task first; that many at most meet in one task, and what comes to the driver is the tables.
    """
    n = rows.count()
    mixed = F.xxhash64("key", F.lit("sample"))
    if n > sample:
        rate = min(1.0, 1.5 * sample / n + 50.0 / n)
        rows = rows.where(F.pmod(mixed, F.lit(1 << 30)) < F.lit(int(rate * (1 << 30))))
    chosen = rows.orderBy(mixed, "key", "label").limit(sample).select("key", "label", "row").repartition(1)

    def one(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts))
        if table.num_rows:
            matrix = np.array(table.column("row").to_pylist(), float)
            labels = table.column("label").to_numpy().astype(float)
            order = np.lexsort((labels, *matrix.T, table.column("key").to_numpy()))
            made = boosted(matrix[order], labels[order])
            yield pa.RecordBatch.from_arrays([pa.array([made.dumped()])], names=["tables"])

    found = chosen.mapInArrow(one, "tables string").collect()
    return Tables.read(found[0].tables) if found else boosted(np.empty((0, len(MEASURES))), np.empty(0))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from the fit: one in five by checksum of its id; rows without an id are."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE,
          limit: float = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: the id) with ``held_out``, ``score`` (0 to 1) and ``predicted`` for every row.

    Learns the labels 0 and 1 of rows that are not held out; other labels, NULLs and labels without a document teach
    nothing, and of an id's several labels each counts. Texts are read once, whole, in an own written table of measures;
    the text alone makes a score, so equal texts score the same. NULL texts are taken as empty. Without labels every score is
    one half. Columns of other names are not read, whatever they are called.
    """
    keep = [id_column] if keep is None else keep
    names = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep, 1)]
    spark = docs.sparkSession
    path = scratch_path(spark, "measures")
    measured(docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)]),
             "t", keep=["i", *[f"k{n}" for n in range(len(keep))]]).write.parquet(path)
    rows = spark.read.parquet(path)
    known = labels.select(F.col(id_column).alias("_0"), F.col(label_column).alias("label")).where(F.col("label").isin(0, 1) & ~held_out("_0"))
    tables = fit(rows.select("_0", F.xxhash64("_0", "key").alias("key"), "row").where(F.col("_0").isNotNull()).join(known, "_0").select("key", "label", "row"), sample)
    sent = spark.sparkContext.broadcast(tables)  # bins x measures numbers, whatever the corpus

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            matrix = part.column("row").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sent.value.scores(matrix))], names=[*part.schema.names[:-1], "score"])

    sides = rows.select(*[f"_{i}" for i in range(1, len(keep) + 1)], held_out("_0").alias("held_out"), "row")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sides.drop("row").schema)
    return sides.mapInArrow(batches, f"{kinds}, score double").select(*names, "held_out", "score", (F.col("score") >= limit).cast("int").alias("predicted"))

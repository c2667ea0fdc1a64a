"""Language identification by the nearest of several centroids per language.

A text is a unit vector of hashed letter n-grams (one to three letters), damped counts weighted by inverse document
frequency. Centroids are clusters of such vectors, found per language; the nearest centroid by cosine names the
language, and a text too far from it is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probita.llm.common import free_name

UNDETERMINED = "und"
FOUND = ("lang_pred", "score", "rejected")
DIMENSIONS = 8192
CENTROIDS = 4
#: Labelled texts per language that the centroids are fitted on (the document frequencies take all of them).
SAMPLE = 400
#: A text is rejected below this share of the similarity that all but ``TAIL`` of its language's sample reach.
REJECT_SHARE = 0.2
TAIL = 0.01
#: Texts of fewer n-grams are rejected from a proportionally smaller similarity: a word or two say little against a language.
EVIDENCE = 200
#: Letters read at a time, which bounds the memory that a very long text takes.
LETTERS_AT_ONCE = 1 << 20

_BREAK = np.ones(128, bool)
_BREAK[[*range(65, 91), *range(97, 123)]] = False


def counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed n-grams; everything in ASCII that is no letter is one break between words."""
    total = np.zeros(dimensions, np.int64)
    for at in range(0, len(text), LETTERS_AT_ONCE):
        codes = np.frombuffer((" " + text[max(0, at - 2):at + LETTERS_AT_ONCE].lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        low = codes < 128
        codes[low] = np.where(_BREAK[codes[low]], 32, codes[low])
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))].astype(np.uint64)
        one = codes * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:]
        for grams in (one[codes != 32], two, three):
            total += np.bincount((grams >> np.uint64(40)) % np.uint64(dimensions), minlength=dimensions)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def _vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the numbers of n-grams."""
    rows = np.stack([counts(t, len(idf)) for t in texts])
    return _unit(np.log1p(rows).astype(np.float32) * idf), rows.sum(axis=1)


@dataclass(frozen=True)
class Model:
    """Weights of the dimensions, the centroids with their languages, and the least similarity each centroid accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def nearest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, similarities and rejections. Ties go to the language that sorts first."""
        languages = [UNDETERMINED] * len(texts)
        scores, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(known), 256):
            some = known[at:at + 256]
            if not self.languages:
                break
            vectors, grams = _vectors([texts[i] for i in some], self.idf)
            near = vectors @ self.centroids.T
            best = near.argmax(axis=1)
            least = self.least[best] * np.minimum(1.0, grams / EVIDENCE)
            for i, b, s, limit in zip(some, best.tolist(), near.max(axis=1).tolist(), least.tolist(), strict=True):
                languages[i], scores[i], rejected[i] = self.languages[b], min(1.0, max(0.0, s)), s < limit
        return languages, scores, rejected


def _clusters(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the row nearest the mean and then, each time, the row farthest from all starts."""
    mean = _unit(rows.mean(axis=0))
    starts = [int((rows @ mean).argmax())]
    while len(starts) < min(k, len(rows)):
        starts.append(int((rows @ rows[starts].T).max(axis=1).argmin()))
    centres = rows[starts]
    for _ in range(20):
        own = (rows @ centres.T).argmax(axis=1)
        new = _unit(np.stack([rows[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def fit(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", dimensions: int = DIMENSIONS, k: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """Learns from rows with a language and a letter in their text; other rows are ignored, repeated rows count as often as they stand.

    Document frequencies are summed over all rows, partition by partition. Centroids are clustered per language from at
    most ``sample`` rows of it, chosen by a hash of the text; so many rows of one language, however common it is, meet
    in a task. What reaches the driver is ``k`` centroids a language. Without rows the model knows no language and
    rejects every text.
    """
    narrow = labelled.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def frequencies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, langs = np.zeros(dimensions, np.int64), 0, {}
        for part in parts:
            for text, lang in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                total += counts(text.as_py(), dimensions) > 0
                rows += 1
                langs[lang] = langs.get(lang, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([str(d) for d in range(dimensions)] + [""] + [f"={x}" for x in langs]), pa.array([*total.tolist(), rows, *langs.values()], pa.int64())], names=["what", "n"])

    summed = dict(narrow.mapInArrow(frequencies, "what string, n bigint").groupBy("what").agg(F.sum("n").alias("n")).collect())
    rows = summed.pop("", 0)
    per_lang = {x[1:]: n for x, n in summed.items() if x.startswith("=")}
    idf = np.log((1.0 + rows) / (1.0 + np.array([summed.get(str(d), 0) for d in range(dimensions)]))).astype(np.float32) + 1
    if not per_lang:
        return Model(idf, np.empty((0, dimensions), np.float32), [], np.empty(0))

    def cluster(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        vectors, grams = _vectors(group["text"].tolist(), idf)
        centres = _clusters(vectors, k)
        near = vectors @ centres.T
        long = grams >= min(EVIDENCE, grams.max())
        least = float(np.quantile(near.max(axis=1)[long], TAIL)) * REJECT_SHARE
        return pd.DataFrame({"lang": key[0], "at": range(len(centres)), "least": least, "centre": [c.astype(np.float32).tobytes() for c in centres]})

    # A share of each language by hash first, so that no more than about the sample leaves the tasks; half as many again for chance.
    spread = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[x for lang, n in sorted(per_lang.items()) for x in (F.lit(lang), F.lit(min(1.0, 1.5 * sample / n + 50.0 / n)))]), F.col("lang"))
    chosen = narrow.withColumn("h", spread).where(F.col("h") <= rate)
    first = Window.partitionBy("lang").orderBy("h", "text")
    chosen = chosen.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("lang", "text")
    found = chosen.groupBy("lang").applyInPandas(cluster, "lang string, at int, least double, centre binary").orderBy("lang", "at").collect()
    return Model(idf, np.stack([np.frombuffer(r.centre, np.float32) for r in found]), [r.lang for r in found], np.array([r.least for r in found]))


def predict(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected`` for every row.

    The text alone decides. NULL texts and texts without a letter are ``und`` with score 0 and rejected; a text too far
    from its nearest centroid keeps that language and is rejected. Texts are read whole. Where a kept column has the name
    of a new one, the new one gets underscores before its name (``found_names``).
    """
    keep = docs.columns if keep is None else keep
    names = [f"_{i}" for i in range(len(keep))]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # dimensions x centroids numbers, whatever the corpus

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            languages, scores, rejected = sent.value.nearest(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(languages, pa.string()), pa.array(scores), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col(text_column).cast("string").alias("_text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True))
    out = narrow.mapInArrow(batches, f"{kinds}{', ' * bool(kinds)}lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *[F.col(n).alias(c) for n, c in zip(FOUND, found_names(keep), strict=True)])


def found_names(keep: list[str]) -> list[str]:
    """The names of the language, score and rejection that ``predict`` adds to columns ``keep``."""
    return [free_name(n, keep) for n in FOUND]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from the fit: one in three by checksum of its id; rows without an id are."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))

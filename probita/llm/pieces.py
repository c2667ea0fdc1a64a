"""SentencePiece segmentation with N-best lists, and decoding.

The best segmentation comes from a forward Viterbi pass over the piece lattice. Its scores are exact heuristics for an
A-star search that runs backward from the end of the lattice and pops segmentations in the order of their scores.

A text's lattice falls apart where no piece can cross: before a word mark, and around line ends. Each distinct stretch
is solved once for many texts at a time, with array operations over all of them. Only the N - 1 stretches that lose least
by their second-best segmentation can differ from the best within the N best segmentations of a text (leaving
such a stretch at its best and changing one of those instead gives N - 1 that are no worse), so the search is over them.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probita.llm.common import free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 3
MARK = "▁"
#: Stands for a mark that was in the text before blanks became marks; no valid text holds it.
_LITERAL = "\udc81"
#: What an unknown character loses against the lowest score of a piece.
UNKNOWN_PENALTY = 10.0
#: Characters of texts that are cut together, characters of new stretches that are one lattice, and characters of stretches whose solutions a task keeps.
CHUNK, SOLVED, KEPT = 1 << 20, 1 << 18, 1 << 21
#: Steps of fewer edges are taken one by one: array operations cost more there.
FEW = 48
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

ENCODED = ("n_pieces bigint, ids array<int>, score double, "
           "alternatives array<struct<score:double,edits:array<struct<at:int,n:int,ids:array<int>>>>>, round_trip boolean")


@dataclass(frozen=True)
class Model:
    """Pieces and scores of a model file, with tables to look substrings up by hash."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: list[int]
    unknown: int
    dummy_prefix: bool
    hashes: np.ndarray = field(repr=False)
    ids: np.ndarray = field(repr=False)
    longest: int = 1
    unknown_score: float = 0.0
    breaks: str = ""

    @staticmethod
    def load(path: str = MODEL) -> Model:
        with open(path, "rb") as file:
            return Model.parse(file.read())

    @staticmethod
    def parse(content: bytes) -> Model:
        """From the bytes of a model file. Models that rewrite texts before they cut them are refused."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        said = proto.ModelProto()
        said.ParseFromString(content)
        normalizer = said.normalizer_spec
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
            raise ValueError("only models that keep texts as they are can be decoded exactly")
        kinds = proto.ModelProto.SentencePiece.Type
        usable = [i for i, p in enumerate(said.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        pieces = [p.piece for p in said.pieces]
        byte_ids = [-1] * 256
        for i, p in enumerate(said.pieces):
            if p.type == kinds.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
        if any(MARK in pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece holds a word mark within")
        table: dict[int, int] = {}
        for i in usable:
            h = 0
            for at, c in enumerate(pieces[i]):
                h = (h * _BASE + ord(c) + 1) & _MASK
                if at + 1 < len(pieces[i]):
                    table.setdefault(h, -1)
            table[h] = i
        hashes = np.array(sorted(table), np.uint64)
        scores = np.array([p.score for p in said.pieces], np.float64)
        alphabet = set("".join(pieces[i] for i in usable))
        return Model(pieces, scores, byte_ids, next((i for i, p in enumerate(said.pieces) if p.type == kinds.UNKNOWN), 0), normalizer.add_dummy_prefix,
                     hashes, np.array([table[int(h)] for h in hashes], np.int64), max((len(pieces[i]) for i in usable), default=1),
                     (scores[usable].min() if usable else 0.0) - UNKNOWN_PENALTY, "".join(c for c in "\n\r\t" if c not in alphabet))

    def unknown_ids(self, char: str) -> list[int]:
        """An unknown character as its bytes, or as the unknown piece of a model without bytes."""
        found = [self.byte_ids[b] for b in (MARK if char == _LITERAL else char).encode("utf-8", "surrogatepass")]
        return found if min(found) >= 0 else [self.unknown]


@dataclass
class Lattice:
    """All edges of the lattices of some stretches. Nodes are numbered through; stretch i has ``first[i]`` to ``last[i]``."""

    stretches: list[str]
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    forward: np.ndarray
    second: np.ndarray
    path: np.ndarray
    path_ends: np.ndarray

    @staticmethod
    def of(stretches: list[str], model: Model) -> Lattice:
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        codes = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(stretches)), sizes)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        last = first + sizes
        node = np.arange(len(codes)) + owner  # each stretch has a node more than characters
        left = last[owner] - node
        # Substrings are extended from all places at once as long as they begin a piece.
        starts, lengths, found = [], [], []
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        single = np.zeros(len(codes), bool)
        for length in range(1, model.longest + 1):
            inside = left[at] >= length
            at, h = at[inside], h[inside]
            h = h * np.uint64(_BASE) + codes[at + length - 1] + np.uint64(1)
            place = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
            known = model.hashes[place] == h
            at, h, ids = at[known], h[known], model.ids[place[known]]
            whole = ids >= 0
            starts.append(at[whole])
            lengths.append(np.full(int(whole.sum()), length))
            found.append(ids[whole])
            if length == 1:
                single[at[whole]] = True
            if not len(at):
                break
        lone = np.flatnonzero(~single)
        char = np.concatenate([*starts, lone])
        length = np.concatenate([*lengths, np.ones(len(lone), np.int64)])
        piece = np.concatenate([*found, np.full(len(lone), -1)])
        start = node[char]
        end = start + length
        score = np.where(piece >= 0, model.scores[piece], model.unknown_score)
        of = owner[char]
        # By distance from the beginning, then by end, the longest piece first; one number each sorts faster than three.
        span, many = model.longest + 1, len(codes) + len(stretches) + 1
        order = np.argsort(((end - first[of]) * many + end) * span + (model.longest - length))
        start, end, piece, score, of = start[order], end[order], piece[order], score[order], of[order]

        def swept(step: np.ndarray, frm: np.ndarray, to: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Best score of every node from ``origin``, and the edge it comes by (of equal ones the first). Edges are sorted by ``step``."""
            best = np.full(len(codes) + len(stretches), -np.inf)
            came = np.full(len(best), -1)
            best[origin] = 0.0
            edges = np.concatenate(([0], np.flatnonzero(step[1:] != step[:-1]) + 1, [len(step)])) if len(step) else np.zeros(1, np.int64)
            many = np.flatnonzero(np.diff(edges) >= FEW)
            steps = edges[:many[-1] + 2] if len(many) else edges[:1]  # from the last step with many edges on, one long stretch or two are left
            for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
                cand, goal = best[frm[a:b]] + score_of[a:b], to[a:b]
                heads = np.concatenate(([0], np.flatnonzero(goal[1:] != goal[:-1]) + 1))
                top = np.maximum.reduceat(cand, heads)
                equal = np.flatnonzero(cand == np.repeat(top, np.diff(np.concatenate((heads, [len(cand)])))))
                best[goal[heads]] = top
                came[goal[heads]] = a + equal[np.searchsorted(equal, heads)]
            rest = int(steps[-1])
            if rest < len(step):
                left = np.unique(np.concatenate([frm[rest:], to[rest:]]))
                values, ways = dict(zip(left.tolist(), best[left].tolist(), strict=True)), dict(zip(left.tolist(), came[left].tolist(), strict=True))
                for at in range(rest, len(step), SOLVED):
                    part = slice(at, at + SOLVED)
                    for edge, (a, b, gain) in enumerate(zip(frm[part].tolist(), to[part].tolist(), score_of[part].tolist(), strict=True), at):
                        if values[a] + gain > values[b]:
                            values[b], ways[b] = values[a] + gain, edge
                best[left], came[left] = list(values.values()), list(ways.values())
            return best, came

        score_of = score
        forward, came = swept(end - first[of], start, end, first)
        back = np.argsort(((last[of] - start) * many + start) * span + (end - start))
        score_of = score[back]
        backward, _ = swept((last[of] - start)[back], end[back], start[back], last)
        # Follow the best edges back from all ends at once.
        on_best = np.zeros(len(start), bool)
        walked, whose = [], []
        some, at_node = np.arange(len(stretches)), last.copy()
        some = some[at_node > first]
        while len(some) > 4:
            edge = came[at_node[some]]
            on_best[edge] = True
            walked.append(edge)
            whose.append(some)
            at_node[some] = start[edge]
            some = some[at_node[some] > first[some]]
        for one in some.tolist():
            node, begin, way = int(at_node[one]), int(first[one]), []
            while node > begin:
                way.append(int(came[node]))
                node = int(start[way[-1]])
            on_best[way] = True
            walked.append(np.array(way, np.int64))
            whose.append(np.full(len(way), one))
        whose_all = np.concatenate(whose or [np.empty(0, np.int64)])[::-1]
        path = np.concatenate(walked or [np.empty(0, np.int64)])[::-1][np.argsort(whose_all, kind="stable")]
        through = np.where(on_best, -np.inf, forward[start] + score + backward[end])
        rival = np.full(len(stretches), -np.inf)
        np.maximum.at(rival, of, through)
        return Lattice(stretches, first, last, start, end, piece, score, forward, np.maximum(forward[last] - rival, 0.0), path, np.cumsum(np.bincount(whose_all, minlength=len(stretches))))

    def best(self, stretch: int) -> list[int]:
        """Edges of the best way through a stretch."""
        return self.path[self.path_ends[stretch - 1] if stretch else 0:self.path_ends[stretch]].tolist()

    def best_ids(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best ways, one stretch after another, and how many each has."""
        found = self.piece[self.path]
        owner = np.repeat(np.arange(len(self.stretches)), np.diff(self.path_ends, prepend=0))
        lone = np.flatnonzero(found < 0)
        if not len(lone):
            return found.astype(np.int32), np.bincount(owner, minlength=len(self.stretches))
        spelt = [model.unknown_ids(self.stretches[w][o]) for w, o in zip(owner[lone].tolist(), (self.start[self.path[lone]] - self.first[owner[lone]]).tolist(), strict=True)]
        times = np.ones(len(found), np.int64)
        times[lone] = [len(x) for x in spelt]
        out = np.repeat(found, times)
        out[out < 0] = [i for x in spelt for i in x]
        return out.astype(np.int32), np.bincount(np.repeat(owner, times), minlength=len(self.stretches))

    def ids(self, edges: list[int], model: Model, stretch: int) -> list[int]:
        out: list[int] = []
        for e in edges:
            p = int(self.piece[e])
            out.extend([p] if p >= 0 else model.unknown_ids(self.stretches[stretch][int(self.start[e] - self.first[stretch])]))
        return out

    def into(self) -> dict[int, list[int]]:
        """Edges that end in each node."""
        out: dict[int, list[int]] = {}
        for e, n in enumerate(self.end.tolist()):
            out.setdefault(n, []).append(e)
        return out


def n_best(lattice: Lattice, into: dict[int, list[int]], chain: list[int], n: int) -> list[tuple[float, list[list[int]]]]:
    """The ``n`` best ways through the stretches of ``chain``, one after another: A-star from the end, (score, edges per stretch)."""
    whole = [float(lattice.forward[lattice.last[s]]) for s in chain]
    before = np.concatenate(([0.0], np.cumsum(whole))).tolist()
    ticket = count(0, -1)  # of equal ones the newest goes on, so that ties are followed to the end one by one
    heap = [(-before[-1], next(ticket), len(chain) - 1, int(lattice.last[chain[-1]]), 0.0, None)]
    out = []
    while heap and len(out) < n:
        _, _, k, node, done, link = heapq.heappop(heap)
        while k >= 0 and node == lattice.first[chain[k]]:
            k -= 1
            node = int(lattice.last[chain[k]]) if k >= 0 else -1
        if k < 0:
            ways: list[list[int]] = [[] for _ in chain]
            while link is not None:
                edge, at, link = link
                ways[at].append(edge)
            out.append((done, ways))
            continue
        for e in into.get(node, ()):
            to, total = int(lattice.start[e]), done + float(lattice.score[e])
            heapq.heappush(heap, (-(total + float(lattice.forward[to]) + before[k]), next(ticket), k, to, total, (e, k, link)))
    return out


class Encoder:
    """Segments chunks of texts and keeps the solutions of stretches between them, a bounded number."""

    def __init__(self, model: Model, nbest: int = NBEST) -> None:
        self.model, self.nbest = model, nbest
        inner = re.escape(model.breaks)
        self.cut = re.compile((f"[{inner}]|" if inner else "") + f"{MARK}+[^{MARK}{inner}]*|[^{MARK}{inner}]+").findall
        self.bytes = [p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            if i >= 0:
                self.bytes[i] = bytes([b])
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.kept = 0
        self.flat, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)
        self.scores, self.seconds = np.empty(0), np.empty(0)

    def prepared(self, text: str) -> str:
        if not text:
            return ""
        marked = (text.replace(MARK, _LITERAL) if MARK in text else text).replace(" ", MARK)
        return MARK + marked if self.model.dummy_prefix else marked

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        parts = (ids[at:at + SOLVED] for at in range(0, len(ids), SOLVED))
        text = b"".join([b"".join(map(self.bytes.__getitem__, p.tolist() if isinstance(p, np.ndarray) else p)) for p in parts]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, float, list[dict]]]:
        """(ids, score, alternatives) of each text."""
        if self.kept > KEPT:
            self.forget()
        known = len(self.number)
        number = self.number
        rows = [np.array(list(map(number.__getitem__, self.cut(self.prepared(t)))), np.int64) for t in texts]
        if len(number) > known:
            self._solve(list(islice(number, known, None)))
        begins = np.cumsum(self.sizes) - self.sizes
        # The stretches of each text that may differ within the best n.
        loose: list[list[int]] = []
        for row in rows:
            loss = self.seconds[row]
            take = min(self.nbest - 1, len(row))
            near = np.argpartition(loss, take - 1)[:take] if take else np.empty(0, np.int64)
            loose.append(sorted(i for i in near.tolist() if np.isfinite(loss[i])))
        wanted = sorted({int(row[i]) for row, some in zip(rows, loose, strict=True) for i in some})
        taken = set(wanted)
        lattice = Lattice.of([name for name, at in number.items() if at in taken], self.model) if wanted else None
        into, local = lattice.into() if lattice else {}, {w: i for i, w in enumerate(wanted)}
        for row, some in zip(rows, loose, strict=True):
            n = self.sizes[row]
            places = np.cumsum(n) - n
            ids = self.flat[np.arange(int(n.sum())) - np.repeat(places - begins[row], n)]
            score = float(self.scores[row].sum())
            yield ids, score, self._alternatives(lattice, into, [local[int(row[i])] for i in some], places[some].tolist(), score) if some else []

    def _solve(self, new: list[str]) -> None:
        """Adds the best ways through new stretches, a bounded number of characters at a time; a longer stretch is a lattice of its own."""
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        self.kept += int(ends[-1])
        made = [(self.flat, self.sizes, self.scores, self.seconds)]
        at = 0
        while at < len(new):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SOLVED, "right")))
            solved = Lattice.of(new[at:end], self.model)
            made.append((*solved.best_ids(self.model), solved.forward[solved.last], solved.second))
            at = end
        self.flat, self.sizes, self.scores, self.seconds = map(np.concatenate, zip(*made, strict=True))

    def _alternatives(self, lattice: Lattice, into: dict, chain: list[int], places: list[int], score: float) -> list[dict]:
        best = [lattice.best(s) for s in chain]
        top = sum(float(lattice.forward[lattice.last[s]]) for s in chain)
        found = [(s, ways) for s, ways in n_best(lattice, into, chain, self.nbest) if ways != best][: self.nbest - 1]
        return [{"score": score - top + s, "edits": [{"at": at, "n": len(lattice.ids(b, self.model, c)), "ids": lattice.ids(w, self.model, c)} for at, b, w, c in zip(places, best, ways, chain, strict=True) if b != w]}
                for s, ways in found]


def applied(ids: list[int], edits: list[dict]) -> list[int]:
    """The ids of an alternative: the best ones with its edits."""
    out, at = [], 0
    for e in sorted(edits, key=lambda e: e["at"]):
        out += [*ids[at:e["at"]], *e["ids"]]
        at = e["at"] + e["n"]
    return out + list(ids[at:])


def encode(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None, nbest: int = NBEST) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_pieces``, ``ids``, ``score``, ``alternatives`` and ``round_trip`` of every row.

    ``alternatives`` are the next best segmentations, best first, as edits of ``ids`` (see ``applied``): up to ``nbest`` - 1,
    fewer where there are no more. Of segmentations with equal scores any may come first. ``round_trip`` says that
    decoding ``ids`` gave back the text. An empty text has no piece; a NULL text has NULL ids, no piece and no round trip
    to make (NULL). Words are cut once per chunk of texts, so copies cost little; a text of any length is one row. Where a
    kept column has the name of a new one, the new one gets underscores before its name.
    """
    keep = docs.columns if keep is None else keep
    names = [f"_{i}" for i in range(len(keep))]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary, whatever the corpus
    edit = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.float64(), pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))])), pa.bool_()]

    def chunks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
        begin, some, size = 0, [], 0
        for at, x in enumerate(column):
            some.append(x.as_py())
            size += len(some[-1] or "")
            if size >= CHUNK:
                yield begin, some
                begin, some, size = at + 1, [], 0
        if some:
            yield begin, some

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, nbest)
        for part in parts:
            for begin, texts in chunks(part.column(0)):
                flat, offsets, scores, others, trips = [], [0], [], [], []
                for text, (ids, score, more) in zip(texts, encoder.encode([t or "" for t in texts]), strict=True):
                    flat.append(ids)
                    offsets.append(offsets[-1] + len(ids) if text is not None else offsets[-1])
                    scores.append(score)
                    others.append(more)
                    trips.append(None if text is None else encoder.decode(ids) == text)
                missing = np.array([t is None for t in texts] + [False])
                lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32), mask=missing), pa.array(np.concatenate(flat)) if flat else pa.array([], pa.int32()))
                made = [pa.array(np.diff(offsets), pa.int64()), lists, pa.array(scores, pa.float64()), pa.array(others, kinds[3]), pa.array(trips, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*[c.slice(begin, len(texts)) for c in part.columns[1:]], *made], names=[*names, "n_pieces", "ids", "score", "alternatives", "round_trip"])

    narrow = docs.select(F.col(text_column).cast("string").alias("_text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    plain = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(keep, names, strict=True))
    out = narrow.mapInArrow(batches, plain + ENCODED)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *[F.col(n).alias(free_name(n, keep)) for n in ("n_pieces", "ids", "score", "alternatives", "round_trip")])


def decode(encoded: DataFrame, model: Model, ids_column: str = "ids", name: str = "text") -> DataFrame:
    """``encoded`` with a column of the texts of its ids; NULL ids give a NULL text, ids outside the vocabulary or NULL are left out."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def texts(column):  # noqa: ANN001, ANN202
        encoder = Encoder(sent.value)
        known = range(len(encoder.bytes))
        return column.map(lambda ids: None if ids is None else encoder.decode([int(i) for i in ids if i is not None and i in known]))

    return encoded.withColumn(name, texts(F.col(ids_column)))

"""SentencePiece encoding and decoding by a streaming Viterbi search.

The pieces come from a model file; the segmentation is the one with the greatest sum of scores, ties
going to the path whose last piece is longer, as the reference library's unigram search has them. A
unigram model's scores are its log probabilities. A BPE model has merge ranks, which don't add up;
its pieces are scored by Zipf's law, log(1 / (rank * H)) with H the sum of 1 / rank, in steps of
1/256 so that sums are exact. Ids then differ from its merge order, and decode alike.

A position's outcome only depends on the positions up to the longest piece before it, so the search
keeps scores for that window, and backpointers from the last boundary on which all surviving paths
agree; ids up to there are committed at once. No piece holds a space mark after another character or
a line end, so all paths meet at word starts and line ends, and the search there is as at its start:
what it gave for a word of at most 64 characters is remembered in a bounded table.

Characters without a piece become byte pieces. The space mark itself (U+2581) in a text is written
in byte pieces too, so that decode(encode(text)) == text for every text.

Defined cases: null gives null ids and decodes to null; an empty text has no ids; a very long text, or
word, is searched in the same window; repeated rows are encoded each on their own; empty table,
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, keyed, ship

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose ids are remembered, at most.
REMEMBERED = 400_000
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def zipf_scores(scores: list[float]) -> list[float]:
    """Log probabilities of pieces that are known by rank alone (best score first, then first in the
    model), in steps of 1/256."""
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    total = math.log(sum(1 / r for r in range(1, len(order) + 1))) if order else 0.0
    out = [0.0] * len(order)
    for rank, i in enumerate(order, 1):
        out[i] = -round(256 * (math.log(rank) + total)) / 256
    return out


@dataclass(frozen=True, eq=False)
class Pieces:
    """What of a model the search needs; small (about 1 MB), sent to the tasks as it is."""

    text: tuple[str, ...]
    score: tuple[float, ...]
    kind: tuple[int, ...]
    dummy_prefix: bool

    @staticmethod
    def load(path: str) -> Pieces:
        """Read a model file on the driver. Models that rewrite texts before encoding, or hold
        user-defined pieces, can't be decoded to the same text and are refused."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("only models with identity normalisation and without user-defined pieces")
        scores = [p.score for p in model.pieces]
        if model.trainer_spec.model_type == BPE:
            normal = [i for i, p in enumerate(model.pieces) if p.type == NORMAL]
            for i, score in zip(normal, zipf_scores([scores[i] for i in normal]), strict=True):
                scores[i] = score
        return Pieces(
            tuple(p.piece for p in model.pieces),
            tuple(scores),
            tuple(p.type for p in model.pieces),
            norm.add_dummy_prefix,
        )


class Tables:
    """Lookup structures made from Pieces once a process."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        #: By character: the pieces that go on with it, and the id (-1: none) and score of what it ends.
        self.trie: dict[str, list] = {}
        self.longest = 1
        self.byte: dict[int, int] = {}
        self.unknown = pieces.kind.index(UNKNOWN)
        scores = []
        for i, (text, score, kind) in enumerate(zip(pieces.text, pieces.score, pieces.kind, strict=True)):
            if kind == BYTE:
                self.byte[int(text[3:5], 16)] = i
            elif kind == NORMAL:
                node, last = self.trie, None
                for ch in text:
                    last = node.setdefault(ch, [{}, -1, 0.0])
                    node = last[0]
                last[1:] = i, score
                self.longest = max(self.longest, len(text))
                scores.append(score)
        self.unknown_score = min(scores) - UNKNOWN_PENALTY
        self.single = {ch for ch, step in self.trie.items() if step[1] >= 0}
        bad = [t for t, k in zip(pieces.text, pieces.kind, strict=True) if k == NORMAL and (SPACE in t.lstrip(SPACE) or "\n" in t)]
        #: Where all paths meet: spaces before a word, and around line ends.
        self.split = re.compile(f"{SPACE}| *[^ \n{SPACE}]+| +|\n") if not bad else re.compile(f"{SPACE}|[^{SPACE}]+")
        self.bytes_of = [
            bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else t.replace(SPACE, " ").encode()
            for t, k in zip(pieces.text, pieces.kind, strict=True)
        ]
        self.known = _Known(self)

    def bytes_ids(self, ch: str) -> list[int]:
        """Byte pieces of a character; the unknown id where the model has none."""
        return [self.byte.get(b, self.unknown) for b in ch.encode()]


class _Known(dict):
    """What the search gave for the words between two boundaries, within REMEMBERED words."""

    def __init__(self, tables: Tables) -> None:
        super().__init__()
        self.tables = tables
        self.search = Viterbi(tables)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if word == SPACE:
            ids = tuple(self.tables.bytes_ids(SPACE))
        else:
            ids = (*self.search.feed(word.replace(" ", SPACE)), *self.search.end())
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


_NONE = float("-inf")


class Viterbi:
    """feed() characters (spaces already marked), then end(); both give ids that are certain. After
    end() it is as new."""

    def __init__(self, tables: Tables) -> None:
        self.t = tables
        self.text = ""  # characters from the last committed boundary on
        self.at = 0  # start position that is searched next, counted from there
        # Of the best path to each position: its score, and the start and id of its last piece.
        self.best: list[float] = [0.0]
        self.start: list[int] = [0]
        self.piece: list[int] = [0]
        self.check = tables.longest

    def feed(self, more: str) -> list[int]:
        self.text += more
        self.best += [_NONE] * len(more)
        self.start += [0] * len(more)
        self.piece += [0] * len(more)
        return self._search(len(self.text) - self.t.longest) if len(self.text) >= self.t.longest else []

    def end(self) -> list[int]:
        out = self._search(len(self.text) - 1)
        return out + self._commit(len(self.text))

    def _search(self, last: int) -> list[int]:
        """Extend the paths from all positions up to last."""
        out: list[int] = []
        longest, trie, single = self.t.longest, self.t.trie, self.t.single
        unknown, unknown_score = self.t.unknown, self.t.unknown_score
        while self.at <= last:
            text, best, start, piece = self.text, self.best, self.start, self.piece
            until = min(last + 1, max(self.check, self.at + 1))
            for at in range(self.at, until):
                here = best[at]
                if here == _NONE:
                    continue
                node, end = trie, at
                for ch in text[at : at + longest]:
                    step = node.get(ch)
                    if step is None:
                        break
                    node, i, score = step
                    end += 1
                    if i >= 0:
                        score += here
                        if score > best[end]:
                            best[end], start[end], piece[end] = score, at, i
                if text[at] not in single:
                    score = here + unknown_score
                    if score > best[at + 1]:
                        best[at + 1], start[at + 1], piece[at + 1] = score, at, unknown
            self.at = until
            if until >= self.check:
                meet = self._meeting()
                if meet:
                    out += self._commit(meet)
                    last -= meet
                self.check = self.at + max(longest, self.at)
        return out

    def _meeting(self) -> int:
        """The last boundary that the paths to all reached positions from `at` on share."""
        ends = {e for e in range(self.at, min(len(self.best), self.at + self.t.longest)) if self.best[e] != _NONE}
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(self.start[top])
        return ends.pop()

    def _commit(self, end: int) -> list[int]:
        """Ids of the path to a boundary; the search goes on as if it were the start."""
        path, at = [], end
        while at:
            i, before = self.piece[at], self.start[at]
            path.append(self.t.bytes_ids(self.text[before]) if i == self.t.unknown else (i,))
            at = before
        base = self.best[end]
        self.text, self.at = self.text[end:], max(0, self.at - end)
        self.best = [b - base for b in self.best[end:]]
        self.start = [x - end for x in self.start[end:]]
        self.piece = self.piece[end:]
        self.check = self.t.longest
        return list(chain.from_iterable(reversed(path)))


def encode(tables: Tables, text: str) -> list[int]:
    if not text:
        return []
    words = tables.split.findall(f" {text}" if tables.pieces.dummy_prefix else text)
    return list(chain.from_iterable(map(tables.known.__getitem__, words)))


def encode_stream(tables: Tables, chunks: Iterable[str]) -> Iterator[int]:
    """Ids of a text that comes in chunks, without holding the text."""
    search, begun = Viterbi(tables), False
    for chunk in chunks:
        if chunk and not begun:
            begun, chunk = True, f" {chunk}" if tables.pieces.dummy_prefix else chunk
        for k, part in enumerate(chunk.split(SPACE)):
            if k:  # a mark of the text's own
                yield from search.end()
                yield from tables.bytes_ids(SPACE)
                search = Viterbi(tables)
            yield from search.feed(part.replace(" ", SPACE))
    yield from search.end()


def decode(tables: Tables, ids: Iterable[int]) -> str:
    text = b"".join(map(tables.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if tables.pieces.dummy_prefix and text.startswith(" ") else text


def _shared(spark, pieces: Pieces):
    """The pieces as a broadcast variable (a model file's size, about 1 MB); a worker process makes
    its tables once."""
    return spark.sparkContext.broadcast(pieces)


_MADE: dict[tuple, Tables] = {}


def tables_for(pieces: Pieces) -> Tables:
    key = (len(pieces.text), hash(pieces.text), hash(pieces.score))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tables(pieces)
    return _MADE[key]


def encode_documents(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids array<int>, round_trip (the ids decode to the text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = keyed(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType
    shared = _shared(docs.sparkSession, pieces)
    ship(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", to_arrow_type(kind)), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            tables = tables or tables_for(shared.value)
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found, counts, good = [], [], []
                for text in part.column(1).to_pylist():
                    ids = np.array(encode(tables, text or ""), np.int32)
                    found.append(ids)
                    counts.append(len(ids))
                    good.append(decode(tables, ids.tolist()) == (text or ""))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate(found)), mask=part.column(1).is_null()
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), lists, pa.array(good, pa.bool_())], schema=schema
                )

    return src.mapInArrow(run, f"doc_id {kind.simpleString()}, n_ids bigint, ids array<int>, round_trip boolean")


def decode_documents(rows: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that the ids spell."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = keyed(rows, doc_id=id_col, ids=ids_col)
    kind = src.schema["doc_id"].dataType
    shared = _shared(rows.sparkSession, pieces)

    def run(doc_ids: list, lists: list):
        tables = tables_for(shared.value)
        for i, ids in zip(doc_ids, lists, strict=True):
            yield i, None if ids is None else decode(tables, ids)

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("text", pa.string())])
    return arrow_rows(src, run, schema, f"doc_id {kind.simpleString()}, text string")

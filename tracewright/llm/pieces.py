"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi.

The best segmentation is the one with the highest sum of the pieces' scores in the
model file. The scan keeps scores for the starts that a piece can still join, a
window of the longest piece at most, and gives out ids as soon as the backpointers
of all of them meet in one boundary. Characters without a piece become their UTF-8
byte pieces, so decoding restores every text exactly.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Chunks up to this length are remembered, this many of them in a worker.
_SHORT, _REMEMBERED = 32, 1 << 18
_ROWS = 256
_UNKNOWN_COST = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model file, id by id, with scores; ``byte_ids`` maps a byte to its piece."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    special: frozenset[int]

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Read once by the driver. The vocabulary, of fixed size, travels with the function to the executors."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = tuple(model.id_to_piece(i) for i in ids)
        if not all(f"<0x{b:02X}>" in set(pieces) for b in range(256)):
            raise ValueError("the vocabulary has no byte pieces")
        number = {p: i for i, p in enumerate(pieces)}
        special = frozenset(i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        return Vocabulary(
            pieces, tuple(model.get_score(i) for i in ids), tuple(number[f"<0x{b:02X}>"] for b in range(256)), special
        )


class _Memo(dict):
    """Ids, as int32 bytes, of chunks; short ones are remembered, a bounded number of them."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        found = array("i", self.encode(chunk)).tobytes()
        if len(chunk) <= _SHORT:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[chunk] = found
        return found


class Coder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        # A node of the trie: (following characters, id or None, score).
        self.root: dict = {}
        self.byte_ids = vocabulary.byte_ids
        self.unknown = min(vocabulary.scores) - _UNKNOWN_COST
        plain = [i for i in range(len(vocabulary.pieces)) if i not in vocabulary.special]
        self.longest = max((len(vocabulary.pieces[i]) for i in plain), default=1)
        for i in plain:
            *head, last = vocabulary.pieces[i]
            children = self.root
            for c in head:
                children = children.setdefault(c, ({}, None, 0.0))[0]
            children[last] = (children.get(last, ({},))[0], i, vocabulary.scores[i])
        self.bytes_of = [b""] * len(vocabulary.pieces)
        for i in plain:
            self.bytes_of[i] = vocabulary.pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(vocabulary.byte_ids):
            self.bytes_of[i] = bytes([b])
        # Where no piece goes on from a letter to a space, every path has a boundary before the space,
        # and on both sides of a character that no longer piece holds.
        longer = [vocabulary.pieces[i] for i in plain if len(vocabulary.pieces[i]) > 1]
        inside = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in longer)
        joined = "".join(map(re.escape, sorted(set("".join(longer)) - {SPACE}))) or SPACE
        self.chunks = re.compile(".+" if inside else f"{SPACE}*[{joined}]+|{SPACE}+|[^{SPACE}{joined}]", re.S)
        self.memo = _Memo(self.stream)
        self.surfaces = pa.array(self.bytes_of, pa.large_binary())

    def stream(self, text: str) -> Iterator[int]:
        """Ids of the best segmentation of ``text``. Of equal ones the one whose last piece is longest wins."""
        best: dict[int, float] = {0: 0.0}
        back: dict[int, tuple[int, int]] = {}
        root, longest, unknown = self.root, self.longest, self.unknown
        done = reach = 0  # the boundary up to which ids are out; the furthest end that a path has
        for at in range(len(text)):
            score, children, end, plain = best.pop(at), root, at, False
            for c in text[at : at + longest]:
                if c not in children:
                    break
                children, piece, value = children[c]
                end += 1
                if piece is not None:
                    found = score + value
                    if end > reach:
                        reach = end
                        best[end], back[end] = found, (at, piece)
                    elif end not in best or found > best[end]:
                        best[end], back[end] = found, (at, piece)
                    plain = plain or end == at + 1
            if not plain and score + unknown > best.get(at + 1, -inf):
                best[at + 1], back[at + 1] = score + unknown, (at, -ord(text[at]) - 1)
                reach = max(reach, at + 1)
            # Every path of the future goes through an end in at + 1 .. reach.
            if reach == at + 1:
                meet = reach
            elif at - done >= longest:
                meet = self._meeting(best, back, done)
            else:
                continue
            if meet > done:
                yield from self._given(meet, back, done)
                done = meet

    @staticmethod
    def _meeting(best: dict, back: dict, done: int) -> int:
        """The last boundary that the paths to all surviving ends share."""
        ends = set(best)
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(max(back[last][0], done))
        return ends.pop()

    def _given(self, to: int, back: dict, done: int) -> list[int]:
        """Ids from ``done`` up to the boundary ``to``; backpointers up to it are let go."""
        out: list[int] = []
        at = to
        while at > done:
            at, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in reversed(chr(-piece - 1).encode())]
        for old in range(done + 1, to + 1):
            back.pop(old, None)
        out.reverse()
        return out

    def encode(self, text: str | None) -> np.ndarray | None:
        """int32 ids; null for null, none for an empty text. A literal U+2581 is no space, it becomes bytes."""
        if text is None:
            return None
        if not text:
            return np.zeros(0, np.int32)
        literal = array("i", [self.byte_ids[b] for b in SPACE.encode()]).tobytes()
        out: list[bytes] = []
        for part_no, part in enumerate((" " + text).split(SPACE)):
            out += [literal] * bool(part_no)
            out += map(self.memo.__getitem__, self.chunks.findall(part.replace(" ", SPACE)))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str | None:
        """The text of ``ids``, without the space that encoding puts in front."""
        return None if ids is None else self.decode_all([np.asarray(ids, np.int32)])[0]

    def decode_all(self, lists: list[np.ndarray | None]) -> list[str | None]:
        """The texts of many id lists: one gather of all pieces, cut where a list ends."""
        ends = np.cumsum([0] + [0 if x is None else len(x) for x in lists])
        ids = np.concatenate([x for x in lists if x is not None] or [np.zeros(0, np.int32)])
        joined = self.surfaces.take(pa.array(ids, pa.int32()))
        _, starts, data = joined.buffers()
        cuts = np.frombuffer(starts, np.int64)[: len(ids) + 1][ends] if len(ids) else ends
        data = memoryview(data or b"")
        return [
            None if x is None else str(data[a:b], errors="replace").removeprefix(" ")
            for x, a, b in zip(lists, cuts[:-1].tolist(), cuts[1:].tolist())
        ]


_coders: dict[int, Coder] = {}


def _coder(vocabulary: Vocabulary) -> Coder:
    """One coder in a worker, whatever the number of batches and tasks."""
    key = hash(vocabulary)
    if key not in _coders:
        _coders[key] = Coder(vocabulary)
    return _coders[key]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that only their texts and ids are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _id_lists(found: list[np.ndarray | None]) -> pa.ListArray:
    sizes = [0 if x is None else len(x) for x in found]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    values = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)])
    offsets = pa.array(ends, pa.int32(), mask=np.array([x is None for x in found] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))


def round_trips(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids``, ``n_ids`` and ``restored``, whether decoding gave the text back, for every row's whole text.

    All three are null for a null text; an empty text has no ids. Repeated rows repeat.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # the size of the file

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary.value)
        for part in _sliced(batches):
            texts = part.column("text").to_pylist()
            ids = [coder.encode(t) for t in texts]
            same = [None if t is None else back == t for t, back in zip(texts, coder.decode_all(ids))]
            count = pa.array([None if i is None else len(i) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), _id_lists(ids), count, pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "restored"]
            )

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(code, f"doc_id {dict(given.dtypes)['doc_id']}, ids array<int>, n_ids bigint, restored boolean")


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``round_trips`` without the proof."""
    return round_trips(docs, path).drop("restored")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``rows`` with their ``ids`` turned back into ``decoded_text``."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        coder = _coder(vocabulary.value)
        return pd.Series(coder.decode_all(list(ids)), dtype=object)

    return rows.withColumn("decoded_text", decode("ids"))

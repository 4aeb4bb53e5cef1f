"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

One pass over a text follows the automaton of all pieces; at each position the output links name every piece that
ends there, and each relaxes the best score of that position from the position where the piece starts. Pieces of a
unigram model score their log probability. In a BPE model a piece may follow another only if merging their joint
text gives back just these two; at every position one arc is left, and its chain is the merge order's own result, so
the ids equal those of the model. Characters that no piece covers fall back to their bytes.

Every text is cut where no piece can reach across: before a space mark that follows something else. The parts recur,
so their ids are kept in a bounded table and the automaton runs once per distinct part. Decoding is an array gather
over the pieces' bytes. A literal U+2581 in a text, which the model can't tell from a space, is encoded as its bytes,
so that every text comes back unchanged; models that change texts before encoding are refused."""

from __future__ import annotations

import re
import struct
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import held, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct parts whose ids a worker keeps.
KEPT = 200_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    bpe: bool
    prefix: bool


def load(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, bpe, prefix = [], [], [], False, True
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        elif field == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif field == 3:
            own = dict(_fields(value))
            prefix = bool(own.get(3, 1))
            if own.get(2) or own.get(4, 1) or not own.get(5, 1):
                raise ValueError("this model normalises texts, so they can't be restored")
    return Model(tuple(pieces), tuple(scores), tuple(kinds), bpe, prefix)


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("this model has no byte fallback, so texts can't be restored")
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.out, self.piece, self.depth = [0], [0], [-1], [0]
        for piece, i in self.ids.items():
            self._insert(piece, i)
        self._link()
        self.score = [self.model.scores[i] for i in range(len(model.pieces))]
        self.joins: dict[tuple[int, int], bool] = {}
        self.moves: list[dict[str, int]] = [{} for _ in self.next]
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {}
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.split = None if crossing else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.mark_bytes = np.array([self.bytes[x] for x in MARK.encode()], np.int32).tobytes()
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_size)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _insert(self, piece: str, i: int) -> None:
        state = 0
        for c in piece:
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
                self.fail.append(0)
                self.out.append(0)
                self.piece.append(-1)
                self.depth.append(self.depth[state] + 1)
            state = self.next[state][c]
        self.piece[state] = i

    def _link(self) -> None:
        """Failure links by breadth; out: the nearest state on the failure path at which a piece ends."""
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for c, child in self.next[state].items():
                back = self.fail[state]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                target = self.next[back].get(c, 0)
                self.fail[child] = target
                self.out[child] = target if self.piece[target] >= 0 else self.out[target]
                queue.append(child)

    def _merged(self, text: str) -> list[str]:
        """The merge order's result on a short text: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                own = self.ids.get(parts[i] + parts[i + 1])
                if own is not None and (best is None or self.score[own] > best):
                    best, at = self.score[own], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _joins(self, left: int, right: int) -> bool:
        """Whether the BPE order leaves these two pieces apart when they meet; left -1: a piece at the start or after a byte."""
        if len(self.joins) > 4 * KEPT:
            self.joins.clear()
        a, b = "" if left < 0 else self.model.pieces[left], self.model.pieces[right]
        known = self.joins[left, right] = self._merged(a + b) == ([a, b] if a else [b])
        return known

    def _step(self, state: int, c: str) -> int:
        """The automaton's move, kept once it has been found by failure links."""
        at = state
        while at and c not in self.next[at]:
            at = self.fail[at]
        to = self.moves[state][c] = self.next[at].get(c, 0)
        return to

    def _outputs(self, state: int) -> tuple[tuple[int, int], ...]:
        """(piece, length) of all pieces that end at a state, along its output links, longest first."""
        found, at = [], state if self.piece[state] >= 0 else self.out[state]
        while at:
            found.append((self.piece[at], self.depth[at]))
            at = self.out[at]
        self.ends[state] = tuple(found)
        return self.ends[state]

    def part(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks: single-pass Viterbi over the automaton."""
        state, moves, ends, joins, bpe, score = 0, self.moves, self.ends, self.joins, self.model.bpe, self.score
        best, back = [0.0], [(0, -1)]
        for i, c in enumerate(text, 1):
            to = moves[state].get(c)
            state = to if to is not None else self._step(state, c)
            outputs = ends.get(state)
            if outputs is None:
                outputs = self._outputs(state)
            top, arc = -1e30, None
            if bpe:
                for piece, size in outputs:
                    left = back[i - size][1]
                    legal = joins.get((left, piece))
                    if legal is None:
                        legal = self._joins(left, piece)
                    if legal:
                        top, arc = 0.0, (i - size, piece)
                        break
            else:
                for piece, size in outputs:
                    own = best[i - size] + score[piece]
                    if own > top:
                        top, arc = own, (i - size, piece)
            if arc is None:  # the character's bytes
                top, arc = best[i - 1] - 1e3, (i - 1, -1)
            best.append(top)
            back.append(arc)
        ids: list[int] = []
        i = len(text)
        while i:
            start, piece = back[i]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.bytes[x] for x in reversed(text[start:i].encode())]
            i = start
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        kept, out = self.kept, []
        for i, run in enumerate(text.split(MARK)):
            if i:  # a literal mark; no piece reaches across it
                out.append(self.mark_bytes)
            marked = (MARK if self.model.prefix and not i else "") + run.replace(" ", MARK)
            for p in self._parts(marked):
                ids = kept.get(p)
                if ids is None:
                    ids = self.older.get(p)
                    if ids is None:
                        ids = array("i", self.part(p)).tobytes()
                    if len(kept) >= KEPT:  # what hasn't come up since the last turn is forgotten
                        self.older, self.kept = kept, {}
                        kept = self.kept
                    if len(p) <= 256:
                        kept[p] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def _parts(self, marked: str) -> list[str]:
        return self.split.findall(marked) if self.split else [marked] * bool(marked)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return ""
        data = self.raw[np.repeat(self.raw_start[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()
        text = data.decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def _run(shared, columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared.id if hasattr(shared, "id") else id(shared)
        encoder = held(("encoder", key), lambda: Encoder(shared.value))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = [encoder.encode(t or "") for t in texts]
                same = [encoder.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(same, pa.bool_())], schema=schema)

    return run


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_ids, round_trip), a row for every input row; round_trip: decoding gave the text back.

    Null and empty texts have no ids. Ids may be null or repeat. Texts of any length are encoded whole, in one pass;
    an empty table gives no rows; other columns are not read. The model's pieces
    are broadcast: their number is the vocabulary's, whatever the input."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("round_trip", pa.bool_())])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_run(shared, ["doc_id"], schema), "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")

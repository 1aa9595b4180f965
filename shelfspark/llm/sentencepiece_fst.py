"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model compiles to three parts. The normaliser writes spaces as U+2581 and puts one in
front. The piece transducer reads characters and writes pieces, one arc a piece; a character
that no piece has is read by a path of its byte pieces. For the merge-based model a third
part accepts a sequence of pieces if each two neighbours are what merging their joined text
gives: a sequence of pieces is the model's own exactly if all its neighbours are. All arcs
weigh one and what is not accepted weighs infinity, the zero of the tropical semiring; the
states of the composition with an input are its positions together with the last piece, and
the shortest path through them is the encoding. A beginning of a word has one encoding, so at
most one last piece leads to each position: one weight a position is the whole front.

No piece has a space mark after another character, so the composition falls apart where a
word begins; each distinct word's path is found once and kept.

Defined results: a null text counts as empty and has no pieces; control pieces' names inside
texts are ordinary text; very long texts are encoded whole; of pairs of equal score the leftmost
merges first; repeated rows, null or equal ids are encoded each; an empty table gives no rows;
other columns, whatever their names, are ignored. Decoding gives back the text, except
that U+2581 comes back as a space.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import arrow_map, slices, texts

SPACE = "▁"
#: Bytes of words with their ids (and some 150 a word) and pairs of pieces that a worker keeps; it forgets them all beyond that.
KNOWN_BYTES, A_WORD, KNOWN_PAIRS = 100_000_000, 150, 1_000_000
WORD = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value, shift = value | (byte & 127) << shift, shift + 7
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


class Transducer:
    """Normaliser, pieces and byte fallback of a model file."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = dict(x for x in _fields(model.serialized_model_proto()) if x[0] in (2, 3))
        trainer, normalizer = dict(_fields(proto[2])), dict(_fields(proto[3]))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only merge-based models that keep spaces and characters as they are compile here")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        if len(self.byte_id) != 256 or any(SPACE in x.lstrip(SPACE) for x in self.ids):
            raise ValueError("the model needs byte pieces, and no piece may have a space mark inside")
        self.piece = {i: x for x, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.size = 0
        #: The arcs of the piece transducer as a tree of characters; a node's piece is under the empty key. Pieces that merging cannot make have no arc.
        self.arcs: dict = {}
        for x, i in self.ids.items():
            if self.merged(x) == [x]:
                node = self.arcs
                for c in x:
                    node = node.setdefault(c, {})
                node[""] = i

    def merged(self, text: str) -> list[str]:
        """What merging the best neighbours again and again leaves; of equal scores the leftmost goes first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether the acceptor has an arc for this neighbourhood of pieces."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.piece[left], self.piece[right]
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def shortest(self, word: str) -> list[int]:
        """The ids on the shortest path of the composition with ``word``; characters without a piece are byte pieces."""
        n, pairs, arcs, ids = len(word), self.pairs, self.arcs, self.ids
        far = n + 1
        weight, last, before = [far] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0
        for i in range(n):
            here = weight[i] + 1
            if here > far:
                continue
            left, node, at = last[i], arcs, i
            while at < n:
                node = node.get(word[at])
                if node is None:
                    break
                at += 1
                piece = node.get("")
                if piece is not None and here < weight[at]:
                    if left >= 0:
                        joined = pairs.get(left << 20 | piece)
                        if joined is None:
                            joined = self.follows(left, piece)
                        if not joined:
                            continue
                    weight[at], last[at], before[at] = here, piece, i
            if word[i] not in ids and here < weight[i + 1]:
                weight[i + 1], last[i + 1], before[i + 1] = here, -1, i
        if weight[n] > n:
            raise ValueError("no path reads the whole word")
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.byte_id[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
            at = before[at]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        return array("I", self.shortest(word)).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if self.size > KNOWN_BYTES:
            self.known.clear()
            self.size = 0
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        words, known = WORD.findall(self.prefix + text.replace(" ", SPACE)), self.known
        for w in set(words).difference(known):
            ids = known[w] = self._word(w)
            self.size += len(w) + len(ids) + A_WORD
        return b"".join(map(known.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space that the normaliser put in front."""
        text = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ") if self.prefix else text


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


ENCODED = "doc_id bigint, ids array<int>, decoded string, n_pieces bigint, ids_crc32 bigint, round_trip boolean"


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its ids, the text decoded from them, and whether that is the text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = texts(batch)
        for start, end in slices([len(x) for x in found], 2_000_000):
            part, fst = found[start:end], transducer(path)
            ids = [fst.encode(x) for x in part]
            back = [fst.decode(x) for x in ids]
            sizes = np.array([len(x) // 4 for x in ids])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            same = [a.replace(SPACE, " ") == b for a, b in zip(part, back, strict=True)]
            columns = [batch.column("doc_id").slice(start, end - start), lists, pa.array(back, pa.string()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ENCODED.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, ENCODED)

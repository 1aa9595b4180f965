"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

A bin is filled by a subset-sum search over the lengths at hand: a bitset says which totals
they can reach, the fullest total is traced back to a combination of lengths, and the
combination is removed. Bins alike are made together: a combination is taken as often as the
counts of its lengths allow. The search needs only how many pieces have each length, which
is a table of at most ``capacity`` rows at any size of corpus; pieces find their places by
their rank within their length, in parallel.

Defined results: a null text counts as empty and gives one piece, the end token; documents
over the capacity are cut, all others stay whole; very long texts are encoded whole; of
combinations of one total the search's first is taken; repeated rows, null or equal ids are
packed each; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import compress, filterfalse, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .support import arrow_map, slices, texts, write_table

#: Fixed value: the pre-token pattern of the word-end BPE vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Composed, caseless-safe characters: for texts of these alone, lower case and white space here are the library's.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]*")
#: Bytes of words and their ids that a worker keeps, with some 200 a word; beyond that it forgets those that have not come again.
KNOWN_BYTES, A_WORD = 100_000_000, 200
CAPACITY = 2048
END = 0

#: All characters that ``PLAIN`` has, and the pattern for words of these, which also gives the spaces between words.
PLAIN_CHARACTERS = [c for c in map(chr, range(0x180)) if PLAIN.fullmatch(c)]
PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{0}{1}\x20]+|\x20".format(*("".join(c for c in PLAIN_CHARACTERS if regex.match(x, c)) for x in (r"\p{L}", r"\p{N}"))))


#: What ``PLAIN`` has of Latin-1.
_PLAIN_BYTES = bytes(c for c in range(256) if PLAIN.fullmatch(chr(c)))


def _is_plain(text: str) -> bool:
    """Whether ``PLAIN`` is all of the text; Latin-1 is told without the pattern."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES)
    except UnicodeEncodeError:
        return PLAIN.fullmatch(text) is not None


class Encoder:
    """Ids of whole texts: a slice's words are numbered, distinct ones come from memory or, if new, from the library, and numbers become ids again."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        names = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, names)) or "(?!)")
        vocabulary = self.library.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.ends = ends
        # The same model on pre-tokens between spaces: no pattern, no normaliser, bytes as its characters already.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): in_bytes.pre_tokenize_str(c)[0][0] for c in PLAIN_CHARACTERS if not c.isascii()}
        self.known: dict[str, bytes] = {}
        #: Words that have come in several slices.
        self.again: set[str] = set()
        self.size = 0

    def _keep(self, words: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids, strict=True))
        self.size += sum(map(len, words)) + sum(map(len, ids)) + A_WORD * len(words)

    def _learn(self, words: list[str]) -> None:
        """White-space separated words of plain texts, each cut into pre-tokens; every pre-token's ids end with a word-end piece."""
        # Letters alone are one pre-token, as the pattern has it.
        cut = [w for w in words if not w.isalpha()]
        tokens = PLAIN_PARTS.findall(" ".join(cut))
        new = set(filterfalse(self.known.__contains__, tokens)).union(filter(str.isalpha, words)) - {" "}
        other = list(filterfalse(str.isascii, new))
        self._encode_parts(list(filter(str.isascii, new)), {})
        self._encode_parts(other, self.letters)
        # A word's ids lie between those of the spaces around it.
        ids = list(map(self.known.get, tokens, repeat(b"")))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        at = ends[np.fromiter(map(" ".__eq__, tokens), bool, len(tokens))].tolist()
        data = b"".join(ids)
        whole = {w: data[i:j] for w, i, j in zip(cut, [0, *at], [*at, len(data)], strict=False) if w not in self.known}
        self._keep(list(whole), list(whole.values()))

    def _encode_parts(self, new: list[str], letters: dict[int, str]) -> None:
        """Pre-tokens, once ``letters`` has turned them into the model's characters."""
        for start in range(0, len(new), 5000):
            part = new[start : start + 5000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part).translate(letters) if letters else " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(part):  # a piece of the model is missing
                self._keep(part, list(self._by_library(part)))
                continue
            data = ids.tobytes()
            self._keep(part, [data[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)])

    def _forget(self) -> None:
        """Only words that have come again stay; none, if these are too many by themselves."""
        kept = {w: self.known[w] for w in self.again if w in self.known}
        self.known, self.size = {}, 0
        self._keep(list(kept), list(kept.values()))
        if self.size > KNOWN_BYTES // 2:
            self.known, self.again, self.size = {}, set(), 0

    def encode(self, rows: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.size > KNOWN_BYTES:
            self._forget()
        plain = [_is_plain(x) and not self.special.search(x) for x in rows]
        # A plain text's white space is ASCII; at its ends there are empty words, which have no ids.
        split = pc.ascii_split_whitespace(pa.array([x.lower() for x, p in zip(rows, plain, strict=True) if p], pa.large_string()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        self.again.update(compress(words, ids))
        new = [i for i, x in enumerate(ids) if x is None]
        for start in range(0, len(new), 20_000):
            self._learn([words[i] for i in new[start : start + 20_000]])
        for i in new:
            ids[i] = self.known[words[i]]
        found = iter(_gathered(ids, coded.indices, split.offsets))
        rest = self._by_library([x for x, p in zip(rows, plain, strict=True) if not p])
        return [next(found) if p else next(rest) for p in plain]

    def _by_library(self, rows: list[str]) -> Iterator[bytes]:
        """Few texts at a time, as the library's results have far more than ids."""
        for start, end in slices([len(x) for x in rows], 1_000_000):
            for e in self.library.encode_batch_fast(rows[start:end], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()


def _gathered(ids: list[bytes], indices: pa.Array, offsets: pa.Array) -> list[bytes]:
    """The ids of texts, whose words are ranges of ``indices``; these are places in ``ids``."""
    if not ids:
        return []
    _, bounds, data = pa.array(ids, pa.large_binary()).take(indices).buffers()
    at = np.frombuffer(bounds, np.int64)[offsets.to_numpy()].tolist()
    whole = memoryview(data or b"")
    return [whole[i:j].tobytes() for i, j in pairwise(at)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text), ids ending with the end token."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, own = texts(batch), batch.column("doc_id")
        step, stop = 4 * capacity, END.to_bytes(4, "little")
        for start, end in slices([len(x) for x in found], 2_000_000):
            whole = [x + stop for x in encoder(path).encode(found[start:end])]
            parts = [x[k : k + step] for x in whole for k in range(0, len(x), step)]
            n = np.array([-(-len(x) // step) for x in whole])
            piece = np.arange(len(parts)) - np.repeat(np.cumsum(n) - n, n)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            docs_of = own.slice(start, end - start).take(pa.array(np.repeat(np.arange(len(n)), n)))
            columns = [docs_of, pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(lengths), pa.array(np.fromiter(map(zlib.crc32, parts), np.int64, len(parts)))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths at hand, the combination whose total is the largest that ``room`` holds.

    Bit t of the set says that total t can be reached. A length's copies are added in
    powers of two; each step's set is kept to trace the best total back.
    """
    reach, steps, whole = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, power = min(counts[length], room // length), 1
        while left > 0:
            n = min(power, left)
            left, power = left - n, 2 * power
            steps.append((length, n, reach))
            reach |= (reach << (n * length)) & whole
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + n
            total -= n * length
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, combination of lengths) until no length is left; each bin holds the longest length left."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest({k: v for k, v in left.items() if v and k <= capacity - longest}, capacity - longest) if longest < capacity else {}
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        plan.append((times, chosen))
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: from which rank on, first bin, copies a bin, and the offset of the first copy."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    for times, chosen in plan:
        offset = 0
        for length, n in chosen.items():
            rows.setdefault(length, []).append((used.get(length, 0), bins, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        bins += times
    return {k: tuple(np.array(x) for x in zip(*v, strict=True)) for k, v in rows.items()}


PACKED = PIECES + ", sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, rows_per_run: int = 5_000) -> DataFrame:
    """The pieces of ``docs`` with their ``sequence_id`` and ``offset``."""
    found = write_table(pieces(docs, path, capacity), "pieces")
    # Ranks within a length: a length is dealt into runs by hash, as it may have a third of all rows.
    runs = max(1, -(-found.count() // rows_per_run))
    dealt = found.withColumn("run", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(runs)))
    sizes = dealt.groupBy("length", "run").agg(F.count("*").alias("n"))
    counts = {int(x["length"]): int(x["n"]) for x in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = _places(plan_bins(counts, capacity))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "run").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("within", within).join(firsts, ["length", "run"]).withColumn("rank", F.col("first") + F.col("within") - 1)
    names = [x.split()[0] for x in PIECES.split(", ")]

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k in np.unique(length).tolist():
            at = np.flatnonzero(length == k)
            first, bins, copies, begin = places[k]
            i = np.searchsorted(first, rank[at], side="right") - 1
            n = rank[at] - first[i]
            sequence[at], offset[at] = bins[i] + n // copies[i], begin[i] + n % copies[i] * k
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return arrow_map(ranked.select(*names, "rank"), place, PACKED)

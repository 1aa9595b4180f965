"""Phrase collocations: contiguous phrases of two to four words and how strongly their parts belong together.

Candidates grow level by level. A phrase of k words can only be frequent if both of its
parts of k-1 words are (Apriori), and if the bucket of a hashed count that it falls into is;
neither test loses a frequent phrase. Candidates of a level get numbers ("slots") from a
minimal perfect hash, and their keys are stored by slot: what is looked up is accepted only
if the stored key is its own, so counts are exact. A key is a pair of slots of the level
below, and a word's key is its 64-bit hash, with a seed under which no frequent word shares
its hash with any other word.

One pass over a level's rows (slots in place of words) writes the next level's rows, counts
slots by bincount, and counts the next level's pairs in buckets; the arrays of tasks are
summed in a tree of ``FAN`` arrays a node. Scores are joined by slot, where each level has its
own counts and those of its parts.

What goes to all tasks is bounded: ``SHARD`` keys a hash and ``ROUND`` hashes at once (more of
them take more passes), and a bit for each of at most ``MOST_BUCKETS`` buckets. It is given
free as soon as the tables made with it are written.

What a task holds does not follow the size of its part of the input: a row is about
``ROW_WORDS`` words, tables of such rows are written in row groups of ``GROUP_BYTES`` and read
``ROWS`` rows at a time, and no stage has two Python operators, each of which would keep a
worker of its own beside each core.

Defined results: a null text is empty, a null lang is ``und``; repeated rows count each. An
empty table gives no rows. Other columns are not read. More than 2^32 - 1 candidates of one
level raise OverflowError.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .support import batches_of, drop_tables, slices, write_table

#: A phrase is a candidate if it occurs so often; its words at most; a longer phrase that covers this share of it (in hundredths) drops it.
LEAST, WORDS, COVERED = 30, 4, 80
#: Phrases of a language.
TOP = 2_000
#: Keys of one hash, and hashes that tasks hold at once.
SHARD, ROUND = 1 << 18, 8
#: Buckets of a hashed count: one for so many words of the corpus, within bounds.
WORDS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 12, 1 << 26
#: Entries of an array that travel in one row, and arrays that are summed at once.
CHUNK, FAN = 1 << 16, 16
#: Bytes of text whose words are hashed at once, words of a row (and one piece more), and entries that a task holds before it gives them on.
SLICE_BYTES, ROW_WORDS, HELD = 1 << 19, 1 << 14, 200_000
#: Documents, and rows, of an Arrow batch.
DOCUMENTS, ROWS = 2_000, 8
#: Bytes of a row group of tables whose rows are arrays; after so many rows, at least and at most, the writer looks at its size and at a page's.
GROUP_BYTES, LEAST_ROWS, MOST_ROWS = 1 << 23, 8, 256
#: Keys that a task holds before it gives them on, and a chunk of keys for so many words a key of a hash.
MOST_KEYS, WORDS_A_CHUNK = 2_000_000, 16
#: Parts over which the first phrases of a language are found before they are ranked together.
PARTS = 64
#: No word, no candidate, or the end of a piece.
NONE = np.uint32(0xFFFFFFFF)
#: Bytes as UTF-8 has them: letters in lower case, one mark for all that ends a piece, blanks between words.
TEXT_BYTES = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"."

DATA, COUNTS, BUCKETS = 0, 1, 2
#: Rows of a level (data: slots or hashes of words), and arrays of one task (chunk, part).
PASSED = "kind int, lang string, word string, n bigint, chunk bigint, part bigint, data binary"


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit numbers as other ones that are spread evenly."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, with the keys by slot.

    Each level has a bit for each place that exactly one of the keys left falls on; the
    others go on to the next level. A key's slot is the number of bits before its own.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, before, self.keys = keys, 0, np.zeros(len(keys), np.uint64)
        while len(left):
            shift = 64 - max(6, int(2 * len(left) - 1).bit_length())
            at = mixed(left, len(self.levels)) >> np.uint64(shift)
            alone = np.bincount(at.astype(np.int64), minlength=1 << (64 - shift)) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = before + np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1])
            self.levels.append((shift, bits, ranks))
            own = alone[at]
            before += int(own.sum())
            left = left[~own]
        slots = self._places(keys)
        self.keys[slots] = keys

    def _places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (shift, bits, ranks) in enumerate(self.levels):
            if not len(open_):
                break
            at = mixed(keys[open_], level) >> np.uint64(shift)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = bits[word]
            own = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[own]] = (ranks[word] + below)[own]
            open_ = open_[~own]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of ``keys``; -1 for what is not a key."""
        out = self._places(keys)
        some = out >= 0
        out[some] = np.where(self.keys[out[some]] == keys[some], out[some], -1)
        return out

    def dump(self) -> list[bytes]:
        return [np.array([s for s, _, _ in self.levels], np.int64).tobytes(), *(x.tobytes() for _, bits, ranks in self.levels for x in (bits, ranks)), self.keys.tobytes()]

    @classmethod
    def load(cls, parts: list[bytes]) -> PerfectHash:
        own = cls.__new__(cls)
        shifts = np.frombuffer(parts[0], np.int64).tolist()
        own.levels = [(s, np.frombuffer(parts[1 + 2 * i], np.uint64), np.frombuffer(parts[2 + 2 * i], np.int64)) for i, s in enumerate(shifts)]
        own.keys = np.frombuffer(parts[-1], np.uint64)
        return own


def _batch(kind: int, lang: list | None = None, word: list | None = None, n: list | None = None, chunk: list | None = None, part: list | None = None, data: list | None = None) -> pa.RecordBatch:
    size = len(next(x for x in (data, word) if x is not None))
    columns = [[kind] * size, *(x if x is not None else [None] * size for x in (lang, word, n, chunk, part, data))]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PASSED.split(", ")])


def _arrays(kind: int, array: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """What a task has counted, in chunks; those that are all zero are left out."""
    part = TaskContext.get().partitionId()
    for c in range(0, len(array), CHUNK):
        own = array[c : c + CHUNK]
        if own.any():
            yield _batch(kind, chunk=[first + c // CHUNK], part=[part], data=[zlib.compress(own.tobytes(), 1)])


def _stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df``, whose rows are arrays, as a table of small row groups; it is run in batches of ``ROWS``, or so many rows."""
    looks = {f"parquet.{x}.size.row.check.{y}": n for x in ("page", "block") for y, n in (("min", LEAST_ROWS), ("max", MOST_ROWS))}
    with batches_of(df.sparkSession, rows or ROWS):
        return write_table(df, name, {"parquet.block.size": GROUP_BYTES, **looks})


def _joined(rows: DataFrame, parts: int, join: Callable[[Iterator[bytes]], np.ndarray], give: Callable[[int, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What ``give`` makes of each chunk and what ``join`` makes of the data of all tasks for it, in a tree of nodes of ``FAN``."""

    def whole(group: pa.Table) -> np.ndarray:
        return join(zlib.decompress(x.as_buffer()) for x in group.column("data"))

    def node(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([zlib.compress(whole(group).tobytes(), 1)], pa.binary())})

    def root(key: tuple, group: pa.Table) -> pa.Table:
        return give(key[0].as_py(), whole(group))

    joined = rows.select("chunk", "part", "data")
    while parts > FAN:
        joined = joined.withColumn("part", F.expr(f"part div {FAN}")).groupBy("chunk", "part").applyInArrow(node, "chunk bigint, part bigint, data binary")
        parts = -(-parts // FAN)
    return joined.groupBy("chunk").applyInArrow(root, schema)


def _total(rows: DataFrame, kind: int, parts: int, dtype: str, give: Callable[[int, np.ndarray], pa.Table], schema: str, most: int | None = None) -> DataFrame:
    """What ``give`` makes of each chunk of the sum of the arrays of all tasks; entries stop at ``most``."""

    def add(data: Iterator[bytes]) -> np.ndarray:
        total = sum(np.frombuffer(x, dtype).astype(np.int64) for x in data)
        return (total if most is None else np.minimum(total, most)).astype(dtype)

    return _joined(rows.where(F.col("kind") == kind), parts, add, give, schema)


def word_seed(lang: str, attempt: int) -> int:
    """Spark's xxhash64 of columns starts each with the hash of the one before."""
    return xxhash.xxh64_intdigest(f"{attempt}:{lang}".encode(), 42)


def word_hash(lang: Column, word: Column, attempt: int) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{attempt}:"), lang), word)


def _words(text: bytes) -> list[bytes]:
    """Words, and ``END`` where a piece ends."""
    return text.translate(TEXT_BYTES).replace(END, b" . ").split()


def _cut(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of words in rows of about ``ROW_WORDS``, each of which ends where a piece does."""
    ends, start = np.flatnonzero(keys == 0) + 1, 0
    while start < len(keys):
        stop = int(ends[min(np.searchsorted(ends, start + ROW_WORDS), len(ends) - 1)])
        yield keys[start:stop]
        start = stop


def hashed(docs: DataFrame, attempt: int) -> DataFrame:
    """Rows of word hashes (zero ends a piece) by language, and partial counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for lang in sorted(set(batch.column("lang").to_pylist())):
                rows, seed = batch.filter(pc.equal(batch.column("lang"), lang)).column("text"), word_seed(lang, attempt)
                for start, end in slices(pc.binary_length(rows).to_pylist(), SLICE_BYTES):
                    words = [w for text in rows.slice(start, end - start).to_pylist() for w in (*_words(text), END)]
                    key = {w: xxhash.xxh64_intdigest(w, seed) for w in set(words)}
                    key[END] = 0
                    for row in _cut(np.fromiter(map(key.__getitem__, words), np.uint64, len(words))):
                        yield _batch(DATA, lang=[lang], data=[row.tobytes()])
                    n = counts.setdefault(lang, Counter())
                    held -= len(n)
                    n.update(words)
                    held += len(n)
                    if held > HELD:
                        yield from given(counts)
                        held = 0
        yield from given(counts)

    def given(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, n in counts.items():
            n.pop(END, None)
            if n:
                yield _batch(COUNTS, lang=[lang] * len(n), word=list(n), n=list(n.values()))
        counts.clear()

    read = docs.select(F.lit(0).alias("kind"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return _stored(read.mapInArrow(run, PASSED), "hashed-words", DOCUMENTS)


def first_level(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of hashes, all words (lang, word, f) and the frequent ones (lang, word, f, key), by a seed under which keys are words."""
    attempt = 0
    while True:
        rows = hashed(docs, attempt)
        words = write_table(rows.where(F.col("kind") == COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
        keyed = words.withColumn("key", word_hash(F.col("lang"), F.col("word"), attempt))
        shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("f").alias("f")).where((F.col("f") >= least) & ((F.col("n") > 1) | (F.col("key") == 0)))
        if shared.isEmpty():
            return rows, words, keyed.where(F.col("f") >= least)
        drop_tables(rows, words)
        attempt += 1


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 1_000) % np.uint64(shards)).astype(np.int64)


def build(keys: DataFrame, shard: int) -> tuple[DataFrame, list[int]]:
    """Perfect hashes (shard, n, parts) of ``keys`` (key; distinct), in a table, and how many keys each has."""
    n = keys.count()
    if n >= int(NONE):
        raise OverflowError(f"{n} candidates")
    shards = max(1, -(-n * 11 // (shard * 10)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("shard", pa.array(_shard(batch.column("key").to_numpy().view(np.uint64), shards)))

    def make(key: tuple, group: pa.Table) -> pa.Table:
        own = np.sort(group.column("key").to_numpy()).view(np.uint64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(own)], pa.int64()), "parts": pa.array([PerfectHash(own).dump()], pa.list_(pa.binary()))})

    dealt = keys.select("key").mapInArrow(deal, "key bigint, shard bigint")
    made = write_table(dealt.groupBy("shard").applyInArrow(make, "shard bigint, n bigint, parts array<binary>"), "perfect-hashes")
    sizes = {x["shard"]: x["n"] for x in made.select("shard", "n").collect()}  # one row for SHARD keys
    return made, [sizes.get(i, 0) for i in range(shards)]


class Slots:
    """Some of a level's perfect hashes: the first slot of each one, and what they were made of."""

    def __init__(self, shards: int, first: dict[int, int], parts: dict[int, list[bytes]]) -> None:
        self.shards, self.first, self.hashes = shards, first, {i: PerfectHash.load(x) for i, x in parts.items()}
        self.start = min(first.values(), default=0)
        self.size = sum(len(x.keys) for x in self.hashes.values())

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), NONE)
        of = _shard(keys, self.shards) if self.shards > 1 else None
        for shard, own in self.hashes.items():
            at = np.arange(len(keys)) if of is None else np.flatnonzero(of == shard)
            slots = own.slots(keys[at])
            out[at[slots >= 0]] = (self.first[shard] + slots[slots >= 0]).astype(np.uint32)
        return out

    def keys(self) -> np.ndarray:
        """Keys by slot, from ``start``."""
        return np.concatenate([np.zeros(0, np.uint64), *(self.hashes[i].keys for i in sorted(self.hashes))])


def rounds(made: DataFrame, sizes: list[int], hashes: int) -> Iterator[tuple[int, dict[int, int], dict[int, list[bytes]]]]:
    """What ``Slots`` takes, for so many hashes at once; each passes through the driver by itself."""
    first = np.append(0, np.cumsum(sizes)).tolist()
    for start in range(0, len(sizes), hashes):
        some = range(start, min(start + hashes, len(sizes)))
        held = made.where(F.col("shard").between(some[0], some[-1])).collect()
        yield len(sizes), {i: first[i] for i in some}, {x["shard"]: [bytes(y) for y in x["parts"]] for x in held}


def _buffers(column: pa.Array) -> Iterator[pa.Buffer | None]:
    return (x.as_buffer() if x.is_valid else None for x in column)


def _keys(data: bytes | pa.Buffer, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a row of the level before: its key at this level, and whether it has one."""
    if level == 1:
        keys = np.frombuffer(data, np.uint64)
        return keys, keys != 0
    slots = np.frombuffer(data, np.uint32)
    left, right = slots[:-1], slots[1:]
    return (left.astype(np.uint64) << np.uint64(32)) | right, (left != NONE) & (right != NONE)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys, 2_000) >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def advance(rows: DataFrame, level: int, made: DataFrame, sizes: list[int], hashes: int, buckets: int, least: int, last: bool) -> tuple[DataFrame, list[DataFrame], int]:
    """The rows of ``level``, by round its candidates (slot, left, right, f), frequent ones only, and how many tasks wrote the rows.

    Besides the rows (slots of the candidates at each place), the last round's pass counts the
    next level's pairs in buckets. Level 1 has its counts already; the last level needs no rows.
    """
    spark, kinds = rows.sparkSession, "uint8" if least < 256 else "uint32"
    counted = []
    plans = list(range(0, len(sizes), hashes))
    rows = rows.withColumn("found", F.lit(None).cast("binary"))
    for turn, held in enumerate(rounds(made, sizes, hashes)):
        sent, ends = spark.sparkContext.broadcast(held), turn + 1 == len(plans)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, ends=ends) -> Iterator[pa.RecordBatch]:
            slots = Slots(*sent.value)
            counts = np.zeros(slots.size if level > 1 else 0, np.int64)
            next_pairs = np.zeros(buckets if ends and not last else 0, kinds)
            for batch in batches:  # keys of all its rows are looked up, and pairs counted, together
                keyed = [_keys(x, level) for x in _buffers(batch.column("data"))]
                new = slots.find(np.concatenate([keys[some] for keys, some in keyed]))
                if level > 1:
                    np.add.at(counts, new[new != NONE].astype(np.int64) - slots.start, 1)
                next_keys, read = [], 0
                for lang, data, found, (keys, some) in zip(batch.column("lang").to_pylist(), *(_buffers(batch.column(x)) for x in ("data", "found")), keyed, strict=True):
                    own = np.full(len(keys), NONE) if found is None else np.frombuffer(found, np.uint32).copy()
                    n = np.count_nonzero(some)
                    own[some] = np.minimum(own[some], new[read : read + n])  # NONE is the greatest
                    read += n
                    if not ends:
                        yield _carried(lang, data.to_pybytes(), own)
                    elif not last and (own != NONE).any():
                        pairs, some = _keys(own.tobytes(), level + 1)
                        if some.any():
                            next_keys.append(pairs[some])
                            yield _carried(lang, own.tobytes(), None)
                if next_keys:
                    at, n = np.unique(_bucket(np.concatenate(next_keys), buckets), return_counts=True)
                    next_pairs[at] = np.minimum(next_pairs[at] + n, least)
            yield from map(_without_found, _arrays(COUNTS, counts))
            yield from map(_without_found, _arrays(BUCKETS, next_pairs))

        before = rows
        parts = before.rdd.getNumPartitions()
        rows = _stored(before.where(F.col("kind") == DATA).select("lang", "data", "found").mapInArrow(run, f"{PASSED}, found binary"), f"level-{level}")
        if turn:
            drop_tables(before)
        if level > 1:
            own = Slots(*held)
            start, keys = own.start, spark.sparkContext.broadcast(own.keys())

            def named(chunk: int, n: np.ndarray, start=start, keys=keys) -> pa.Table:
                at = np.flatnonzero(n >= least) + chunk * CHUNK
                own = keys.value[at]
                columns = [start + at, (own >> np.uint64(32)).astype(np.int64), (own & np.uint64(0xFFFFFFFF)).astype(np.int64), n[at - chunk * CHUNK]]
                return pa.table([pa.array(x) for x in columns], names=["slot", "left", "right", "f"])

            with batches_of(spark, ROWS):
                counted.append(write_table(_total(rows, COUNTS, parts, "int64", named, "slot bigint, left bigint, right bigint, f bigint"), f"candidates-{level}"))
            keys.destroy()
        sent.destroy()
    return rows, counted, parts


def _carried(lang: str, data: bytes, found: np.ndarray | None) -> pa.RecordBatch:
    own = _batch(DATA, lang=[lang], data=[data])
    return own.append_column("found", pa.array([None if found is None else found.tobytes()], pa.binary()))


def _without_found(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.append_column("found", pa.nulls(batch.num_rows, pa.binary()))


def candidates(rows: DataFrame, counted_by: int, level: int, buckets: int, least: int, chunks: int) -> DataFrame:
    """(key): distinct pairs of neighbouring slots in ``rows``, which so many tasks counted, whose bucket is frequent, in a table.

    Tasks give sorted keys in ``chunks`` by hash, which are united in a tree.
    """
    spark, kinds = rows.sparkSession, "uint8" if least < 256 else "uint32"

    def heavy(chunk: int, n: np.ndarray) -> pa.Table:
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "data": pa.array([np.packbits(n >= least, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros(-(-buckets // 8), np.uint8)
    with batches_of(spark, ROWS):
        for x in _total(rows, BUCKETS, counted_by, kinds, heavy, "chunk bigint, data binary", least).collect():  # a bit a bucket
            bits[x["chunk"] * CHUNK // 8 :][: len(x["data"])] = np.frombuffer(x["data"], np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def given() -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.concatenate(found))
            of = mixed(keys, 3_000) % np.uint64(chunks)
            for c in np.unique(of):
                own = zlib.compress(keys[of == c].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own], pa.binary())], names=["chunk", "part", "data"])

        for batch in batches:
            keys = np.concatenate([keys[some] for keys, some in (_keys(x, level) for x in _buffers(batch.column("data")))])
            at = _bucket(keys, buckets)
            own = np.unique(keys[(sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1])
            found.append(own)
            size += len(own)
            if size > MOST_KEYS:
                found = [np.unique(np.concatenate(found))]
                size = len(found[0])
                if size > MOST_KEYS // 2:
                    yield from given()
                    found, size = [], 0
        if size:
            yield from given()

    def unite(data: Iterator[bytes]) -> np.ndarray:
        return np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in data]))

    def unpacked(chunk: int, keys: np.ndarray) -> pa.Table:
        return pa.table({"key": pa.array(keys.view(np.int64))})

    packed = rows.where(F.col("kind") == DATA).select("data").mapInArrow(run, "chunk bigint, part bigint, data binary")
    with batches_of(spark, ROWS):
        made = write_table(_joined(packed, rows.rdd.getNumPartitions(), unite, unpacked, "key bigint"), f"keys-{level}")
    sent.destroy()
    return made


def levels(docs: DataFrame, least: int = LEAST, words: int = WORDS, shard: int = SHARD, hashes: int = ROUND, words_a_bucket: int = WORDS_A_BUCKET) -> tuple[DataFrame, list[DataFrame]]:
    """All words (lang, word, f), and for each length of phrases the frequent ones: (slot, lang, word, f) and (slot, left, right, f)."""
    rows, every, frequent = first_level(docs, least)
    total = every.agg(F.sum("f")).first()[0] or 0
    buckets = 1 << max(LEAST_BUCKETS.bit_length() - 1, min(MOST_BUCKETS.bit_length() - 1, (total // words_a_bucket).bit_length()))
    keys = write_table(frequent, "frequent-words")
    found = []
    for level in range(1, words + 1):
        made, sizes = build(keys, shard)
        before = rows
        rows, counted, parts = advance(before, level, made, sizes, hashes, buckets, least, level == words)
        drop_tables(before)
        if level == 1:
            first = np.append(0, np.cumsum(sizes)).tolist()

            def numbered(batches: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for shard, parts in zip(batch.column("shard").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                        own = np.frombuffer(parts[-1], np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(first[shard] + np.arange(len(own))), pa.array(own)], names=["slot", "key"])

            slots = made.select("shard", "parts").mapInArrow(numbered, "slot bigint, key bigint")
            found.append(write_table(keys.join(slots, "key").select("slot", "lang", "word", "f"), "candidates-1"))
        else:
            found.append(counted[0] if len(counted) == 1 else write_table(_union(counted), f"candidates-{level}"))
        drop_tables(made, keys)
        if level < words:
            keys = candidates(rows, parts, level + 1, buckets, least, 1 + total // (WORDS_A_CHUNK * shard))
    drop_tables(rows)
    return every, found


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionAll(x)
    return out


def _whole(a: Column) -> Column:
    return a.cast("decimal(38,0)")


def scored(found: list[DataFrame]) -> list[DataFrame]:
    """For each length from 2 words: (slot, lang, phrase, a, l, r, score, covered).

    ``first`` and ``last`` are the counts of a phrase's first and last 1, 2, ... words: a
    phrase has its left part's first ones and that part, and its right part's last ones and that.
    """
    none = F.array().cast("array<bigint>")
    below = found[0].select("slot", "lang", F.col("word").alias("phrase"), F.col("word").alias("end"), "f", none.alias("first"), none.alias("last"))
    out = []
    for k, level in enumerate(found[1:], 2):
        a, b = (below.select(*(F.col(c).alias(f"{side}_{c}") for c in below.columns)) for side in ("left", "right"))
        joined = level.join(a, F.col("left") == F.col("left_slot")).join(b, F.col("right") == F.col("right_slot"))
        below = write_table(
            joined.select(
                "slot", F.col("left_lang").alias("lang"), F.concat_ws(" ", "left_phrase", "right_end").alias("phrase"), F.col("right_end").alias("end"), "f",
                F.array_append("left_first", F.col("left_f")).alias("first"), F.array_append("right_last", F.col("right_f")).alias("last"), "left", "right",
            ),
            f"phrases-{k}",
        )
        cuts = []
        for j in range(1, k):
            left, right = F.element_at("first", j), F.element_at("last", k - j)
            score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * F.col("f").cast("decimal(20,0)"), left.cast("decimal(20,0)") + right.cast("decimal(20,0)"))
            cuts.append(F.struct(score.alias("score"), F.lit(j).alias("k"), left.alias("l"), right.alias("r")))
        least = F.array_min(F.array(*cuts)).alias("cut")
        out.append(below.select("slot", "lang", "phrase", F.col("f").alias("a"), least, "left", "right"))
        below = below.drop("left", "right")
    return out


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **bounds: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language of ``docs`` (lang, text)."""
    every, found = levels(docs, least, **bounds)
    lengths = scored(found)
    kept = []
    for own, longer in zip(lengths, [*found[2:], None], strict=True):
        if longer is not None:
            # A phrase two words longer has one of these inside, which is as frequent at least.
            covering = longer.select(F.col("left").alias("slot"), F.col("f").alias("longer")).unionAll(longer.select("right", "f")).groupBy("slot").agg(F.max("longer").alias("longer"))
            own = own.join(covering, "slot", "left").where(F.col("longer").isNull() | (F.lit(100) * _whole(F.col("longer")) < F.lit(COVERED) * _whole(F.col("a"))))
        kept.append(own.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = _union(kept).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # A language's phrases are thinned in parts before they are ranked together.
    some = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top).drop("part", "place")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    n = every.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Near-duplicates by 64-bit SimHash fingerprints, compared exactly in tiles.

Fingerprints are grouped first, so copies are one row. Distinct fingerprints are packed into
tiles of one population count each, a row a tile; two fingerprints within the radius have
counts that differ by the radius at most, so all other pairs of tiles are skipped. A pair of
tiles is compared with numpy exclusive-or and bit counts, after a second cut into small tiles
by the counts of their quarters, and returns a forest of its links, never all pairs of a group.

Defined results: a null text counts as empty; a text without words has the fingerprint zero,
which is linked as any other; a row of null doc_id is compared, and its component is the
smallest id known; repeated rows share a component; very long texts are hashed whole; an
empty table gives no rows; other columns, whatever their names, are ignored by
``near_duplicates`` and kept by ``representatives`` and ``verified_representatives``. The latter takes fingerprints of a wide
radius as candidates only and links two texts if their shingle sets are similar enough; texts
without words have equal sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .support import ROW_ID, RowName, arrow_map, drop_tables, known_rows, texts, unpacked, with_row_id, write_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lower case for A-Z only.
LOWER = {c: c + 32 for c in range(65, 91)}
#: Fingerprints of a tile, about, at any size of input: those of one population count are dealt by hash into as many
#: tiles as they need. Inside of tiles, small tiles are compared, so many at a time that the cells fit a core's cache.
TILE, SMALL, AT_A_TIME = 262_144, 256, 16
#: Tasks that the pairs of tiles are dealt to.
MOST_TASKS = 10_000
#: Candidates within WIDE bits are linked if their shingle sets share SIMILAR (a fraction) of their union.
WIDE, SIMILAR = 14, (4, 5)
#: Tiles of candidates hold so many population counts each, as a wide radius makes a tile meet nearly all others.
WIDE_BAND, WIDE_PARTS = 8, 2
#: A set's bitmap: each member flips one of 256 bits. Two bitmaps differ in no more bits than the sets in members.
BITS = ("b0", "b1", "b2", "b3")
#: Candidates of a text in the first round, and their growth.
ALLOWANCE, MORE = 4, 8


def shingle_hashes(text: str, words: int, seed: int) -> bytes:
    """The 8-byte hashes of the shingles, repeats included; empty without words."""
    found = WORD.findall(text.translate(LOWER) if not text.islower() else text)
    if not found:
        return b""
    n = len(found) - words + 1
    shingles = [" ".join(found)] if n < 1 else map(" ".join, zip(*(found[k : k + n] for k in range(words)), strict=True))
    digest = xxhash.xxh64_digest
    return b"".join([digest(s.encode("utf-8", "surrogatepass"), seed) for s in shingles])


def fingerprint(text: str, words: int, seed: int) -> int:
    """Bit by bit the majority of the hashes of the shingles, repeats included; zero without words."""
    return majority(shingle_hashes(text, words, seed))


def majority(data: bytes) -> int:
    if not data:
        return 0
    bits, total = np.zeros(64, np.int64), len(data) // 8
    rows = np.frombuffer(data, np.uint8).reshape(-1, 8)
    for start in range(0, total, 65_536):
        bits += np.unpackbits(rows[start : start + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > total).tobytes(), "big")


def _with(wanted: DataFrame, more: str) -> StructType:
    """The schema of (__row_id, doc_id) of ``wanted`` and more longs."""
    return StructType([*wanted.select(ROW_ID, "doc_id").schema.fields, *(StructField(x.split()[0], LongType()) for x in more.split(", "))])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(__row_id, doc_id, fp) of every row of ``docs`` (__row_id, doc_id, text), in a table of the shared folder; fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([fingerprint(x, words, seed) for x in texts(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(ROW_ID), batch.column("doc_id"), pa.array(fps)], names=[ROW_ID, "doc_id", "fp"])

    wanted = docs.select(ROW_ID, F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return write_table(arrow_map(wanted, run, _with(wanted, "fp bigint")), "fingerprints")


class Forest:
    """Disjoint sets over positions; ``add`` says whether a link joined two sets."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _small_tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in order of their quarters' bit counts, and each small tile's least and most counts."""
    q = _quarters(fps)
    order = np.lexsort(q.T)
    fps, q = fps[order], q[order]
    starts = np.arange(0, len(fps), SMALL)
    return fps, np.minimum.reduceat(q, starts, axis=0), np.maximum.reduceat(q, starts, axis=0)


def _near(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y), in the orders of ``_small_tiles``, of all pairs within the radius between two tiles (b None: within one)."""
    a, low_a, high_a = _small_tiles(a)
    same = b is None
    b, low_b, high_b = (a, low_a, high_a) if same else _small_tiles(b)
    for i in range(len(low_a)):
        # the least sum of differences of the quarters' counts that two members can have
        gap = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        near = near[near >= i] if same else near
        rows = a[i * SMALL : (i + 1) * SMALL]
        for part in np.array_split(near, -(-len(near) // AT_A_TIME)) if len(near) else ():
            at = (part[:, None] * SMALL + np.arange(SMALL)).reshape(-1)
            at = at[at < len(b)]
            found = np.flatnonzero(np.bitwise_count(rows[:, None] ^ b[at][None, :]) <= radius)
            x, y = found // len(at) + i * SMALL, at[found % len(at)]
            if same:
                x, y = x[x < y], y[x < y]
            yield x, y


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """A forest of the links within the radius between two tiles (b None: within one)."""
    same = b is None
    in_a = _small_tiles(a)[0]
    in_b = in_a if same else _small_tiles(b)[0]
    forest = Forest(len(in_a) + (0 if same else len(in_b)))
    for x, y in _near(a, b, radius):
        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            if forest.add(u, v if same else len(in_a) + v):
                yield int(in_a[u]), int(in_b[v])


def _least_of_each(high: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` least partners of each node, and the nodes that had more."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(high) else np.zeros(0, np.int64)
    rank = np.arange(len(high)) - np.repeat(starts, np.diff(np.r_[starts, len(high)]))
    return high[rank < most], low[rank < most], np.unique(high[rank >= most])


def tile_candidates(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, radius: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, withheld): of each open node, its ``most`` least partners of smaller key within the radius that have another label and may be similar, and whether it had more.

    ``a`` and ``b`` (None: one tile) hold key, fp, n (the set's size), bits, label and open. Sets
    are similar if they differ in at most a share of their sizes' sum (a ninth for 4 of 5), and
    their bitmaps differ in no more bits than they in members: so this drops no similar pair,
    and few others stay, however dense a group of texts is. Pairs of nodes that are not open
    are not compared.
    """
    take = lambda t, m: {k: v[m] for k, v in t.items()}
    sort = lambda t: take(t, np.lexsort(_quarters(t["fp"]).T))
    a_open, a_done = take(a, a["open"]), take(a, ~a["open"])
    if b is None:
        sides = [(a_open, None), (a_open, a_done)]
    else:
        b_open = take(b, b["open"])
        sides = [(a_open, b_open), (a_open, take(b, ~b["open"])), (a_done, b_open)]
    none = np.zeros(0, np.int64)
    high, low, more, size = [none], [none], [none], 0
    for one, other in sides:
        if not len(one["fp"]) or (other is not None and not len(other["fp"])):
            continue
        p = sort(one)
        q = p if other is None else sort(other)
        for x, y in _near(one["fp"], None if other is None else other["fp"], radius):
            less, greater = np.minimum(p["n"][x], q["n"][y]), np.maximum(p["n"][x], q["n"][y])
            first = p["key"][x] > q["key"][y]
            its_open = np.where(first, p["open"][x], q["open"][y])
            good = np.flatnonzero(its_open & (p["label"][x] != q["label"][y]) & (SIMILAR[1] * less >= SIMILAR[0] * greater))
            apart = np.bitwise_count(p["bits"][x[good]] ^ q["bits"][y[good]]).sum(axis=1, dtype=np.int64)
            good = good[(SIMILAR[1] + SIMILAR[0]) * apart <= (SIMILAR[1] - SIMILAR[0]) * (less + greater)[good]]
            u, v = p["key"][x[good]], q["key"][y[good]]
            high.append(np.maximum(u, v))
            low.append(np.minimum(u, v))
            size += len(u)
            if size > 500_000:
                h, w, held = _least_of_each(np.concatenate(high), np.concatenate(low), most)
                high, low, more, size = [h], [w], [*more, held], 0
    h, w, held = _least_of_each(np.concatenate(high), np.concatenate(low), most)
    return h, w, np.isin(h, np.concatenate([*more, held]))


def _compared(distinct: DataFrame, radius: int, tile: int, band: int, least: int, compare: Callable[[pa.StructArray, pa.StructArray | None], dict[str, np.ndarray]], schema: str, empty: dict[str, np.ndarray]) -> DataFrame:
    """What ``compare`` returns for each pair of tiles of ``distinct`` (fp and others) that may hold links; None: a tile with itself.

    A tile is one row, packed before the pairs are made: pairs, and the bytes that are
    shuffled, are counted in tiles. It holds ``band`` population counts, and is one of at
    least ``least`` of these. The pair (t, u) has one task; tiles are numbered by population
    count, so a tile meets a range of numbers.
    """
    tiled = distinct.withColumn("of_band", F.floor(F.bit_count("fp") / band).cast("int"))
    counts = {x["of_band"]: x["n"] for x in tiled.groupBy("of_band").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    bands = 64 // band + 1
    parts = [max(least, -(-counts[k] // tile)) if k in counts else 0 for k in range(bands)]
    first = np.cumsum([0, *parts]).tolist()
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("of_band") + 1)
    number = of(first[:-1]) + F.pmod(F.xxhash64("fp"), of([max(1, x) for x in parts])).cast("int")
    packed = write_table(tiled.groupBy(number.alias("tile"), "of_band").agg(F.collect_list(F.struct(*distinct.columns)).alias("members")), "tiles")
    # The bands whose counts are within the radius of one of this band's counts.
    low = [first[max(0, (k * band - radius) // band)] for k in range(bands)]
    high = [first[min(bands, (k * band + band - 1 + radius) // band + 1)] for k in range(bands)]
    met = packed.select("tile", F.explode(F.sequence(of(low), of(high) - 1)).alias("other"), "members")
    pairs = met.select(F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), (F.col("tile") > F.col("other")).alias("second"), "members")
    n_pairs = sum(n * (high[k] - first[k]) for k, n in enumerate(parts))

    def run(group: pa.Table) -> pa.Table:
        sides = {second: members.values for second, members in zip(group.column("second").to_pylist(), group.column("members"), strict=True)}
        same = group.column("t")[0].as_py() == group.column("u")[0].as_py()
        a, b = sides.get(False), sides.get(True)
        found = compare(a, None if same else b) if a is not None and (same or b is not None) else empty
        return pa.table(found)

    return pairs.repartition(max(1, min(n_pairs, MOST_TASKS)), "t", "u").groupBy("t", "u").applyInArrow(run, schema)


def _fps(members: pa.StructArray) -> np.ndarray:
    return members.field("fp").to_numpy().view(np.uint64)


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect what the links of ``distinct`` (fp) connect."""

    def compare(a: pa.StructArray, b: pa.StructArray | None) -> dict[str, np.ndarray]:
        found = list(tile_links(_fps(a), None if b is None else _fps(b), radius))
        x = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return {"a": x[:, 0], "b": x[:, 1]}

    none = np.zeros(0, np.int64)
    return _compared(distinct, radius, tile, 1, 1, compare, "a bigint, b bigint", {"a": none, "b": none})


def candidates(nodes: DataFrame, radius: int, most: int, tile: int = TILE) -> DataFrame:
    """(a, b, withheld): pairs of ``nodes`` (key, fp, n, bits, label, open) that ``tile_candidates`` finds."""

    def columns(members: pa.StructArray) -> dict[str, np.ndarray]:
        bits = np.stack([members.field(x).to_numpy() for x in BITS], axis=1).view(np.uint64)
        still_open = members.field("open").to_numpy(zero_copy_only=False)
        return {x: members.field(x).to_numpy() for x in ("key", "n", "label")} | {"fp": _fps(members), "bits": bits, "open": still_open}

    def compare(a: pa.StructArray, b: pa.StructArray | None) -> dict[str, np.ndarray]:
        high, low, withheld = tile_candidates(columns(a), None if b is None else columns(b), radius, most)
        return {"a": high, "b": low, "withheld": withheld}

    none = np.zeros(0, np.int64)
    return _compared(nodes, radius, tile, WIDE_BAND, WIDE_PARTS, compare, "a bigint, b bigint, withheld boolean", {"a": none, "b": none, "withheld": none.astype(bool)})


def classes(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of ``rows`` (doc_id, fp)."""
    distinct = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(links(distinct.select("fp"), radius))
    nodes = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    return nodes.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): __row_id, doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    rows = fingerprints(with_row_id(docs), words, seed)
    joined = rows.join(classes(rows, radius), "fp")
    return joined.select(ROW_ID, "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _kept(rows: DataFrame, joined: DataFrame, unnamed: str, columns: list[str]) -> DataFrame:
    """Of ``rows``, those that ``joined`` (__row_id, doc_id, component_id) says to be the first of their component's smallest doc_id.

    Rows of null doc_id come last; a component of such rows alone is known by ``unnamed`` only, and each one of those stays.
    """
    own = joined.select(ROW_ID, "component_id", "doc_id", F.when(F.col("component_id").isNull(), F.col(unnamed)).alias("unnamed"))
    first = own.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id", "unnamed").agg(F.min(ROW_ID).alias(ROW_ID))
    # The rows that go are fewer than those that stay; a table, so that its size is known when the join with all texts is planned.
    gone = write_table(joined.select(ROW_ID).join(first.select(ROW_ID), ROW_ID, "left_anti"), "near-copies")
    return unpacked(rows.join(gone, ROW_ID, "left_anti"), columns)


def representatives(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, row: RowName | None = None) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: of the smallest doc_id, the first row that has it; ``row`` as in ``known_rows``."""
    known = known_rows(docs, row)
    rows = fingerprints(known.select(ROW_ID, "input.doc_id", "input.text"), words, seed)
    return _kept(known, rows.join(classes(rows, radius), "fp"), "fp", docs.columns)


def shingle_sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """Per row of ``docs`` (__row_id, doc_id, text): its fingerprint, the key, size and bitmap of its shingle set; in a table of the shared folder."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps, keys, sizes, bits = [], [], [], []
        for text in texts(batch):
            data = shingle_hashes(text, words, seed)
            distinct = np.unique(np.frombuffer(data, np.int64))
            fps.append(majority(data))
            keys.append(xxhash.xxh64_intdigest(distinct.tobytes(), seed))
            sizes.append(len(distinct))
            bits.append(bitmap(distinct))
        columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, keys)] + [pa.array(sizes, pa.int64())]
        columns += [pa.array(x) for x in np.array(bits, np.int64).reshape(-1, len(BITS)).T.copy()]
        yield pa.RecordBatch.from_arrays([batch.column(ROW_ID), batch.column("doc_id"), *columns], names=[ROW_ID, "doc_id", "fp", "key", "n", *BITS])

    wanted = docs.select(ROW_ID, F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return write_table(arrow_map(wanted, run, _with(wanted, ", ".join(f"{x} bigint" for x in ("fp", "key", "n", *BITS)))), "shingle-sets")


def bitmap(distinct: np.ndarray) -> np.ndarray:
    """256 bits as four longs: a set's member flips the bit that the last byte of its hash names."""
    flips = np.bincount(distinct.view(np.uint8)[::8], minlength=256) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def similar(docs: DataFrame, nodes: DataFrame, edges: DataFrame, words: int, seed: int) -> DataFrame:
    """The ``edges`` (a, b: keys of ``nodes``) whose shingle sets are similar; only texts at their ends are read again."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [np.unique(np.frombuffer(shingle_hashes(x, words, seed), np.int64)) for x in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    ends = edges.select(F.col("a").alias("key")).union(edges.select(F.col("b").alias("key"))).distinct()
    wanted = write_table(nodes.join(ends, "key", "left_semi").select("key", F.col("row").alias(ROW_ID)), "ends")
    sets = write_table(arrow_map(docs.select(ROW_ID, "text").join(wanted, ROW_ID).select("key", "text"), run, "key bigint, shingles array<bigint>"), "shingles")
    joined = edges.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    found = joined.where(SIMILAR[1] * common >= SIMILAR[0] * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")
    checked = write_table(found, "similar")
    drop_tables(wanted, sets)
    return checked


def verified_classes(docs: DataFrame, nodes: DataFrame, words: int, radius: int, seed: int) -> DataFrame:
    """(key, component) of ``nodes`` (key, fp, n, bits, row): connected by candidate pairs whose sets are similar.

    A round checks a bounded number of candidates for each text. Another round, of a higher
    bound, looks at the texts that had more, and at their candidates that are not connected to
    them yet. So a dense group costs few pairs a text, and no candidate pair of two components
    is left unchecked.
    """
    labels = nodes.select("key", "fp", "n", *BITS, F.col("key").alias("label"), F.lit(True).alias("open"))
    edges, most = None, ALLOWANCE
    while True:
        found = write_table(candidates(labels, radius, most), "candidates")
        ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("b")))
        more = F.col("withheld") | (F.col("place") > most)
        state = ranked.agg(F.count("*").alias("n"), F.coalesce(F.max(more), F.lit(False)).alias("more")).first()
        if not state["n"]:
            return labels.select("key", F.col("label").alias("component"))
        checked = similar(docs, nodes, ranked.where(F.col("place") <= most).select("a", "b"), words, seed)
        edges = checked if edges is None else edges.union(checked)
        of = components(edges)
        still_open = ranked.where(more).select(F.col("a").alias("key"), F.lit(True).alias("open")).distinct()
        joined = nodes.join(of, nodes["key"] == of["node"], "left").join(still_open, "key", "left")
        labels = write_table(joined.select("key", "fp", "n", *BITS, F.coalesce("component", "key").alias("label"), F.coalesce("open", F.lit(False)).alias("open")), "labels")
        drop_tables(found)
        if not state["more"]:
            return labels.select("key", F.col("label").alias("component"))
        most *= MORE


def verified_representatives(docs: DataFrame, words: int = 5, radius: int = WIDE, seed: int = 42, row: RowName | None = None) -> DataFrame:
    """One row of ``docs`` for each group connected by similar shingle sets: of the smallest doc_id, the first row that has it; ``row`` as in ``known_rows``."""
    known = known_rows(docs, row)
    read = known.select(ROW_ID, "input.doc_id", "input.text")
    rows = shingle_sets(read, words, seed)
    nodes = write_table(rows.groupBy("key").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), *(F.min(x).alias(x) for x in BITS), F.min(ROW_ID).alias("row"), F.min("doc_id").alias("first")), "distinct-sets")
    of = verified_classes(read, nodes.drop("first"), words, radius, seed)
    placed = write_table(nodes.select("key", "first").join(of, "key"), "components-of-sets")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    return _kept(known, rows.join(placed.join(least, "component").select("key", "component_id"), "key"), "key", docs.columns)

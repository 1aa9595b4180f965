"""Token counts without token ids.

Pieces are counted once for each distinct pre-token of the corpus, joined to the frequencies
of pre-tokens by document, and summed. Documents are taken in blocks; a block's frequencies
(each distinct pre-token with the places of its documents in the block and how often they have
it) are a table keyed by block. Only the distinct pre-tokens of a block travel, dealt into
buckets by hash: a bucket encodes each one once and answers every block that asked with the
numbers of pieces, in the order asked. Answers then join the frequencies of their block. So a
pre-token that every document has is one entry a block in its bucket, never one a document,
and a task holds one bucket's pre-tokens or one block.

Defined results: a null text counts as empty; an empty text has no bytes and no tokens; long
texts are counted whole; repeated rows, null or equal ids are counted each; of equal counts
there is no order; an empty table gives no rows; other columns, whatever their names, are
ignored. A special token's string inside a text is that one token, as the library does by
default.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .support import ROW_ID, arrow_map, slices, texts, write_table

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters alone are split here; the library splits all others, whose classes may depend on the version of Unicode.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa0-\u024f\u0370-\u0373\u0386-\u03ff\u0400-\u04ff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
#: Characters and rows of a block of documents; they bound a task's memory, and places in a block fit 15 bits.
BLOCK_CHARS, BLOCK_ROWS = 8_000_000, 30_000


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> regex.Pattern | None:
    names = [x.content for x in tokenizer(path).get_added_tokens_decoder().values()]
    return regex.compile("(" + "|".join(map(regex.escape, sorted(names, key=len, reverse=True))) + ")") if names else None


def pretokens(text: str, path: str) -> list[str]:
    """The pre-tokens of a whole text; a special token's string is one of its own."""
    special = _special(path)
    if special and special.search(text):
        out = []
        for i, part in enumerate(special.split(text)):
            out += [part] if i % 2 else pretokens(part, path) if part else []
        return out
    if PLAIN.fullmatch(text):
        return PATTERN.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


#: A row for each bucket that has pre-tokens of a block, and one without bucket for its documents.
FREQUENCIES = "block bigint, bucket int, joined string, sizes array<int>, n_rows array<int>, places array<smallint>, counts array<tinyint>, ids array<bigint>, n_bytes array<bigint>"
#: What one entry can count; a pre-token that a document has more often takes several entries.
MOST = 127


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _block(rows: list[str], ids: pa.Array, block: int, path: str, buckets: int) -> pa.RecordBatch:
    """The block's documents, and for each bucket that has pre-tokens of it: these, joined, and their places and counts."""
    tokens = [pretokens(x, path) for x in rows]
    codes, distinct = pd.factorize(np.array([w for t in tokens for w in t], dtype=object))
    place = np.repeat(np.arange(len(rows)), [len(t) for t in tokens])
    bucket = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in distinct], np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs, counts = np.unique(rank[codes] * len(rows) + place, return_counts=True)
    entries = -(-counts // MOST)
    pairs, last = np.repeat(pairs, entries), np.cumsum(entries) - 1
    spread = np.full(len(pairs), MOST)
    spread[last] = counts - MOST * (entries - 1)
    n_rows = np.bincount(pairs // max(len(rows), 1), minlength=len(order))
    bucket, words = bucket[order], distinct[order].tolist()
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    # The last row is the documents': it has no words, and all others have no documents.
    ends = np.append(starts, [len(words), len(words)])
    at = np.append(0, np.cumsum(n_rows))[ends]
    n, own = len(starts), np.append(np.zeros(len(starts) + 1, np.int64), len(rows))
    sizes = np.array([len(x.encode("utf-8", "surrogatepass")) for x in rows], np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, block, np.int64)),
            pa.array([*bucket[starts].tolist(), None], pa.int32()),
            pa.array(["".join(words[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()),
            _lists(np.array([len(w) for w in words], np.int64), ends, pa.int32()),
            _lists(n_rows, ends, pa.int32()),
            _lists(pairs % max(len(rows), 1), at, pa.int16()),
            _lists(spread, at, pa.int8()),
            pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), ids),
            _lists(sizes, own, pa.int64()),
        ],
        names=[x.split()[0] for x in FREQUENCIES.split(", ")],
    )


def frequencies(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Frequencies of pre-tokens in ``docs`` (doc_id, text), a row per block and bucket, in a table of the shared folder."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, ids = texts(batch), batch.column("doc_id")
        for start, end in slices([max(len(x), BLOCK_CHARS // BLOCK_ROWS) for x in found], BLOCK_CHARS):
            # a block is named by the id of its first row in this read, which is written with it
            yield _block(found[start:end], ids.slice(start, end - start), batch.column(ROW_ID)[start].as_py(), path, buckets)

    wanted = docs.select(F.monotonically_increasing_id().alias(ROW_ID), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return write_table(arrow_map(wanted, run, FREQUENCIES), "frequencies")


def _cut(joined: str, sizes: np.ndarray) -> list[str]:
    ends = np.cumsum(sizes).tolist()
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def pieces(freq: DataFrame, path: str) -> DataFrame:
    """(block, bucket, pieces): the number of pieces of each pre-token of ``freq``, in its order; each distinct one is encoded once, in its bucket."""

    def run(group: pa.Table) -> pa.Table:
        words = [_cut(j, s.values.to_numpy()) for j, s in zip(group.column("joined").to_pylist(), group.column("sizes"), strict=True)]
        known = dict.fromkeys(w for x in words for w in x)
        known = dict(zip(known, (len(e.ids) for e in tokenizer(path).encode_batch_fast(list(known), add_special_tokens=False)), strict=True))
        ends = np.append(0, np.cumsum([len(x) for x in words]))
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "pieces": _lists(np.array([known[w] for x in words for w in x], np.int64), ends, pa.int32())})

    return freq.where("bucket is not null").select("block", "bucket", "joined", "sizes").groupBy("bucket").applyInArrow(run, "block bigint, bucket int, pieces array<int>")


COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``n_bytes`` and ``n_tokens``.

    The buckets, two for each of the table's partitions if not given, bound what one task holds.
    """
    freq = frequencies(docs, path, buckets or max(32, 2 * docs.rdd.getNumPartitions()))

    def add(own: pa.Table, answers: pa.Table) -> pa.Table:
        documents = own.filter(own.column("bucket").is_null())
        ids, n_bytes = (documents.column(x).combine_chunks().flatten() for x in ("ids", "n_bytes"))
        total, of = np.zeros(len(ids), np.int64), dict(zip(answers.column("bucket").to_pylist(), answers.column("pieces"), strict=True))
        for bucket, n, places, counts in zip(own.column("bucket").to_pylist(), *(own.column(x) for x in ("n_rows", "places", "counts")), strict=True):
            if bucket is not None:
                each = np.repeat(of[bucket].values.to_numpy().astype(np.int64), n.values.to_numpy())
                np.add.at(total, places.values.to_numpy(), each * counts.values.to_numpy())
        return pa.table({"doc_id": ids, "n_bytes": n_bytes, "n_tokens": total})

    blocks = freq.select("block", "bucket", "n_rows", "places", "counts", "ids", "n_bytes").groupBy("block")
    return blocks.cogroup(pieces(freq, path).groupBy("block")).applyInArrow(add, COUNTED)

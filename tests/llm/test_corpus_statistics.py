"""Phrase collocations, exact top-k and source divergence against plain code."""

import math
import os
import random
import re
from collections import Counter, defaultdict
from urllib.parse import unquote, urlparse

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from shelfspark.llm import divergence, phrases, queries, topk

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_phrases(rows, least, top, words=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = {(lang, p[i:j]) for (lang, p), longer in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * longer >= 80 * f[lang, p[i:j]]}
    ranked = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in covered:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            ranked[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, own in ranked.items() for i, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def plain_top_k(rows, k, is_query):
    """rows: (id, vector); in the order of rows for equal ids."""
    own = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(own):
        if q is not None and is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), c is None, c or 0) for other, (c, y) in enumerate(own) if other != at)
            out += [(q, rank, None if none else c, -score) for rank, (score, none, c) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def plain_divergence(rows, least=10):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [x.translate(LOWER) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in counts if x == lang)
        total = sum((counts[lang, s] for s in sources), Counter())

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        ps, q = {s: p(counts[lang, s]) for s in sources}, p(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(ps[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and ps[s][t] > q[t])[:10]
            out += [(lang, s, part, item.decode(), -value, i) for part, found in (("pair", pairs), ("term", terms)) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string, phrase string, n bigint, key string, data string, slot int, value string, term int").repartition(3)


def invented(n, seed):
    """Few words, so that phrases repeat; ends of pieces, blanks and letters of other kinds."""
    of = random.Random(seed)
    words = ["a", "B", "ccc", "ÄB", "İx", "d-d", "e'e", "\x1c", "\x00", "\xa0", "ﬁ"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!?"]
    texts = ["".join(of.choice(words) + of.choice(ends) for _ in range(of.randrange(60))) for _ in range(n)]
    return [(t, of.choice(["en", "de", None, ""]), of.choice(["s", "t", "u", None, "ü"]), "p", 1, "k", "d", 3, "v", 4) for t in texts] + [(None, "en", "s", *[None] * 7), ("", "xx", "y", *[None] * 7), ("", "xx", "z", *[None] * 7)]


def rows_of(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
AUDIT = ["lang", "source", "part", "item", "value", "rank"]
NEIGHBOURS = ["query_id", "rank", "id", "score"]


@pytest.mark.parametrize("bounds", [{}, {"shard": 8, "hashes": 2, "words_a_bucket": 4}])
def test_phrases(spark, bounds):
    rows = invented(300, 1)
    got = rows_of(phrases.collocations(documents(spark, rows), 5, 40, **bounds), PHRASE)
    assert got == plain_phrases([(r[1], r[0]) for r in rows], 5, 40)
    assert len(got) > 100


def test_phrases_of_documents(spark, docs, sf_dir):
    got = rows_of(queries.op11_phrase_collocations(spark, sf_dir), PHRASE)
    assert got == plain_phrases([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 30, 2000)
    sql = queries.SQL["op11_phrase_collocations"].replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(duckdb.sql(f"SELECT {', '.join(PHRASE)} FROM ({sql})").fetchall())


def test_odd_and_empty_phrases(spark, odd, nothing):
    got = rows_of(phrases.collocations(odd, 2, 50), PHRASE)
    assert got == plain_phrases([(r.lang, r.text) for r in odd.select("lang", "text").collect()], 2, 50)
    assert phrases.collocations(nothing).collect() == []


def test_words_that_share_a_hash(spark, monkeypatch):
    """A seed under which a frequent word shares its key with another word is not used."""
    tried = []
    real = phrases.word_hash

    def poor(lang, word, attempt):
        tried.append(attempt)
        from pyspark.sql import functions as F

        return real(lang, word, attempt) if attempt else F.lit(7).cast("bigint")

    monkeypatch.setattr(phrases, "word_hash", poor)
    rows = invented(60, 2)
    assert rows_of(phrases.collocations(documents(spark, rows), 3, 20), PHRASE) == plain_phrases([(r[1], r[0]) for r in rows], 3, 20)
    assert set(tried) == {0, 1}


def test_rows_and_row_groups_of_phrases_are_bounded(spark, monkeypatch):
    """What tasks hold of long texts: a row is a part of a text that ends with a piece, and a file has several row groups."""
    monkeypatch.setattr(phrases, "GROUP_BYTES", 1 << 20, raising=False)
    of = random.Random(8)
    texts = ["".join(f"w{of.randrange(5_000)}{of.choice([' ', ' ', ' ', ', '])}" for _ in range(50_000)) for _ in range(30)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(1)
    table = phrases.hashed(docs, 0)
    rows = [np.frombuffer(r.data, np.uint64) for r in table.where("kind = 0").select("data").collect()]
    assert max(map(len, rows)) < 20_000 and all(r[-1] == 0 for r in rows)
    assert sum(int((r != 0).sum()) for r in rows) == 30 * 50_000
    groups = [file.metadata.row_group(i) for file in map(pq.ParquetFile, (unquote(urlparse(f).path) for f in table.inputFiles())) for i in range(file.metadata.num_row_groups)]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 11_000_000  # before they are compressed


def test_stages_of_phrases_have_one_python_operator(spark, monkeypatch):
    """Else each core keeps two Python workers; what went to all tasks is given free."""
    plans, sent = [], []
    write, give = phrases.write_table, spark.sparkContext.broadcast

    def told(df, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *rest)

    def held(value):
        sent.append(give(value))
        return sent[-1]

    monkeypatch.setattr(phrases, "write_table", told)
    monkeypatch.setattr(spark.sparkContext, "broadcast", held)
    rows = invented(100, 9)
    got = rows_of(phrases.collocations(documents(spark, rows), 5, 40, shard=8, hashes=2), PHRASE)
    assert got == plain_phrases([(r[1], r[0]) for r in rows], 5, 40)
    assert sum("FlatMapGroupsInArrow" in x for x in plans) > 6
    assert not any(re.search(r"MapInArrow[^\n]*\n(\W*(Project|Filter)[^\n]*\n)*\W*(FlatMapGroups|Map)InArrow", x) for x in plans)
    assert len(sent) > 6 and not any(os.path.exists(x._path) for x in sent)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5_000])
def test_perfect_hash(n):
    of = np.random.default_rng(n)
    keys = np.unique(of.integers(0, 1 << 62, n).astype(np.uint64))
    made = phrases.PerfectHash.load(phrases.PerfectHash(keys).dump())
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    assert (made.keys[made.slots(keys)] == keys).all()
    other = np.setdiff1d(of.integers(0, 1 << 62, 1000).astype(np.uint64), keys)
    assert (made.slots(other) == -1).all()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string, rank int, id string, vector int").repartition(4)


@pytest.mark.parametrize("bounds", [{}, {"block_bytes": 4_000, "tile": 16, "sample": 64, "pivots": 5}])
def test_top_k(spark, bounds):
    of = random.Random(4)
    rows = [(i, [of.gauss(0, 0.2) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(60)]
    rows += [(900, None), (920, []), (940, [float("nan"), 1.0]), (960, [float("inf")]), (980, [None, 1.0]), (1000, [0.5, 0.5]), (None, rows[0][1]), (None, rows[20][1]), (20, rows[20][1]), (1020, [0.0] * 6), (-20, [-0.01] * 6)]
    got = topk.top_k(vectors(spark, [(*r, "s", 1, "i", 2) for r in rows]), lambda x: x % 20 == 0, **bounds)
    assert sorted((tuple(r[c] for c in NEIGHBOURS) for r in got.collect()), key=repr) == plain_top_k([(i, v and [np.float32(x) if x is not None else None for x in v]) for i, v in rows], 20, lambda x: x % 20 == 0)


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (7, None)]
    got = topk.top_k(vectors(spark, [(*r, "s", 1, "i", 2) for r in rows]), lambda x: x % 20 == 0)
    assert rows_of(got, NEIGHBOURS) == [(0, 1, 20, 4096), (20, 1, 0, 4096)]
    empty = vectors(spark, []).limit(0)
    assert topk.top_k(empty, lambda x: x % 20 == 0).collect() == []
    with pytest.raises(OverflowError):
        topk.top_k(vectors(spark, [(0, [1e30], "s", 1, "i", 2)]), lambda x: x % 20 == 0).collect()


def test_bounds_eliminate_candidates():
    """On vectors in groups most candidates are not evaluated, and the result is that of all products."""
    of = np.random.default_rng(5)
    x = np.floor(of.normal(0, 40, (8, 16))[of.integers(0, 8, 3000)] + of.normal(0, 2, (3000, 16)))
    points = topk.choose_pivots(x[:500], 24)
    d = topk._distances(x, points).astype(np.float32)
    ids = np.arange(3000)
    q = ids[::50]
    search = topk.Search(x[q], q, d[q], topk.floors(x[q], q, x[:500], ids[:500], 20), 20)
    for start in range(0, 3000, 500):
        own = slice(start, start + 500)
        search.add(x[own], ids[own], ids[own], d[own])
    assert search.evaluated < 0.5 * len(q) * 3000
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :20]
    assert (search.order == want).all()


def test_top_k_of_embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.op12_exact_top_k(spark, sf_dir)
    assert rows_of(got, ["query_id", "rank", "vec_id", "score"]) == sorted(plain_top_k([tuple(r) for r in rows], 20, lambda x: x % 20 == 0))


def test_divergence(spark):
    rows = invented(300, 3) + [("only here " * 3, "en", "alone", *[None] * 7)]
    got = rows_of(divergence.audit(documents(spark, rows)), AUDIT)
    assert got == plain_divergence([r[:3] for r in rows])
    assert {r[2] for r in got} == {"pair", "term"}


def test_divergence_in_small_blocks(spark, monkeypatch):
    """Blocks of one term each, and partial counts that are given on often."""
    rows = invented(120, 6)
    monkeypatch.setattr(divergence, "LEAST_DOCUMENTS", 2)
    batches = [spark.createDataFrame([(t or "", lang or "", s or "") for t, lang, s, *_ in rows], "text string, lang string, source string").selectExpr("cast(text as binary) text", "lang", "source").toArrow().to_batches()[0]]
    whole = Counter()
    monkeypatch.setattr(divergence, "HELD", 5)
    for batch in divergence._counted(iter(batches)):
        for r in batch.to_pylist():
            whole[r["lang"], r["source"], r["term"]] += r["n"]
    plain = Counter()
    for t, lang, s, *_ in rows:
        plain.update((lang or "", s or "", x.translate(LOWER)) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or ""))
    assert {k: v for k, v in whole.items() if k[2] is not None} == plain
    assert rows_of(divergence.audit(documents(spark, rows)), AUDIT) == plain_divergence([r[:3] for r in rows], 2)


def test_odd_and_empty_divergence(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_DOCUMENTS", 2)
    got = rows_of(divergence.audit(odd), AUDIT)
    assert got == plain_divergence([(r.text, r.lang, r.source) for r in odd.select("text", "lang", "source").collect()], 2)
    assert divergence.audit(nothing).collect() == []


def test_divergence_of_documents(spark, docs, sf_dir):
    got = rows_of(queries.op13_source_divergence(spark, sf_dir), AUDIT)
    assert got == plain_divergence([(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()])

import random
import re

import numpy as np
import pytest
import xxhash

from shelfspark.llm import simhash
from shelfspark.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def plain_components(rows):
    """Smallest id reachable, per row; over all pairs of distinct fingerprints."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in rows]


def key(x):
    return tuple(-1 if v is None else v for v in x if not isinstance(v, str)), x[1]


def test_against_all_pairs(docs, odd, nothing):
    for df in (docs, odd):
        want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()])
        got = [tuple(r) for r in simhash.near_duplicates(df).drop(simhash.ROW_ID).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(nothing).count() == 0


def test_representatives(odd, docs, nothing):
    for df in (odd, docs):
        groups = {r.component_id for r in simhash.near_duplicates(df).collect() if r.component_id is not None}
        kept = simhash.representatives(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(groups)
    assert simhash.representatives(nothing).count() == 0


@pytest.mark.parametrize("tile", [7, 100_000])
def test_links_connect_what_all_pairs_connect(spark, tile):
    rng = random.Random(tile)
    found = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            found.add(centre)
            centre ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))})
    fps = sorted(found)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 4, tile)
    got = {r.node: r.component for r in components(edges).collect()}
    for r in edges.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4
    labels = {f: c for (_, _, c), f in zip(plain_components(list(enumerate(fps))), fps, strict=True)}
    mine = {f: got.get(s, s) for f, s in zip(fps, signed, strict=True)}
    assert len({(labels[f], mine[f]) for f in fps}) == len(set(labels.values())) == len(set(mine.values()))


def test_a_dense_group_gives_a_forest():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    masks = {0} | {1 << i | 1 << j for i in range(64) for j in range(i)}
    fps = np.array([int(centre) ^ m for m in masks], np.uint64)
    assert len(list(simhash.tile_links(fps, None, 4))) == len(fps) - 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (2000, 1999), (1999, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1400)} == {1000} and got[2000] == 1999
    assert len(got) == 301 + 400 + 2
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)] if words else [])


def test_verified_representatives_remove_similar_texts(spark, tmp_path, odd, nothing):
    """Near copies more than 4 bits apart go; texts that only their fingerprints link stay; a dense group goes whole."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(120)]
        texts += [" ".join(base), " ".join(base[:60] + [word()] + base[61:]), " ".join(base[:40] + [word()] + base[41:80] + [word()] + base[81:])]
    base = [word() for _ in range(300)]
    texts += [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(60)]
    sets = [shingle_set(x) for x in texts]
    fps = [simhash.fingerprint(x, 5, 42) for x in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            apart = (fps[i] ^ fps[j]).bit_count()
            if apart <= simhash.WIDE and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                wide += apart > 4
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert wide > 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = simhash.verified_representatives(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(r.doc_id for r in got.collect()) == sorted({root(i) for i in range(len(texts))})
    assert simhash.verified_representatives(nothing).count() == 0
    kept = simhash.verified_representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({min(r.doc_id for r in odd.collect() if r.doc_id is not None and shingle_set(r.text) == s) for s in {shingle_set(r.text) for r in odd.where("doc_id is not null").collect()}})

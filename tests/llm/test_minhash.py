"""MinHash near-duplicates: signatures against the weighted similarity, classes against brute force."""
import collections
import random

import numpy as np
import pytest

from recsmith.llm import minhash as M
from recsmith.llm.common import components, read_table


def test_agreement_is_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        same = []
        for _ in range(120):
            n = 300
            both = rng.integers(0, 2 ** 63, int(n * j)).astype(np.uint64)
            a, b = np.split(rng.integers(0, 2 ** 63, n - len(both)).astype(np.uint64), [(n - len(both)) // 2])
            x, y = M.signatures([np.concatenate([both, a]), np.concatenate([both, b])])
            same.append((x == y).mean())
        assert abs(np.mean(same) - j) < 0.02


def test_weighted_agreement():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
    w = rng.uniform(0.2, 6, 200)
    v = np.where(rng.random(200) < 0.3, rng.uniform(0.2, 6, 200), w)
    same = []
    for i in range(80):
        x, y = M.signatures([M.mix(e + np.uint64(i))] * 2, [w, v])
        same.append((x == y).mean())
    assert abs(np.mean(same) - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.02


def test_a_set_alone_or_in_a_batch():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (1, 2, 0, 50, 3000)]
    assert (M.signatures(sets) == np.stack([M.signature(s) for s in sets])).all()
    assert not M.signatures(sets)[2].any()


def brute_classes(rows):
    """{frozenset of row numbers} of (id, text) rows."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i, s in enumerate(sets):
        common = collections.Counter(j for e in s for j in inverted[e])
        for j, n in common.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for e in s:
            inverted[e].append(i)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return [c for c in out.values()]


def assert_classes(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = sorted(sorted(str(rows[i][0]) for i in c) for c in brute_classes(rows))
    got = collections.defaultdict(list)
    found = M.classes(df).collect()
    assert len(found) == len(rows)
    keys = collections.defaultdict(set)
    for r in found:
        k = (r.class_id, None if r.n_class > 1 else (r.doc_id, r.key))
        got[k].append(str(r.doc_id))
        keys[k].add(r.representative)
    singles = [c for c in want if len(c) == 1]
    assert sorted(sorted(c) for c in got.values() if len(c) > 1) == [c for c in want if len(c) > 1]
    assert sum(len(c) for c in got.values() if len(c) == 1) == len(singles)
    assert all(True in x for x in keys.values())


def test_documents(spark, sf):
    assert_classes(read_table(spark, sf, "documents"))


def planted(spark, groups=6, size=25, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, i = [], 0
    for _ in range(groups):
        base = [word() for _ in range(150)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = word()
            rows.append((i, " ".join(t)))
            i += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_near_copies_at_the_border(spark):
    assert_classes(planted(spark))


def test_buckets_in_blocks(spark, monkeypatch):
    """Blocks of a few rows give the same classes."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 4)
    assert_classes(planted(spark, groups=3, size=30, seed=9))


def test_edge_rows(spark, docs, no_docs):
    rows = M.classes(docs).collect()
    assert len(rows) == docs.count()
    kept = M.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text and r.text.split())
    assert len({t for _, t in got}) == len(got) and len(got) == 7
    assert [r.doc_id for r in kept.collect() if r.text and r.text.startswith("the quick")] == [1]
    assert kept.filter("text is null").count() == docs.filter("text is null").count()
    assert M.classes(no_docs).collect() == [] and M.deduplicate(no_docs).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("n", [0, 1, 4, 5, 9])
def test_shingles(n):
    h = np.arange(1, n + 1, dtype=np.uint64)
    assert len(M.shingles(h)) == (0 if n == 0 else 1 if n <= 5 else n - 4)

"""Collocations against a plain count of every phrase."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recsmith.llm import collocations as C


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", text)]


def brute(rows, least=10, swallowed=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in plain_words(text):
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f.update((lang, tuple(ws[i:i + k])) for i in range(len(ws) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    found = []
    for (lang, ws), a in cand.items():
        if len(ws) == 2 and any(100 * b >= swallowed * a for (o, v), b in cand.items() if o == lang and len(v) == 3 and ws in (v[:2], v[1:])):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        found.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    out, rank = [], Counter()
    for lang, s, a, p, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -s))
    return out


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)],
                               "doc_id bigint, text string, lang string, phrase string, words int").repartition(parts)
    return sorted(map(tuple, C.collocations(df, **kw).collect()))


def texts(n, vocabulary=12, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Émile", "日本", "A", "a", "x'y"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", " ", " ", "\x1c"]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 80)))) for _ in range(n)]


def test_equal_to_plain_count(spark):
    rows = texts(120) + [("en", None), (None, ""), ("fr", " \n ,, "), ("en", "a " * 60), ("und", "a a a b a a b")] * 3
    assert run(spark, rows) == sorted(brute(rows))
    assert run(spark, rows, parts=7, least=3, swallowed=80, top=15) == sorted(brute(rows, 3, 80, 15))


def test_very_long_text(spark):
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choice(["of the", "a", "b", "c", f"r{rng.randint(0, 5000)}"]) for _ in range(60_000))), ("en", "of the " * 20)]
    assert run(spark, rows) == sorted(brute(rows))


@pytest.mark.parametrize("rows", [[], [("en", None)], [("en", "one two")], [(None, "x y " * 20)]])
def test_small_tables(spark, rows):
    assert run(spark, rows, parts=1) == sorted(brute(rows))


def test_hot_part_is_looked_up_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "PARTS_PER_TASK", 5)
    rows = [("en", f"the w{i} . w{i} the . the the") for i in range(40) for _ in range(10)]
    assert run(spark, rows) == sorted(brute(rows))


def shard_of(words_list):
    s = C.Shard("en")
    for part in words_list:
        s.add(part)
        s.sort()
    return s


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab c.", max_size=60), max_size=6), st.lists(st.text("abd .", max_size=60), max_size=6), st.integers(1, 5))
def test_union_of_slices_sums_counts(one, two, parts):
    """Transducers cut by prefix range, united, give the counts of all texts; buffers do not matter."""
    want = Counter()
    for t in one + two:
        for ws in plain_words(t):
            for k in (1, 2, 3):
                want.update(" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1))
    unions = {}
    for shard in (shard_of([t.encode() for t in one]), shard_of([t.encode() for t in two])):
        for row in shard.slices(parts):
            unions.setdefault(row["part"], C.Union()).add(row)
    got, total = Counter(), 0
    for u in unions.values():
        u.merge()
        phrases, counts, n = u.paths(1)
        total += n
        for p, a in zip(phrases, counts, strict=True):
            assert p.decode() not in got
            got[p.decode()] = int(a)
    assert got == want
    assert total == sum(a for p, a in want.items() if " " not in p)


def test_equal_runs_of_arcs_are_stored_once():
    state = np.array([0, 0, 1, 1, 3, 4, 4, 5])
    label = np.array([7, 9, 7, 9, 7, 7, 9, 7])
    weight = np.array([1, 2, 1, 2, 1, 1, 3, 1])
    target, begin, labels, weights = C.shared_runs(state, label, weight, 6)
    assert target[2] == -1 and target[0] == target[1] and target[3] == target[5] and len({target[0], target[3], target[4]}) == 3
    assert len(labels) == 5
    for s in range(6):
        if target[s] >= 0:
            at = slice(begin[target[s]], begin[target[s] + 1])
            assert list(labels[at]) == list(label[state == s]) and list(weights[at]) == list(weight[state == s])


def test_composition():
    paths = [("en", "a"), ("en", "a", "b"), ("de", "a"), ("en", "b", "c", "d")]
    t = C.Transducer(paths, np.array([5, 3, 2, 1]))
    asked = [("en", "a", "b"), ("de", "a"), ("en", "b"), ("en", "x"), ("en", "b", "c", "d"), ("fr", "a"), ("en", "a")]
    assert list(t.compose(asked)) == [3, 2, 0, 0, 1, 0, 5]
    assert list(C.Transducer([], np.zeros(0, np.int64)).compose(asked)) == [0] * 7


def test_scores_beyond_64_bits(spark):
    """Products of large counts are exact."""
    a = 3_000_000_000
    from pyspark.sql import functions as F
    d = spark.range(1).select(F.lit(a).alias("a"), F.lit(a + 1).alias("l"), F.lit(a + 7).alias("r"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    num = F.lit(1_000_000).cast("decimal(38,0)") * big("a") * big("a")
    got = d.select(num.alias("num"), (big("l") * big("r")).alias("den")).selectExpr("cast(num div den as bigint) AS s").first().s
    assert got == 1_000_000 * a * a // ((a + 1) * (a + 7))

"""Resampling against a plain computation."""
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from recsmith.llm import resample as R


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def features(text, longest):
    ws = plain_words(text)
    return [" ".join(ws[i:i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for count, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x, longest):
                count[at(f)] += 1
    total_s, total_t = sum(s), sum(t)
    out = []
    for k, x in docs:
        fs = features(x, longest)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in map(at, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[:len(able) * percent // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=str)


def run(spark, docs, target, **kw):
    d = spark.createDataFrame([(k, x, 1, 2, "z") for k, x in docs], "doc_id bigint, text string, rank int, n_words int, score string").repartition(3)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id bigint, text string")
    return sorted(map(tuple, R.resample(d, t, **kw).collect()), key=str)


DOCS = [(i, " ".join(f"w{(i * j) % 37} É{j % 5}" for j in range(i % 30))) for i in range(80)] + [
    (None, "no id " * 30), (None, None), (900, None), (901, ""), (902, " -- "), (903, "A a a. " * 40), (903, "A a a. " * 40), (903, "other words " * 12),
    (904, " ".join(f"long{i % 999}" for i in range(60_000)))]
TARGET = ["w1 w2 w3 a " * 8, None, "", "É1 É2 w7"]


def test_equal_to_plain(spark):
    assert run(spark, DOCS, TARGET) == brute(DOCS, TARGET)


def test_longer_runs_and_other_settings(spark):
    docs = DOCS[:60] + DOCS[80:]
    assert run(spark, docs, TARGET, longest=3, buckets=97, percent=50, least_words=5, seed=7) == brute(docs, TARGET, 3, 97, 50, 5, 7)


@pytest.mark.parametrize(("docs", "target"), [([], []), ([], TARGET), ([(1, None)], TARGET), (DOCS[20:40], [])])
def test_empty_tables(spark, docs, target):
    assert run(spark, docs, target) == brute(docs, target)


@given(st.lists(st.binary(max_size=40), unique=True, max_size=60))
def test_checksums(features):
    assert list(R.crc32s(features)) == [zlib.crc32(f) for f in features]


def test_words_of_any_bytes():
    for text in ("Ab9 c-D\x7f\x80 é x\x1cY", "ÀÉ\tßx_y", "\x0b\x85z"):
        assert [w.decode() for w in R.words_of(text.encode())] == plain_words(text)
    assert R.words_of(None) == []


def test_drawn_rows_follow_the_target(spark):
    """Documents that look like the target are drawn more often."""
    rng = np.random.default_rng(0)
    like, unlike = [f"m{i}" for i in range(50)], [f"z{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choice(like if i % 5 == 0 else unlike, 40))) for i in range(500)]
    target = [" ".join(rng.choice(like, 40)) for _ in range(20)]
    drawn = [k for k, *_, rank in run(spark, docs, target) if rank is not None]
    assert len(drawn) == 50 and all(k % 5 == 0 for k in drawn)

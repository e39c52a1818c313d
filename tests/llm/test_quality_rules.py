"""Quality rules: counts by plain loops, exact binomial bounds, false rejections kept."""
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from recsmith.llm import quality_rules as Q


def counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_counts(spark, docs, no_docs):
    odd = spark.createDataFrame([(i, t, "en") for i, t in enumerate([
        "a b c a b c", "a a a a", "a b a b a b", "x", " lead\n\n\nlead\n lead", "é é é # $", "a\x0bb\x0cc\x85d\xa0e", "w " * 5000])],
        "doc_id bigint, text string, lang string")
    for d in (odd, docs):
        rows = Q.measured_rows(d).select("doc_id", *Q.COUNTS, "base_failed").collect()
        assert sorted(map(tuple, rows), key=str) == sorted(((r.doc_id, *counts(r.text)) for r in d.collect()), key=str)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert Q.judge(no_docs, labels).collect() == [] and Q.keep(no_docs, labels).collect() == []
    kept = Q.keep(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in Q.judge(docs, labels).filter("kept").collect())


@pytest.mark.parametrize("n, risk, delta", [(1, 0.5, 0.6), (100, 0.05, 0.05), (1000, 0.02, 0.01), (4000, 0.004, 0.0005), (500, 0.004, 0.01)])
def test_exact_binomial(spark, n, risk, delta):
    total, best = 0.0, -1
    for k in range(n):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
        if total > delta:
            break
        best = k
    got = spark.range(1).select(Q.most_rejected(F.lit(n).cast("long"), risk, F.lit(delta)).alias("k")).first().k
    assert got == best


def test_risk_holds_and_junk_goes(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(6000):
        lang = rng.choice(["en", "en", "de"])
        bad = rng.random() < 0.2
        symbol = rng.random() < (0.9 if bad else 0.005)
        rows.append((i, lang, False, [60 if symbol else 0, rng.randrange(3), 0, 0, 30]))
        labels.append((i, 0 if bad else 1))
    m = spark.createDataFrame(rows, "doc_id bigint, lang string, base_failed boolean, bins array<int>")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    table = Q.fit(m, lab, Q.Risk(risk=0.1))
    cuts = {r.stratum: {c.rule: c.bin for c in r.cuts} for r in table.collect()}
    assert all(1 <= cuts[x][0] <= 60 for x in ("en", "de"))
    out = m.join(table, m.lang == table.stratum, "left").select("doc_id", Q.rejected(F.col("bins"), F.col("cuts")).alias("gone")).join(lab, "doc_id")
    share = {r.quality: r.s for r in out.groupBy("quality").agg(F.avg(F.col("gone").cast("double")).alias("s")).collect()}
    assert share[1] < 0.05 and share[0] > 0.8
    assert Q.fit(m.filter("doc_id < 100"), lab, Q.Risk()).count() == 0       # too few rows to promise anything


def plain_fit(rows, risk, delta):
    """Path and certificates by loops: {stratum: [(rule, bin)]}."""
    import hashlib
    design = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 3 == 0
    out, strata = {}, sorted({r[1] for r in rows})
    clean = {s: [r[2] for r in rows if r[1] == s and not design(r[0]) and r[3]] for s in strata}
    able = sum(len(c) * math.log1p(-risk) <= math.log(delta) for c in clean.values())
    for s in strata:
        best = []
        for rule in range(len(Q.RULES)):
            gains = [(sum((1 if not r[3] else -Q.CLEAN_WEIGHT) for r in rows if r[1] == s and design(r[0]) and r[2][rule] >= b), b)
                     for b in {r[2][rule] for r in rows if r[1] == s and design(r[0])} if b > 0]
            if gains and max(gains)[0] > 0:
                best.append((-max(gains)[0], rule, max(gains)[1]))
        best.sort()
        n, path = len(clean[s]), [(r, b) for _, r, b in best]
        for j in range(len(path), 0, -1):
            k = sum(any(bins[r] >= b for r, b in path[:j]) for bins in clean[s])
            p = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk))
                    for i in range(k + 1))
            if n and p <= delta / max(1, able):
                out[s] = path[:j]
                break
    return out


def test_path_and_certificates_by_loops(spark):
    """Twenty languages, each a stratum of its own; those with enough clean rows are certified."""
    rng = random.Random(9)
    rows = []
    for i in range(4000):
        lang = rng.choice([f"l{k}" for k in range(20)] + ["big"] * 30)
        bad = rng.random() < 0.3
        rows.append((i, lang, [rng.choice([20, 40, 90]) if rng.random() < (0.6 if bad else 0.002) else rng.randrange(4) for _ in Q.RULES], not bad))
    m = spark.createDataFrame([(k, s, False, b) for k, s, b, _ in rows], "doc_id bigint, lang string, base_failed boolean, bins array<int>")
    lab = spark.createDataFrame([(k, int(c)) for k, _, _, c in rows], "doc_id bigint, quality int")
    for risk, delta in ((0.02, 0.05), (0.2, 0.3)):
        got = {r.stratum: [(c.rule, c.bin) for c in r.cuts] for r in Q.fit(m, lab, Q.Risk(risk, delta)).collect()}
        assert got == plain_fit(rows, risk, delta)
        assert "big" in got and (risk < 0.1 or len(got) > 10)


def test_false_rejections_stay_within_the_risk(spark):
    """Bad and clean rows alike: the promise fails in no more than delta of the tables."""
    broken, tables = 0, 12
    for seed in range(tables):
        rng = random.Random(100 + seed)
        rows = [(i, "en", False, [min(200, int(rng.expovariate(0.05))) for _ in Q.RULES], rng.random() < 0.7) for i in range(1500)]
        m = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, lang string, base_failed boolean, bins array<int>")
        lab = spark.createDataFrame([(r[0], int(r[4])) for r in rows], "doc_id bigint, quality int")
        cuts = [(c.rule, c.bin) for r in Q.fit(m, lab, Q.Risk(0.05, 0.05)).collect() for c in r.cuts]
        fresh = [[min(200, int(rng.expovariate(0.05))) for _ in Q.RULES] for _ in range(5000)]
        broken += sum(any(b[r] >= k for r, k in cuts) for b in fresh) > 0.05 * len(fresh)
    assert broken <= 2


def test_clashing_names(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    names = ["_quality_t", "_quality_w", "_quality_n_words", "_quality_row", "stratum", "cuts", "_cut_row", "_cut_stratum", "bins"]
    more = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    kept = Q.keep(more, labels)
    assert kept.columns == more.columns and kept.count() == Q.keep(docs, labels).count()
    assert all(r[n] == i for r in kept.collect() for i, n in enumerate(names))

"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recsmith.llm import (
    collocations, decontam, html_extract, langid, license_scan, minhash, multi_index, packing, ppm, quality_rules,
    resample, url_filter, warc)
from recsmith.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def keep(fn):
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn
    return keep


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), word_bpe_path())


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
          SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM tri, (SELECT unnest([0, 1, 2]) AS k)
        WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^A-Z!]', '', 'g'))::BIGINT AS n_shout, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             [CASE WHEN word_chars > 0 THEN least({bins}, floor({bins} * n_symbols / word_chars)) ELSE 0 END,
              CASE WHEN word_chars > 0 THEN least({bins}, floor({bins} * n_shout / word_chars)) ELSE 0 END,
              CASE WHEN n_words > 0 THEN least({bins}, floor({bins} * n_repeat_words / n_words)) ELSE 0 END,
              CASE WHEN n_lines > 0 THEN least({bins}, floor({bins} * n_dup_lines / n_lines)) ELSE 0 END,
              CASE WHEN n_words > 0 THEN least({bins}, floor({bins} * word_chars / (32 * n_words))) ELSE 0 END] AS bins
      FROM m),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT f.*, quality FROM f JOIN marks USING (doc_id) WHERE NOT base_failed),
lab2 AS (SELECT lang AS stratum, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 3 = 0 AS design, bins,
                (quality >= 1)::INT AS clean, (quality < 1)::INT AS bad, doc_id FROM lab),
hist AS (SELECT stratum, r - 1 AS rule, bins[r]::BIGINT AS bin, sum(clean) AS clean, sum(bad) AS bad
         FROM lab2, (SELECT unnest([1, 2, 3, 4, 5]) AS r) WHERE design GROUP BY ALL),
gain AS (SELECT *, sum(bad) OVER a - {clean_weight} * sum(clean) OVER a AS gain FROM hist
         WINDOW a AS (PARTITION BY stratum, rule ORDER BY bin DESC)),
best AS (SELECT stratum, rule, bin, gain FROM gain WHERE bin > 0 AND gain > 0
         QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, bin DESC) = 1),
path AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS step FROM best),
held AS (SELECT stratum, count(*) FILTER (clean = 1) AS n FROM lab2 WHERE NOT design GROUP BY stratum),
firsts AS (SELECT doc_id, min(step) AS first FROM lab2 JOIN path USING (stratum) WHERE NOT design AND clean = 1 AND bins[rule + 1] >= path.bin GROUP BY doc_id),
k AS (SELECT path.stratum, path.step, count(firsts.doc_id) AS k FROM path
      LEFT JOIN (firsts JOIN lab2 USING (doc_id)) ON lab2.stratum = path.stratum AND first <= step GROUP BY ALL),
strata AS (SELECT count(*) AS s FROM held WHERE n * ln(1 - {risk}) <= ln({delta})),
terms AS (SELECT stratum, i, exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({risk}) + (n - i) * ln(1 - {risk})) AS p
          FROM (SELECT stratum, n::DOUBLE AS n, unnest(range(0, n::BIGINT)) AS i FROM held WHERE n > 0)),
lim AS (SELECT stratum, max(i) AS most FROM (SELECT stratum, i, sum(p) OVER (PARTITION BY stratum ORDER BY i) AS cdf FROM terms)
        WHERE cdf <= {delta} / greatest(1, (SELECT s FROM strata)) GROUP BY stratum),
cuts AS (SELECT path.* FROM path JOIN k USING (stratum, step) JOIN lim USING (stratum) WHERE k <= most),
bad AS (SELECT DISTINCT doc_id FROM f JOIN cuts ON lang = stratum AND bins[rule + 1] >= cuts.bin)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad)) AS kept
FROM f
""".format(bins=quality_rules.BINS, risk=quality_rules.Risk().risk, delta=quality_rules.Risk().delta,
           clean_weight=quality_rules.CLEAN_WEIGHT)


@query("op5_quality_rules", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(ws[s:s + n - 1], ' ') AS span FROM (
          SELECT item, ws, least(len(ws), 13) AS n, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS s
          FROM iw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spans AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS span FROM (
            SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM dw, lens WHERE len(ws) >= n)),
hits AS (SELECT doc_id, n, s, item FROM spans JOIN win USING (n, span)),
cov AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM (
          SELECT DISTINCT doc_id, s, unnest(range(0, n)) AS k FROM (SELECT DISTINCT doc_id, n, s FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op6_decontamination", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"),
                                  read_table(spark, sf_dir, "benchmark")).drop("_id", "_key")


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


@query("op1_minhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read_table(spark, sf_dir, "documents")).drop("key")


@query("op8_lm_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, upper(sha1(t)) AS hex, min(page_id) OVER (PARTITION BY t) AS first_id FROM p),
b AS (SELECT *, [('0x' || hex[10 * k + 1:10 * k + 10])::BIGINT FOR k IN [0, 1, 2, 3]] AS v FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string([substr('{base32}', (((v[(j // 8 + 1)::INT] >> (35 - 5 * (j % 8))) & 31) + 1)::INT, 1)
                        FOR j IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
""".format(base32=warc.BASE32)


@query("op4_warc", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


@query("op7_url_filter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    labelled = url_filter.labels_of_pages(pages, read_table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, labelled).drop("mined")


@query("op10_html_extract")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


OP11_SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS uid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
one AS (SELECT len(e) AS d FROM good GROUP BY d ORDER BY count(*) DESC, d LIMIT 1),
g AS (SELECT uid, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM good WHERE len(e) = (SELECT d FROM one)),
link AS (SELECT a.uid AS a, b.uid AS b, b.vec_id AS id FROM g a JOIN g b ON a.uid <> b.uid
         AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {similarity}),
reach AS (SELECT uid AS a, uid AS b FROM g UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS uid, min(g.vec_id) AS component_id FROM reach JOIN g ON g.uid = reach.b GROUP BY a),
n AS (SELECT a AS uid, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, CASE WHEN g.uid IS NULL THEN vec_id ELSE component_id END AS component_id,
       (vec_id IS NOT DISTINCT FROM CASE WHEN g.uid IS NULL THEN vec_id ELSE component_id END) AS kept
FROM v LEFT JOIN (SELECT uid FROM g) g USING (uid) LEFT JOIN comp USING (uid) LEFT JOIN n USING (uid)
""".format(similarity=multi_index.SIMILARITY)


@query("op11_embedding_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (
        SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
          SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k))
      GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {least}),
cut AS (SELECT lang, phrase, a, m, array_to_string(ws[1:m], ' ') AS lp, array_to_string(ws[m + 1:], ' ') AS rp
        FROM (SELECT *, unnest(range(1, k)) AS m FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.a, m, x.a AS l, y.a AS r,
             ((1000000::HUGEINT * cut.a * cut.a) // (x.a::HUGEINT * y.a::HUGEINT))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) = 1),
inside AS (SELECT lang, phrase, max(a) AS around FROM (
             SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3)
           GROUP BY ALL),
kept AS (SELECT low.*, n FROM low JOIN n USING (lang) LEFT JOIN inside USING (lang, phrase)
         WHERE around IS NULL OR 100 * around < {swallowed} * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= {top}
""".format(least=10, swallowed=50, top=2000)


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), least=10, swallowed=50, top=2000)


OP13_SQL = r"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
                         ORDER BY i) AS t FROM (SELECT unnest(range(0, 256)) AS i)),
dw AS (SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT uid, w, count(*) AS c FROM (SELECT uid, unnest(ws) AS w FROM dw) GROUP BY ALL),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM bw)),
bucket AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], [('0x' || x[2 * j + 1:2 * j + 2])::BIGINT FOR j IN range(len(x) // 2)]),
                  lambda crc, byte: xor(t[(xor(crc, byte) & 255) + 1], crc >> 8)), 4294967295) % {buckets} AS b FROM words, tab),
s AS (SELECT b, sum(c) AS n FROM f JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN bucket USING (w) GROUP BY b),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gain AS (SELECT s.b, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (tot.s + {buckets})) / ((s.n + 1)::DOUBLE * (tot.t + {buckets}))))::BIGINT AS g
         FROM s LEFT JOIN t USING (b), tot),
weight AS (SELECT uid, sum(c * g)::BIGINT AS weight FROM f JOIN bucket USING (w) JOIN gain USING (b) GROUP BY uid),
sc AS (SELECT doc_id, uid, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
              coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                     / 4294967296.0::DOUBLE)))::BIGINT AS score
       FROM dw LEFT JOIN weight USING (uid)),
able AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= {least})
SELECT doc_id, n_features, weight, score, (CASE WHEN rank <= (n * {percent}) // 100 THEN rank END)::BIGINT AS rank FROM sc LEFT JOIN able USING (uid)
""".format(buckets=resample.BUCKETS, seed=resample.SEED, least=resample.LEAST_WORDS, percent=resample.PERCENT)


@query("op13_resample", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

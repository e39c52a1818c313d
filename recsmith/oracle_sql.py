"""Independent DuckDB SQL for the correctness gate.

The generated tables are pre-registered as views; these builders write the
same adapters as ``sources.testdata`` in SQL, as CTE text.
"""

from __future__ import annotations

K_EXPR = "CAST(json_extract_string(e.props, '$.k') AS INTEGER)"


def ix_cte(name: str = "ix", text: bool = False, vec: bool = False, pics: bool = False,
           hist: bool = False, pname: bool = False) -> str:
    cols = [
        "e.event_id AS row_id",
        f"""CASE WHEN e.user_id % 20 = 7 OR e.event_id % 10 = 9 THEN 'test'
                 WHEN {K_EXPR} % 25 = 3 OR e.event_id % 10 = 8 THEN 'val' ELSE 'train' END AS split""",
        f"'b' || CAST({K_EXPR} AS VARCHAR) AS business_id",
        "'u' || CAST(e.user_id AS VARCHAR) AS user_id",
        """CAST(CASE WHEN e.value < 11 THEN 1 WHEN e.value < 25 THEN 2 WHEN e.value < 46 THEN 3
                 WHEN e.value < 80 THEN 4 ELSE 5 END AS INTEGER) AS rating""",
    ]
    joins = []
    if text:
        cols.append("d.text AS review_text")
        joins.append("LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)")
    if vec:
        cols.append("v.embedding AS text_emb")
        joins.append("LEFT JOIN embeddings v ON v.vec_id = e.event_id % (SELECT count(*) FROM embeddings)")
    if pics:
        n = "(SELECT count(*) FROM embeddings)"
        slots = ", ".join(f"'p' || CAST((e.event_id * 7 + {i}) % {n} AS VARCHAR)" for i in range(3))
        cols.append(f"list_slice([{slots}], 1, CAST(e.event_id % 4 AS INTEGER)) AS pics")
    if hist:
        cols.append("CAST([] AS VARCHAR[]) AS history_reviews")
    if pname:
        cols.append("pt.p_name AS name")
        joins.append(f"LEFT JOIN part pt ON pt.p_partkey = {K_EXPR}")
    return f"{name} AS (SELECT {', '.join(cols)} FROM events e {' '.join(joins)})"


def records_cte(name: str = "rec") -> str:
    return ix_cte(name, text=True, pics=True, hist=True, pname=True)


def flawed_cte(name: str = "rec") -> str:
    """The raw feed with its flaws (FIXTURES.md)."""
    return ix_cte("clean", text=True, pics=True, pname=True) + f""", {name} AS (
      SELECT row_id, split,
             CASE WHEN row_id % 101 = 7 THEN '' WHEN row_id % 97 = 5 THEN NULL ELSE business_id END AS business_id,
             CASE WHEN row_id % 113 = 11 THEN '' WHEN row_id % 89 = 3 THEN NULL ELSE user_id END AS user_id,
             CASE WHEN row_id % 79 = 2 THEN 9 WHEN row_id % 83 = 1 THEN NULL ELSE rating END AS rating,
             CASE WHEN row_id % 83 = 1 THEN '' WHEN row_id % 71 = 4 THEN NULL ELSE review_text END AS review_text,
             CASE WHEN row_id % 61 = 6 THEN list_append(pics, '') ELSE pics END AS pics,
             CASE WHEN row_id % 67 = 9 THEN list_append(list_transform(range(1, row_id % 3 + 2), lambda i: 'visit ' || i), '')
                  WHEN row_id % 5 = 0 THEN list_transform(range(1, row_id % 3 + 2), lambda i: 'visit ' || i)
                  ELSE CAST([] AS VARCHAR[]) END AS history_reviews,
             CASE WHEN row_id % 59 = 8 THEN NULL ELSE name END AS name
      FROM clean)"""


def ratings_large_cte(name: str = "rl") -> str:
    return f"""{name} AS (
      SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice,
             CASE WHEN l.l_orderkey % 10 = 9 THEN 'test' WHEN l.l_orderkey % 10 = 8 THEN 'val' ELSE 'train' END AS split,
             'b' || CAST(l.l_partkey AS VARCHAR) AS business_id,
             'u' || CAST(o.o_custkey AS VARCHAR) AS user_id,
             CAST(1 + floor((l.l_quantity - 1) / 10) AS INTEGER) AS rating
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def stats_ctes(src: str = "ix", prefix: str = "") -> str:
    """mu, user stats (us), item stats (ist) on the train split of ``src``."""
    p = prefix
    return f"""{p}mu AS (SELECT avg(rating) AS mu FROM {src} WHERE split = 'train'),
      {p}us AS (SELECT user_id, avg(rating) - (SELECT mu FROM {p}mu) AS user_bias,
                   CAST(count(*) AS INTEGER) AS user_hist_len
               FROM {src} WHERE split = 'train' AND user_id IS NOT NULL GROUP BY user_id),
      {p}ist AS (SELECT business_id, avg(rating) - (SELECT mu FROM {p}mu) AS item_bias,
                   CAST(count(*) AS INTEGER) AS item_hist_len
               FROM {src} WHERE split = 'train' AND business_id IS NOT NULL GROUP BY business_id)"""


def metadata_cte(name: str = "md", rec: str = "rec") -> str:
    """first record per business (train, val, test, then row_id)."""
    return f"""{name} AS (
      SELECT business_id,
             coalesce(nullif(name, ''), 'Business ' || business_id) AS name,
             CASE WHEN pics[1] IS NOT NULL AND pics[1] <> '' THEN '/media/images/' || pics[1] || '.jpg' END AS image_url,
             CAST(rating AS DOUBLE) AS avg_rating,
             CAST(NULL AS BIGINT) AS num_reviews
      FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY
                 CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, row_id) AS rn
            FROM {rec} WHERE business_id IS NOT NULL AND business_id <> '') WHERE rn = 1)"""


def pool_cte(name: str = "pool", src: str = "ix", col: str = "text_emb") -> str:
    """per business, per position mean of a vector column (long form)."""
    return f"""{name} AS (
      SELECT business_id, pos, avg(CAST(v AS DOUBLE)) AS v FROM (
        SELECT business_id, unnest({col}) AS v, unnest(generate_series(1, len({col}))) AS pos
        FROM {src} WHERE business_id IS NOT NULL) GROUP BY business_id, pos)"""


def queries_cte(name: str = "q") -> str:
    return f"""{name} AS (
      SELECT vec_id AS query_id,
             CAST(coalesce(CASE vec_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 50 END, 10) AS INTEGER) AS k,
             CASE vec_id % 3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 1.0 END AS w_joint,
             CASE vec_id % 3 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 ELSE 10.0 END AS w_text
      FROM embeddings)"""


def qvec_cte(name: str = "qv") -> str:
    return f"""{name} AS (SELECT vec_id AS query_id, CAST(unnest(embedding) AS DOUBLE) AS v,
                 unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)"""


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# fixed values: tags, and the entities that the pages contain, for the SQL side
_SQL_TAG = r"""(?s)<[!/?a-zA-Z][^>=]*(?:=(?:\s*(?:"[^"]*"|'[^']*'))?[^>=]*)*>"""
_SQL_ENTITIES = [("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&nbsp", "\u00a0"), ("&copy", "©"), ("&middot", "·"), ("&amp", "&")]


def clean_sql(expr: str) -> str:
    """clean_html_text in DuckDB SQL. Entities: those that occur in the tables,
    with or without the semicolon (tests hold the others against written values)."""
    from recsmith.functions import text as TX
    x = f"coalesce({expr}, '')"
    for r in [TX.COMMENT_RE, *TX.BLOCK_RES, _SQL_TAG]:
        x = f"regexp_replace({x}, {_sql_str(r)}, ' ', 'g')"
    x = f"replace({x}, '&#39;', chr(39))"
    for ent, ch in _SQL_ENTITIES:
        x = f"replace(replace({x}, '{ent};', {_sql_str(ch)}), '{ent}', {_sql_str(ch)})"
    return f"lower(trim(regexp_replace({x}, {_sql_str(TX.WS_CLASS)}, ' ', 'g')))"


def sentiment_ctes(src: str, key: str, cleaned: str, out: str = "sent") -> str:
    """CTE ``out``(key, sentiment) over table ``src`` with a cleaned text column."""
    from recsmith.functions import text as TX
    from recsmith.sources import testdata as td
    lex = ", ".join(f"({_sql_str(k)}, {float(v)!r})" for k, v in td.LEXICON)
    neg = ", ".join(f"({_sql_str(n)})" for n in td.NEGATIONS)
    bst = ", ".join(f"({_sql_str(k)}, {float(v)!r})" for k, v in td.BOOSTERS)
    return f"""{out}_lex(token, valence) AS (VALUES {lex}),
      {out}_neg(token) AS (VALUES {neg}),
      {out}_bst(token, b) AS (VALUES {bst}),
      {out}_tk AS (SELECT k, regexp_replace(t, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS t, pos FROM (
          SELECT {key} AS k, unnest(string_split({cleaned}, ' ')) AS t,
                 unnest(generate_series(1, len(string_split({cleaned}, ' ')))) AS pos
          FROM {src} WHERE {cleaned} <> '')),
      {out}_tl AS (SELECT k, t, lag(t, 1) OVER w AS p1, lag(t, 2) OVER w AS p2, lag(t, 3) OVER w AS p3
          FROM {out}_tk WINDOW w AS (PARTITION BY k ORDER BY pos)),
      {out}_tv AS (SELECT tl.k, coalesce(l.valence, 0.0) AS v0, coalesce(b.b, 0.0) AS b,
          coalesce(tl.p1 IN (SELECT token FROM {out}_neg), false) OR coalesce(tl.p2 IN (SELECT token FROM {out}_neg), false)
          OR coalesce(tl.p3 IN (SELECT token FROM {out}_neg), false) AS negated
          FROM {out}_tl tl LEFT JOIN {out}_lex l ON l.token = tl.t LEFT JOIN {out}_bst b ON b.token = tl.p1),
      {out}_s AS (SELECT k, sum(CASE WHEN negated THEN v1 * {TX.NEGATION_SCALAR} ELSE v1 END) AS s FROM (
          SELECT k, negated, CASE WHEN v0 <> 0 THEN v0 + sign(v0) * b ELSE v0 END AS v1 FROM {out}_tv) GROUP BY k),
      {out} AS (SELECT x.{key} AS {key},
          CASE WHEN s.s IS NULL THEN 0.0 ELSE greatest(-1.0, least(1.0, s.s / sqrt(s.s * s.s + {TX.COMPOUND_ALPHA}))) END AS sentiment
          FROM {src} x LEFT JOIN {out}_s s ON s.k = x.{key})"""


def per_user_metrics_sql(src: str, by: list[str], tiebreak: list[str], ks=(5, 10, 20),
                         splits=("val", "test")) -> str:
    """SELECT of (by..., user_id, k, precision, recall, ndcg) over a scored
    table ``src`` (columns by..., user_id, rating, score, tiebreak...)."""
    g = ", ".join(by + ["user_id"]) if by else "user_id"
    part = ", ".join(by + ["user_id"])
    tb = ", ".join(tiebreak)
    ks_list = ", ".join(str(k) for k in ks)
    spl = ", ".join(f"'{s}'" for s in splits)
    return f"""
      SELECT {g}, CAST(k AS INTEGER) AS k, hits / k AS precision, hits / num_pos AS recall,
             CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg
      FROM (
        SELECT {g}, k, max(num_pos) AS num_pos,
               sum(CASE WHEN rk <= k AND is_pos = 1 THEN 1 ELSE 0 END) AS hits,
               sum(CASE WHEN rk <= k AND is_pos = 1 THEN 1.0 / log2(rk + 1) ELSE 0.0 END) AS dcg,
               list_sum(list_transform(range(1, CAST(least(k, max(num_pos)) AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1))) AS idcg
        FROM (
          SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY CASE WHEN score IS NULL OR isnan(score) THEN 1 ELSE 0 END,
                                       score DESC, {tb}) AS rk,
                 sum(is_pos) OVER (PARTITION BY {part}) AS num_pos
          FROM (SELECT *, CASE WHEN rating >= 4.0 THEN 1 ELSE 0 END AS is_pos FROM {src}
                WHERE split IN ({spl}) AND user_id IS NOT NULL)
        ) CROSS JOIN (SELECT unnest([{ks_list}]) AS k)
        WHERE num_pos > 0
        GROUP BY {g}, k)"""


def metrics_mean_sql(src: str, by: list[str], tiebreak: list[str], ks=(5, 10, 20), splits=("val", "test")) -> str:
    g = ", ".join(by + ["k"])
    return f"""SELECT {g}, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
                 round(avg(ndcg), 6) AS ndcg, count(*) AS n_users
               FROM ({per_user_metrics_sql(src, by, tiebreak, ks, splits)}) GROUP BY {g}"""

"""Embedding near-duplicates by an inverted multi-index.

Vectors are cut into two halves, each half has its own codebook (k-means on a
bounded sample), and the product of the codebooks is a grid of cells. A vector
is filed under its home cell and visits the cells nearest to it in the order of
the multi-sequence walk, by the sum of its two distances, its home first. The
walk stops when the sum exceeds the home's by ``reach``. ``reach`` is calibrated
until a target recall holds twice: on the links of sampled queries against all
rows, and on planted pairs that stand exactly at the similarity threshold.

Every cell compares its visitors with its members in blocks of bounded rows,
from 8-bit codes whose exact error is known. A pair whose code similarity
decides it for certain is counted inside the task; only the doubtful band is
sent out, and verified on the vectors in double precision. A pair that meets in
two cells is counted in one. What leaves a task is a count per vector and a
spanning forest of its links, never the list of all pairs. A cell of any size is
split into blocks over many tasks; nothing is capped.

Rows with the same vector are folded before (by 128 bits of hash): one of them
is compared, and all count.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, as do those whose length is not the most frequent
one (of several, the smallest); a null vec_id takes part like any other and is
never a component's id unless all ids in it are null; repeated rows are vectors
of their own, linked with each other; ``kept`` holds for every row whose id is
the component's id (so for repeated rows for each of them); an empty table gives
an empty table; other columns are ignored, whatever their names. Ties of
distances go to the smaller cell.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsmith.llm.common import components, materialize

SIMILARITY = 0.9
#: Documented bounds of the fit: rows the codebooks learn from, queries of the calibration.
SAMPLE, QUERIES = 20_000, 512
CELL_ROWS, MAX_CODES = 1024, 1024
TARGET, TARGET_EDGE = 0.999, 0.9
BLOCK = 2048
BINS, BIN = 4096, 1 / 1024
SEED = 17


@dataclass(frozen=True)
class Grid:
    """Two codebooks and the calibrated reach of the walk."""
    left: np.ndarray
    right: np.ndarray
    reach: float = 0.0

    @property
    def dim(self) -> int:
        return self.left.shape[1] + self.right.shape[1]

    def excess(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to its codes, beyond the nearest one's."""
        cut = self.left.shape[1]
        out = []
        for x, c in ((unit[:, :cut], self.left), (unit[:, cut:], self.right)):
            d = (c ** 2).sum(1)[None, :] - 2 * x @ c.T
            out.append(d - d.min(1, keepdims=True))
        return out[0], out[1]

    def homes(self, e1: np.ndarray, e2: np.ndarray) -> np.ndarray:
        return e1.argmin(1) * len(self.right) + e2.argmin(1)

    def visits(self, e1: np.ndarray, e2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of all cells within reach. Both lists of distances are
        walked in rising order: the cells are the start of each vector's
        multi-sequence, up to the reach."""
        o1, o2 = np.argsort(e1, 1, kind="stable"), np.argsort(e2, 1, kind="stable")
        s1, s2 = np.take_along_axis(e1, o1, 1), np.take_along_axis(e2, o2, 1)
        who, cell = [], []
        for i in range(s1.shape[1]):
            on = np.flatnonzero(s1[:, i] <= self.reach)
            if not len(on):
                break
            row, j = np.nonzero(s1[on, i][:, None] + s2[on] <= self.reach)
            who.append(on[row])
            cell.append(o1[on[row], i] * len(self.right) + o2[on[row], j])
        who, cell = np.concatenate(who), np.concatenate(cell)
        order = np.lexsort((cell, who))
        return who[order], cell[order]


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """k centres of the rows of ``x``; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = ((c ** 2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are usable (``dim`` numbers, all finite, not
    all zero), and those rows as a matrix."""
    sized = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    m = column.take(pa.array(sized)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ok = np.isfinite(m).all(1) & (m != 0).any(1)
    return sized[ok], m[ok]


def units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True, initial=0)        # squares of very large and small numbers
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes, their scales, and the exact distance of each vector from its code."""
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(unit - code * scale[:, None], axis=1)


def common_length(rows: DataFrame) -> int:
    """The most frequent length of the vectors; of several the smallest."""
    n = F.size("vector")
    best = (rows.filter(n > 0).groupBy(n.alias("dim")).count()
            .agg(F.max(F.struct("count", (-F.col("dim")).alias("dim"))).alias("x")).first().x)
    return -best.dim if best else 0


def fit(rows: DataFrame, dim: int, similarity: float = SIMILARITY) -> Grid:
    """Codebooks from a bounded sample of the rows, and the reach."""
    sized = rows.filter(F.size("vector") == dim).select("vector")
    n = sized.count()
    x = np.zeros((0, dim))
    for some in (sized.sample(fraction=min(1.0, 1.1 * SAMPLE / max(n, 1)), seed=SEED), sized):
        if not len(x) and (got := some.limit(SAMPLE).toArrow()).num_rows:
            x = units(matrix(got["vector"].combine_chunks(), dim)[1])
    if not len(x):
        return Grid(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))
    k = int(np.clip(round((n / CELL_ROWS) ** 0.5), 2, MAX_CODES))
    grid = Grid(kmeans(x[:, :dim // 2], k), kmeans(x[:, dim // 2:], k, seed=SEED + 1))
    queries = x[np.random.default_rng(SEED).permutation(len(x))[:QUERIES]]
    edge = np.quantile(_needed(grid, queries, _planted(queries, similarity)), TARGET_EDGE) if dim > 1 else 0.0
    return replace(grid, reach=float(max(edge, _calibrated(sized, grid, queries, similarity))))


def _planted(x: np.ndarray, similarity: float) -> np.ndarray:
    """A vector at exactly the similarity from each row, in a random direction."""
    z = np.random.default_rng(SEED + 2).standard_normal(x.shape)
    z = units(z - (z * x).sum(1, keepdims=True) * x)
    return similarity * x + (1 - similarity ** 2) ** 0.5 * z


def _needed(grid: Grid, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The reach at which one of the pair (a, b), row by row, visits the other's home."""
    (a1, a2), (b1, b2), at = grid.excess(a), grid.excess(b), np.arange(len(a))
    there = a1[at, b1.argmin(1)] + a2[at, b2.argmin(1)]
    back = b1[at, a1.argmin(1)] + b2[at, a2.argmin(1)]
    return np.minimum(there, back)


def _calibrated(rows: DataFrame, grid: Grid, queries: np.ndarray, similarity: float) -> float:
    """The reach that finds TARGET of the links of the sampled queries with all
    rows: on average, each query counting once, and for 99 of 100 queries. The
    driver gets a row per query and bin."""
    dim = grid.dim

    def run(batches):
        for batch in batches:
            y = units(matrix(batch.column("vector"), dim)[1])
            rows = []
            for k in range(0, len(y), 4096):
                s = y[k:k + 4096] @ queries.T
                i, q = np.nonzero((s >= similarity) & (s < 1 - 1e-12))
                if len(i):
                    need = np.minimum(_needed(grid, queries[q], y[k + i]) / BIN, BINS - 1).astype(np.int64)
                    rows.append(q * BINS + need)
            key, count = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count, pa.int64())], names=["key", "n"])

    hist = rows.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    if not len(hist):
        return 0.0
    q, b, n = hist.key.to_numpy() // BINS, hist.key.to_numpy() % BINS, hist.n.to_numpy()
    _, row = np.unique(q, return_inverse=True)
    found = np.zeros((row.max() + 1, BINS))
    found[row, b] = n
    found = np.cumsum(found, 1) / found.sum(1, keepdims=True)
    most = np.argmax(found >= TARGET, 1)                        # of each query
    enough = max(np.quantile(most, 0.99, method="higher"), np.searchsorted(found.mean(0), TARGET))
    return float((enough + 1) * BIN)


def place(rows: DataFrame, grid: Grid) -> DataFrame:
    """vec_id, h1, h2, home, visits, code, scale, off of (vec_id, vector) rows;
    home is null for a vector that links with nothing."""
    dim = grid.dim

    def run(batches):
        for batch in batches:
            fine, m = matrix(batch.column("vector"), dim)
            unit = units(m)
            e1, e2 = grid.excess(unit)
            who, cell = grid.visits(e1, e2) if len(unit) else (np.zeros(0, int),) * 2
            n = batch.num_rows
            mask = np.ones(n, bool)
            mask[fine] = False
            cut = np.searchsorted(fine[who] if len(fine) else who, np.arange(n + 1))
            full = lambda x, kind: np.put(out := np.zeros(n, kind), fine, x) or out
            code, scale, off = encode(unit) if len(unit) else (np.zeros((0, dim), np.int8), np.zeros(0), np.zeros(0))
            codes = np.full(n, b"", object)
            codes[fine] = [c.tobytes() for c in code]
            home = grid.homes(e1, e2) if len(unit) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("h1"), batch.column("h2"), pa.array(full(home, np.int32), pa.int32(), mask=mask),
                 pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(cell, pa.int32())), pa.array(codes, pa.binary()),
                 pa.array(full(scale, float)), pa.array(full(off, float))],
                names=["vec_id", "h1", "h2", "home", "visits", "code", "scale", "off"])

    keyed = rows.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2"))
    return keyed.mapInArrow(run, "vec_id bigint, h1 bigint, h2 bigint, home int, visits array<int>, code binary, scale double, off double")


def _block(table: pa.Table, similarity: float) -> pa.Table:
    """Counts (0), forest edges (1) and doubtful pairs (2) of a cell's block."""
    role = table["role"].to_numpy()
    t, v = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    uid, home, w = (table[c].to_numpy() for c in ("uid", "home", "w"))
    scale, off = table["scale"].to_numpy(), table["off"].to_numpy()
    code = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(uid), -1)
    code = code.astype(np.float32 if code.shape[1] <= 1024 else np.float64)      # sums of products are exact
    homes, of = np.unique(home[v], return_inverse=True)
    back = np.zeros((len(homes), len(t)), bool)              # whether a member visits a visitor's home
    visits = table["visits"].combine_chunks().take(pa.array(t))
    cell, at = visits.flatten().to_numpy(), np.repeat(np.arange(len(t)), visits.value_lengths().to_numpy())
    known = np.searchsorted(homes, cell)
    ok = (known < len(homes)) & (homes[np.minimum(known, len(homes) - 1)] == cell)
    back[known[ok], at[ok]] = True

    count = np.zeros(len(uid), np.int64)
    links, doubts = [], []
    for k in range(0, len(v), 512):
        q = v[k:k + 512]
        sim = (code[q] @ code[t].T) * (scale[q][:, None] * scale[t][None, :])
        err = off[q][:, None] + off[t][None, :] + off[q][:, None] * off[t][None, :] + 1e-9
        other = uid[q][:, None] != uid[t][None, :]
        sure = other & (sim - err >= similarity)
        both = back[of[k:k + 512]]
        count[q] += (sure * w[t][None, :]).sum(1)
        np.add.at(count, t, ((sure & ~both) * w[q][:, None]).sum(0))
        i, j = np.nonzero(sure)
        links.append((q[i], t[j]))
        i, j = np.nonzero(other & ~sure & (sim + err >= similarity) & (~both | (uid[q][:, None] < uid[t][None, :])))
        doubts.append((q[i], t[j]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, int),) * 2
    label = uid.copy()
    while len(a):                                             # smallest id along the links
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            break
        label = new
    some, far = np.flatnonzero(count), np.flatnonzero(label != uid)
    x, y = (uid[np.concatenate(p)] for p in zip(*doubts, strict=True)) if doubts else (np.zeros(0, np.int64),) * 2
    return pa.table({"kind": pa.array(np.repeat([0, 1, 2], [len(some), len(far), len(x)]), pa.int32()),
                     "a": pa.array(np.concatenate([uid[some], uid[far], x]), pa.int64()),
                     "b": pa.array(np.concatenate([count[some], label[far], y]), pa.int64())})


def compare(placed: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(kind, a, b) rows of all cells. ``placed``: the distinct rows of ``place``
    with ``uid`` and ``w``, the number of rows that a vector stands for."""
    to = placed.select("uid", "home", F.explode("visits").alias("cell"))
    size = to.groupBy("cell").agg(F.count("*").alias("v"), F.sum((F.col("cell") == F.col("home")).cast("int")).alias("t"))
    size = size.filter("t > 0").select("cell", F.ceil(F.greatest("v", "t") / F.lit(block)).cast("int").alias("parts"))
    keep = ["uid", "home", "code", "scale", "off", "w"]
    rows = placed.select(*keep, "visits", F.explode("visits").alias("cell")).join(size, "cell").withColumn(
        "own", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    mine, alone = F.col("home") == F.col("cell"), F.col("parts") == 1
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    put = lambda role, ps: F.transform(ps, lambda p: F.struct(
        F.lit(role).alias("role"), (F.col("own") if role == 0 else p).alias("tp"), (p if role == 0 else F.col("own")).alias("vp")))
    one = F.array(F.struct(F.when(mine, 2).otherwise(1).alias("role"), F.lit(0).alias("tp"), F.lit(0).alias("vp")))
    sent = F.when(alone, one).when(mine, F.concat(put(0, all_parts), put(1, all_parts))).otherwise(put(1, all_parts))
    rows = rows.select(*keep, "cell", F.when(mine, F.col("visits")).otherwise(F.array().cast("array<int>")).alias("visits"),
                       F.explode(sent).alias("to")).select(*keep, "cell", "visits", "to.*")
    return rows.groupBy("cell", "tp", "vp").applyInArrow(
        lambda table: _block(table, similarity), "kind int, a bigint, b bigint")


def _verified(doubts: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """The doubtful pairs (a, b) that are linked, by cosine in double precision."""
    side = lambda c: vectors.select(F.col("uid").alias(c), F.col("vector").alias(f"{c}_v"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    both = doubts.join(side("a"), "a").join(side("b"), "b")
    cos = dot("a_v", "b_v") / (F.sqrt(dot("a_v", "a_v")) * F.sqrt(dot("b_v", "b_v")))
    return both.filter(cos >= similarity).select("a", "b")


def near_duplicates(embeddings: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id",
                    vector_col: str = "embedding", grid: Grid | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                             F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    dim = grid.dim if grid else common_length(rows)
    if not dim:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    every = materialize(place(rows, grid or fit(rows, dim, similarity)), "vectors-placed")
    # rows with one vector are folded; uid numbers the distinct vectors
    same = [F.first(c).alias(c) for c in ("home", "visits", "code", "scale", "off")]
    folded = every.filter("home is not null").groupBy("h1", "h2").agg(F.count("*").alias("w"), F.min("vec_id").alias("lead"), *same)
    folded = materialize(folded.select(F.monotonically_increasing_id().alias("uid"), "*"), "vectors-folded")
    found = materialize(compare(folded.drop("h1", "h2", "lead"), similarity, block), "vector-links")

    doubts = found.filter("kind = 2").select("a", "b").distinct()
    wanted = doubts.select(F.explode(F.array("a", "b")).alias("uid")).distinct().join(folded.select("uid", "h1", "h2"), "uid")
    vectors = (rows.select("vector", F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2"))
               .join(wanted, ["h1", "h2"]).groupBy("uid").agg(F.first("vector").alias("vector")))
    sure = materialize(_verified(doubts, vectors, similarity), "vectors-verified")
    w = folded.select("uid", "w")
    counts = found.filter("kind = 0").select(F.col("a").alias("uid"), F.col("b").alias("n"))
    for x, y in (("a", "b"), ("b", "a")):
        counts = counts.unionByName(sure.join(w.withColumnRenamed("uid", y), y).select(F.col(x).alias("uid"), F.col("w").alias("n")))
    counts = counts.groupBy("uid").agg(F.sum("n").alias("n"))
    roots = components(found.filter("kind = 1").select("a", "b").unionByName(sure)).withColumnRenamed("id", "uid")
    known = folded.select("uid", "h1", "h2", "w", "lead").join(roots, "uid", "left").join(counts, "uid", "left").select(
        "h1", "h2", "lead", F.coalesce("root", "uid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"))
    known = materialize(known, "vectors-known")
    ids = known.groupBy("root").agg(F.min("lead").alias("component_id"))
    known = known.join(ids, "root").select("h1", "h2", "n", "component_id")
    out = every.select("vec_id", "h1", "h2", "home").join(known, ["h1", "h2"], "left")
    alone = F.col("home").isNull()
    out = out.select("vec_id", F.when(alone, 0).otherwise(F.col("n")).cast("long").alias("n_links"),
                     F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

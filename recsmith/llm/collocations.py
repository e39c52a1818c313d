"""Phrase collocations by weighted acyclic automata.

A shard (the rows of a scan task, up to a bounded number of words) counts its
n-grams as sorted integer keys and builds from them a count transducer: an
acyclic automaton whose paths are phrases and whose arcs carry how often the
phrase up to there occurs. Runs of equal arcs (same words, same weights) are
stored once and shared by all states that have them. The transducer is cut into
slices by range of the hashed two-word prefix, so that a very common first word
is spread over all ranges; a slice is one row with its own word table.

The slices of a range are united in one task, batch after batch: words get the
range's numbers, equal paths are merged level by level and their weights summed.
Paths of at least ``least`` occurrences leave the task. Candidates are then
composed with the transducer of these paths to look up the weights of their
parts: a part of a frequent phrase is frequent, so every part is found. A part
that very many candidates share is looked up in several tasks.

Counts are 64-bit, scores are exact decimals of 38 digits. Nothing is sampled,
capped or estimated; a task holds a shard of bounded size or the paths of a
range, and the number of ranges grows with the bytes of the texts.

Defined results: null text counts as empty and gives nothing; a null lang counts
as ``und``; repeated rows count each; words of any length are kept whole; ties
of scores go to the larger count, then the smaller phrase in UTF-8 byte order,
ties of cuts to the shorter first part; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsmith.llm.common import materialize

#: Words of a buffer that is sorted at once, and arcs at which a shard is sent off.
BUFFER_WORDS, SHARD_ARCS = 1_000_000, 2_000_000
#: Bytes of text for each range of prefixes, and part lookups of a task.
RANGE_BYTES = 8 << 20
PARTS_PER_TASK = 200_000
#: Groups in which a language's phrases are ranked before they are ranked together.
RANK_GROUPS = 32
_U = np.uint64
# fixed values: odd multipliers of 64-bit mixing
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)

_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS + b"\t", bytes(range(97, 123)) + b"." * len(_SEPARATORS) + b" ")


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with b"." between its pieces."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


class _Numbers(dict):
    """Numbers words from 1; b"." is 0."""
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _M2
    return x ^ (x >> _U(29))


def sum_by_key(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their weights (1 each if none)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[start], np.diff(np.append(start, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(weights, start)


def shared_runs(state: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arcs (state, label, weight), sorted by state and label, with equal runs
    of arcs stored once: target run of each of ``n`` states (-1: no arcs), where
    the runs begin, and their labels and weights."""
    cut = np.searchsorted(state, np.arange(n + 1))
    size = np.diff(cut)
    arc = _mix(label.astype(_U) * _M1 + _mix(weight.astype(_U)))
    place = np.arange(len(state)) - cut[state] if len(state) else np.zeros(0, np.int64)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(arc + place.astype(_U) * _M2), dtype=_U)])
    key = _mix(total[cut[1:]] - total[cut[:-1]] + size.astype(_U))
    full = np.flatnonzero(size)
    target = np.full(n, -1, np.int64)
    if not len(full):
        return target, np.zeros(1, np.int64), label, weight
    _, lead, of = np.unique(key[full], return_index=True, return_inverse=True)
    mine, rep = cut[full], cut[full[lead]][of]
    # runs of one key are compared arc by arc; one that differs stands alone
    owner = np.repeat(np.arange(len(full)), size[full])
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size[full]) - size[full], size[full])
    same = size[full] == size[full[lead]][of]
    other = np.minimum(rep[owner] + at, len(label) - 1)
    equal = same[owner] & (label[mine[owner] + at] == label[other]) & (weight[mine[owner] + at] == weight[other])
    alone = np.flatnonzero(np.bincount(owner, ~equal, len(full)) > 0)
    kept = np.concatenate([full[lead], full[alone]])
    target[full] = of
    target[full[alone]] = len(lead) + np.arange(len(alone))
    begin = np.concatenate([[0], np.cumsum(size[kept])])
    pick = np.repeat(cut[kept] - begin[:-1], size[kept]) + np.arange(begin[-1])
    return target, begin, label[pick], weight[pick]


SLICE = ("lang string, part int, words binary, one binary, one_n binary, first binary, second binary, two_n binary, "
         "target binary, begin binary, third binary, three_n binary")
_NAMES = [c.split()[0] for c in SLICE.split(", ")]


class Shard:
    """Counts of one language's n-grams within a scan task, as sorted arcs:
    words, (first << 32 | second), (place among the pairs << 32 | third)."""

    def __init__(self, lang: str):
        self.lang, self.number = lang, _Numbers({b".": 0})
        self.buffer: list[np.ndarray] = []
        self.waiting = 0
        self.levels = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(3)]

    def add(self, text: bytes) -> None:
        ids = np.array([0, *map(self.number.__getitem__, tokens(text))], np.int64)
        self.buffer.append(ids)
        self.waiting += len(ids)

    def sort(self) -> None:
        """Builds the buffer's sorted n-grams into the shard's arcs."""
        if not self.buffer:
            return
        a = np.concatenate(self.buffer)
        self.buffer, self.waiting = [], 0
        two = (a[:-1] > 0) & (a[1:] > 0)
        three = np.flatnonzero(two[:-1] & (a[2:] > 0))
        keys, of, n = np.unique(((a[:-1] << 32) | a[1:])[two], return_inverse=True, return_counts=True)
        state = np.zeros(len(two), np.int64)
        state[two] = of
        (k1, n1), (k2, n2), (k3, n3) = self.levels
        merged = sum_by_key(np.concatenate([k2, keys]), np.concatenate([n2, n]))
        was, now = np.searchsorted(merged[0], k2), np.searchsorted(merged[0], keys)
        fresh = sum_by_key((now[state[three]] << 32) | a[three + 2] if len(three) else np.zeros(0, np.int64))
        old = (was[k3 >> 32] << 32) | (k3 & 0xFFFFFFFF) if len(k3) else k3
        k0, n0 = sum_by_key(a[a > 0])
        self.levels = [sum_by_key(np.concatenate([k1, k0]), np.concatenate([n1, n0])), merged,
                       sum_by_key(np.concatenate([old, fresh[0]]), np.concatenate([n3, fresh[1]]))]

    @property
    def arcs(self) -> int:
        return len(self.number) + sum(len(k) for k, _ in self.levels)

    def slices(self, parts: int) -> Iterator[dict]:
        """The transducer, a row for each range of prefixes."""
        (k1, n1), (k2, n2), (k3, n3) = self.levels
        if not len(k1):
            return
        words = np.empty(len(self.number), object)
        words[:] = list(self.number)
        hashes = _mix(pd.util.hash_array(words, categorize=False) + _U(hash_of(self.lang)))
        in_range = lambda h: (((h >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
        part1, part2 = in_range(_mix(hashes[k1] * _M1)), in_range(_mix(hashes[k2 >> 32] * _M1 + hashes[k2 & 0xFFFFFFFF]))
        o1, o2 = np.argsort(part1, kind="stable"), np.argsort(part2, kind="stable")
        back = np.empty(len(o2), np.int64)
        back[o2] = np.arange(len(o2))
        parent = back[k3 >> 32]                                          # place of the two-word prefix, by range
        o3 = np.argsort(parent, kind="stable")
        parent, third, n3 = parent[o3], (k3 & 0xFFFFFFFF)[o3], n3[o3]
        one, n1, part1 = k1[o1], n1[o1], part1[o1]
        first, second, n2, part2 = (k2 >> 32)[o2], (k2 & 0xFFFFFFFF)[o2], n2[o2], part2[o2]
        ends = np.arange(parts + 1)
        c1, c2 = np.searchsorted(part1, ends), np.searchsorted(part2, ends)
        c3 = np.searchsorted(parent, c2)
        for r in np.flatnonzero((np.diff(c1) > 0) | (np.diff(c2) > 0)):
            i, j, k = slice(c1[r], c1[r + 1]), slice(c2[r], c2[r + 1]), slice(c3[r], c3[r + 1])
            used, local = np.unique(np.concatenate([one[i], first[j], second[j], third[k]]), return_inverse=True)
            at = np.cumsum([c1[r + 1] - c1[r], c2[r + 1] - c2[r], c2[r + 1] - c2[r]])
            w1, f, s, t = np.split(local, at)
            target, begin, t, w3 = shared_runs(parent[k] - c2[r], t, n3[k], c2[r + 1] - c2[r])
            u4 = lambda x: x.astype("<u4").tobytes()
            yield dict(zip(_NAMES, (self.lang, int(r), b" ".join(words[used].tolist()), u4(w1), u4(n1[i]), u4(f), u4(s), u4(n2[j]),
                                    target.astype("<i4").tobytes(), u4(begin), u4(t), u4(w3)), strict=True))


def hash_of(name: str) -> int:
    return int(pd.util.hash_array(np.array([name], object), categorize=False)[0])


class Union:
    """Transducer of one range: the sum of its slices."""

    def __init__(self):
        self.number = _Numbers()
        self.one = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.two, self.three = [], []        # (first << 32 | second, weight), (place among the two's, third, weight)
        self.waiting, self.held = 0, 0

    def add(self, row: dict) -> None:
        u4 = lambda c: np.frombuffer(row[c], "<u4").astype(np.int64)
        to = np.array([self.number[w] for w in row["words"].split(b" ")], np.int64)
        self.one.append((to[u4("one")], u4("one_n")))
        first, second, target, begin = to[u4("first")], to[u4("second")], np.frombuffer(row["target"], "<i4"), u4("begin")
        base = sum(len(k) for k, _ in self.two)
        self.two.append(((first << 32) | second, u4("two_n")))
        has = np.flatnonzero(target >= 0)
        size = np.diff(begin)[target[has]]
        ends = np.cumsum(size)
        pick = np.repeat(begin[target[has]] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        self.three.append((np.repeat(base + has, size), to[u4("third")[pick]], u4("three_n")[pick]))
        self.waiting += len(first) + len(pick)
        if self.waiting > max(2_000_000, self.held):
            self.merge()

    def merge(self) -> None:
        """Sums equal paths, level by level."""
        self.one = [sum_by_key(*(np.concatenate(x) for x in zip(*self.one, strict=True)))]
        if self.two:
            k2, n2 = (np.concatenate(x) for x in zip(*self.two, strict=True))
            keys, of = np.unique(k2, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, of, n2)
            p, t, n3 = (np.concatenate(x) for x in zip(*self.three, strict=True))
            k3, n3 = sum_by_key((of[p] << 32) | t, n3)
            self.two, self.three = [(keys, total)], [(k3 >> 32, k3 & 0xFFFFFFFF, n3)]
            self.held = len(keys) + len(k3)
        self.waiting = 0

    def paths(self, least: int) -> tuple[list[bytes], np.ndarray, int]:
        """Phrases of at least ``least`` occurrences, their counts, and the
        number of all words that the range holds."""
        self.merge()
        words = list(self.number)
        k1, n1 = self.one[0]
        some = n1 >= least
        phrases, counts = [words[i] for i in k1[some]], [n1[some]]
        if self.two:
            (k2, n2), (p, t, n3) = self.two[0], self.three[0]
            first, second = (k2 >> 32).tolist(), (k2 & 0xFFFFFFFF).tolist()
            some = np.flatnonzero(n2 >= least)
            phrases += [words[first[i]] + b" " + words[second[i]] for i in some.tolist()]
            counts.append(n2[some])
            some = np.flatnonzero(n3 >= least)
            phrases += [b" ".join((words[first[i]], words[second[i]], words[j])) for i, j in zip(p[some].tolist(), t[some].tolist(), strict=True)]
            counts.append(n3[some])
        return phrases, np.concatenate(counts), int(n1.sum())


class Transducer:
    """Acyclic automaton over given phrases (lists of labels, the first one the
    language) with their weights; states of a depth are numbered in order of
    (state before, label)."""

    def __init__(self, paths: list[tuple], weights: np.ndarray):
        self.label = _Numbers()
        depth = max(map(len, paths), default=0)
        self.arcs, self.weight = [], []
        state = np.zeros(len(paths), np.int64)
        alive = np.arange(len(paths))
        for d in range(depth):
            alive = alive[[len(paths[i]) > d for i in alive.tolist()]]
            key = (state[alive] << 32) | np.array([self.label[paths[i][d]] for i in alive.tolist()], np.int64)
            arcs, of = np.unique(key, return_inverse=True)
            state[alive] = of
            ends = np.array([len(paths[i]) == d + 1 for i in alive.tolist()], bool)
            w = np.zeros(len(arcs), np.int64)
            w[of[ends]] = weights[alive[ends]]
            self.arcs.append(arcs)
            self.weight.append(w)

    def compose(self, paths: list[tuple]) -> np.ndarray:
        """The weights of the given paths (0: not accepted), all walked together."""
        out = np.zeros(len(paths), np.int64)
        state, alive, get = np.zeros(len(paths), np.int64), np.arange(len(paths)), self.label.get
        for d, (arcs, weight) in enumerate(zip(self.arcs, self.weight, strict=True)):
            label = np.array([get(paths[i][d], -1) for i in alive.tolist()], np.int64)
            key = (state[alive] << 32) | np.maximum(label, 0)
            at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            ok = (label >= 0) & (arcs[at] == key)
            alive, at = alive[ok], at[ok]
            state[alive] = at
            ends = np.array([len(paths[i]) == d + 1 for i in alive.tolist()], bool)
            out[alive[ends]] = weight[at[ends]]
            alive = alive[~ends]
            if not len(alive):
                break
        return out


def shard_slices(docs: DataFrame, parts: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Slices of the count transducers of all scan tasks."""
    narrow = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                         F.col(f"`{text_col}`").cast("binary").alias("text")).filter("text is not null")

    def run(batches):
        shards: dict[str, Shard] = {}
        waiting = 0

        def out(shard):
            each = shard.slices(parts)
            while rows := list(itertools.islice(each, 64)):
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], _type(n)) for n in _NAMES})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shard = shards.get(lang) or shards.setdefault(lang, Shard(lang))
                before = shard.waiting
                shard.add(text)
                waiting += shard.waiting - before
                if waiting >= BUFFER_WORDS:
                    waiting = 0
                    for s in shards.values():
                        s.sort()
                    if sum(s.arcs for s in shards.values()) >= SHARD_ARCS:
                        for s in shards.values():
                            yield from out(s)
                        shards.clear()
        for s in shards.values():
            s.sort()
            yield from out(s)

    return narrow.mapInArrow(run, SLICE)


def _type(name: str) -> pa.DataType:
    return {"lang": pa.string(), "part": pa.int32()}.get(name, pa.binary())


def frequent(slices: DataFrame, least: int, tasks: int) -> DataFrame:
    """lang, words, phrase, a: phrases of at least ``least`` occurrences, and per
    range a row with no words, whose count is the number of words there."""
    def run(batches):
        now, union = None, Union()

        def done():
            if now is None:
                return []
            phrases, counts, total = union.paths(least)
            return [pa.RecordBatch.from_pydict({
                "lang": pa.array([now[1]] * (len(phrases) + 1), pa.string()),
                "words": pa.array([p.count(b" ") + 1 for p in phrases] + [0], pa.int32()),
                "phrase": pa.array([*phrases, b""], pa.binary()), "a": pa.array([*counts.tolist(), total], pa.int64())})]

        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["lang"]) != now:
                    yield from done()
                    now, union = (row["part"], row["lang"]), Union()
                union.add(row)
        yield from done()

    dealt = slices.repartition(tasks, "part", "lang").sortWithinPartitions("part", "lang")
    found = dealt.mapInArrow(run, "lang string, words int, phrase binary, a bigint")
    return found.withColumn("phrase", F.col("phrase").cast("string"))


def weights_of_parts(phrases: DataFrame, parts: DataFrame, tasks: int) -> DataFrame:
    """``parts`` (lang, part, phrase, k, side) with the weight ``w`` of each part,
    by composition with the transducer of ``phrases`` (lang, phrase, a)."""
    where = lambda c: F.pmod(F.xxhash64("lang", c), F.lit(tasks)).cast("int")
    parts = materialize(parts.withColumn("task", where("part")), "collocation-parts")
    size = materialize(parts.groupBy("task").agg(F.ceil(F.count("*") / F.lit(PARTS_PER_TASK)).cast("int").alias("copies")), "collocation-sizes")
    left = parts.join(size, "task").withColumn("copy", F.pmod(F.xxhash64("phrase", "k"), F.col("copies")).cast("int")).drop("copies")
    right = phrases.select("lang", F.col("phrase").alias("part"), "a", where("phrase").alias("task")).join(size, "task")
    right = right.select("lang", "part", "a", F.col("task").alias("of"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("nth"))

    def path(table):
        return [(lang, *p.split(" ")) for lang, p in zip(table["lang"].to_pylist(), table["part"].to_pylist(), strict=True)]

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        keep = table.select(["lang", "phrase", "k", "side"])
        w = Transducer(path(counts), counts["a"].to_numpy()).compose(path(table)) if counts.num_rows else np.zeros(table.num_rows, np.int64)
        return keep.append_column("w", pa.array(w, pa.int64()))

    return left.groupBy("task", "copy").cogroup(right.groupBy("of", "nth")).applyInArrow(
        run, "lang string, phrase string, k int, side string, w bigint")


def collocations(docs: DataFrame, least: int = 10, swallowed: int = 50, top: int | None = 2000, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2
    to 3 words (all of them with ``top`` None). ``swallowed``: a phrase goes if a
    longer candidate around it has that percentage of its occurrences."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    found = materialize(frequent(shard_slices(docs, tasks, text_col, lang_col), least, tasks), "collocation-paths")
    n = found.filter("words = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    phrases = found.filter("words > 0")
    some = phrases.filter("words > 1")

    ws = F.split("phrase", " ")
    cuts = some.select("lang", "phrase", ws.alias("ws"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    text = lambda a: F.array_join(a, " ")
    left = text(F.slice("ws", F.lit(1), F.col("k")))
    right = text(F.slice("ws", F.col("k") + 1, F.col("words")))
    parts = cuts.select("lang", "phrase", "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), left.alias("part")), F.struct(F.lit("r").alias("side"), right.alias("part")))).alias("x"))
    looked = weights_of_parts(phrases, parts.select("lang", "phrase", "k", "x.*"), tasks)
    both = looked.groupBy("lang", "phrase", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("w"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("w"))).alias("r"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    scored = both.join(some.select("lang", "phrase", "words", "a"), ["lang", "phrase"]).select(
        "*", (F.lit(1_000_000).cast("decimal(38,0)") * big("a") * big("a")).alias("num"), (big("l") * big("r")).alias("den"))
    scored = scored.select("lang", "phrase", "words", "a", F.struct(F.expr("num div den").cast("long").alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut"))

    longer = some.filter("words > 2").select("lang", "a", ws.alias("ws"))
    inside = longer.select("lang", "a", F.explode(F.array_distinct(F.array(
        text(F.slice("ws", 1, 2)), text(F.slice("ws", 2, 2))))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(
        F.col("around").isNull() | (big("around") * 100 < big("a") * swallowed))
    kept = kept.join(n, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:                  # no task of the last ranking reads more than RANK_GROUPS * top rows of a language
        some = kept.select("*", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)).alias("group"))
        first = F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))
        kept = some.select("*", first.alias("nth")).filter(F.col("nth") <= top).drop("group", "nth")
    ranked = kept.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("rank"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

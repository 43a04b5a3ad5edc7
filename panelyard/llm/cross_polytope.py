"""Embedding near-duplicates: cross-polytope hashing, multiprobe buckets, verified pairs.

A hash turns a unit vector by three rounds of random signs and a fast Hadamard transform and takes
its largest coordinate with its sign, the nearest corner of the cross-polytope. WIDTH such corners
are a bucket of one table; the PROBES buckets of least penalty are tried, the first of them is the
vector's own. A pair meets where the own bucket of one is a probe of the other. The width follows
the number of vectors, and as many tables are taken as leave a pair at the threshold unmet with a
chance of MISS at most, by the collision rate of pairs drawn at exactly that cosine.

Bucket ids travel first; vectors follow only into buckets that somebody else is in. Met pairs are
compared in double precision by blocks of at most BLOCK rows a side. A pair belongs to the first
table and direction in which it meets, which both rows' codes tell, so each link is counted once
and a block passes on counts and spanning links, never pairs. Equal vectors are one node from the
start. Own buckets of over HOT nodes get balls: whatever lies within half the threshold's angle of
a pivot links with all others of its ball and is not compared with them; only what lies outside
meets the ball's blocks. Nothing is capped.

Rows: vectors that are null, empty, zero or hold null or non-finite components have no links and
are their own class. Vectors of other lengths never link. Repeated ids are vectors of their own,
but a class is named by its smallest id; a null id gives its row, and a class without any id a null
component_id; kept is false for null ids. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.runtime import bounded_batches, settled, written
from panelyard.llm.simhash import components

LEAST = 0.95
ROUNDS = 3
LEAST_PADDED = 64
PROBES = 8
ALTERNATIVES = 3
WIDEST = 5
MISS = 1e-4
BLOCK = 512
HOT = 256
#: Rows that a task holds at once (and the rest of their last block), pairs compared at once, and
#: pairs of a block from which it is one product of matrices.
CHUNK, PAIRS, LARGE = 4096, 1 << 14, 1 << 14
BALL_ROUNDS = 4
#: Pivots (a vector each) that are sent to every task; more are joined.
BROADCAST_PIVOTS = 4096
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; rows have a power of two of columns."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in doubles; large and small values neither overflow nor vanish."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def padded(length: int) -> int:
    """A power of two; short vectors are padded to LEAST_PADDED, else there are too few rotations for
    tables to differ."""
    return max(LEAST_PADDED, 1 << max(0, length - 1).bit_length())


class Hashes:
    """tables * width cross-polytope hashes for vectors of one length."""

    def __init__(self, length: int, width: int, tables: int):
        self.length, self.width, self.tables = length, width, tables
        self.padded = padded(length)
        rng = np.random.default_rng([SEED, length])
        self.signs = rng.choice([-1.0, 1.0], (tables, width, ROUNDS, self.padded))
        self.salt = rng.integers(1, 1 << 62, (tables, width), np.int64).astype(np.uint64) | np.uint64(1)
        top = min(ALTERNATIVES, self.padded)
        self.choices = np.array(list(itertools.product(range(top), repeat=width)))
        self.probes = min(PROBES, len(self.choices))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, PROBES) of 32-bit bucket codes by rising penalty; the first is the own bucket."""
        x = np.zeros((len(unit), self.padded))
        x[:, : self.length] = unit
        out = np.empty((len(unit), self.tables, PROBES), np.int32)
        for t in range(self.tables):
            penalty, mixed = 0.0, np.full((len(unit), 1), self.length, np.uint64)
            for f in range(self.width):
                y = x
                for r in range(ROUNDS):
                    y = hadamard(y * self.signs[t, f, r])
                size = np.abs(y)
                best = np.argsort(-size, axis=1, kind="stable")[:, : self.choices.max() + 1]
                value = np.take_along_axis(size, best, 1)
                corner = (2 * best + (np.take_along_axis(y, best, 1) < 0)).astype(np.uint64)
                pick = self.choices[:, f]
                penalty = penalty + ((value[:, :1] - value) ** 2)[:, pick]
                mixed = (mixed ^ (corner[:, pick] + np.uint64(1))) * self.salt[t, f]
                mixed = mixed ^ (mixed >> np.uint64(29))
            order = np.argsort(penalty, axis=1, kind="stable")[:, : self.probes]
            got = (np.take_along_axis(mixed, order, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            out[:, t] = np.pad(got, ((0, 0), (0, PROBES - self.probes)), mode="edge")
        return out


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, tables): whether b has a's own bucket among its probes."""
    return (a[:, :, :1] == b).any(axis=2)


def tables_for(length: int, width: int, least: float = LEAST, miss: float = MISS, pairs: int = 1500) -> int:
    """Tables after which a pair at the threshold is unmet with a chance of miss at most, by the
    share of drawn pairs that meet in one table (less two standard errors)."""
    if length < 2:
        return 1
    rng = np.random.default_rng([SEED, length, width])
    a = units(rng.standard_normal((pairs, length)))
    b = rng.standard_normal((pairs, length))
    b = units(b - np.einsum("ij,ij->i", a, b)[:, None] * a)
    b = least * a + math.sqrt(1 - least * least) * b
    draws = Hashes(length, width, 4)
    x, y = draws.codes(a), draws.codes(b)
    p = float((meeting(x, y) | meeting(y, x)).mean())
    p = max(1e-3, p - 2 * math.sqrt(p * (1 - p) / (4 * pairs)))
    return 1 if p >= 1 - miss else math.ceil(math.log(miss) / math.log(1 - p))


def width_for(rows: int, length: int) -> int:
    """So many hashes to a bucket that there are more buckets than probes of all rows."""
    return min(WIDEST, max(1, math.ceil(math.log(max(2, rows * PROBES)) / math.log(2 * padded(length)))))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the vectors."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(n))


def _coded(width: int, tables: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hashes] = {}
        for batch in batches:
            out = np.empty((batch.num_rows, tables * PROBES), np.int32)
            for at, rows in _by_length(batch.column("v")):
                n = rows.shape[1]
                hashes = known.setdefault(n, Hashes(n, width, tables)) if n not in known else known[n]
                out[at] = hashes.codes(units(rows)).reshape(len(at), -1)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables * PROBES, dtype=np.int32)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), codes], ["node", "codes"])
        settled()

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which rows (node, v, pivot, pv) lie in their pivot's ball."""
    inside = math.cos(math.acos(LEAST) / 2) + 1e-9
    for batch in batches:
        near = np.zeros(batch.num_rows, bool)
        other = batch.column("pv")
        for at, rows in _by_length(batch.column("v")):
            pv = other.take(pa.array(at))
            fits = pv.value_lengths().to_numpy(zero_copy_only=False) == rows.shape[1]
            if fits.any():
                b = pv.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, rows.shape[1])
                near[at[fits]] = np.einsum("ij,ij->i", units(rows[fits]), units(b)) >= inside
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot")], ["node", "ball"]).filter(pa.array(near))


def _balls(nodes: DataFrame, coded: DataFrame) -> DataFrame | None:
    """(node, ball) of nodes that lie within half the threshold's angle of the ball's pivot, for own
    buckets of over HOT nodes; a few rounds, as what a first pivot leaves may be hot again."""
    rest = coded.select("node", F.col("codes")[0].alias("bucket"))
    found: DataFrame | None = None
    for _ in range(BALL_ROUNDS):
        left = rest if found is None else rest.join(found, "node", "left_anti")
        hot = written(left.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where(F.col("n") > HOT).select("bucket", "pivot"), "pivots")
        n = hot.count()
        if not n:
            break
        pivots = hot.join(nodes.select(F.col("node").alias("pivot"), F.col("v").alias("pv")), "pivot")
        pivots = F.broadcast(pivots) if n <= BROADCAST_PIVOTS else pivots
        beside = left.join(pivots, "bucket").select("node", "pivot", "pv").join(nodes.select("node", "v"), "node")
        more = written(beside.select("node", "v", "pivot", "pv").mapInArrow(_cosines, "node long, ball long"), "balls")
        found = more if found is None else written(found.unionByName(more), "balls")
    return found


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches in tables of some CHUNK rows that cut no run of equal keys, with the runs' starts."""

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(x.num_rows for x in kept) >= CHUNK:
            table = pa.Table.from_batches(kept)
            at = starts(table)
            if (end := int(at[-1])):
                yield table.slice(0, end), at[:-1]
                kept = table.slice(end).to_batches()
    if sum(x.num_rows for x in kept):
        table = pa.Table.from_batches(kept)
        yield table, starts(table)


def _spanning(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """A forest of the links between a[i] and b[i]."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            yield x, y


def _met(unit: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of the same run, i on its left and j on its right, with a cosine of least or more."""
    ends = np.append(starts[1:], len(unit))
    before = np.concatenate([[0], np.cumsum(left)]), np.concatenate([[0], np.cumsum(right)])
    lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
    n_left, n_right = (c[ends] - c[starts] for c in before)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    big = n_left * n_right > LARGE
    for g in np.flatnonzero(big):
        p = lefts[before[0][starts[g]] : before[0][ends[g]]]
        q = rights[before[1][starts[g]] : before[1][ends[g]]]
        i, j = np.nonzero(unit[p] @ unit[q].T >= least)
        found.append((p[i], q[j]))
    small = np.flatnonzero(~big & (n_left * n_right > 0))
    rows = np.concatenate([lefts[before[0][starts[g]] : before[0][ends[g]]] for g in small]) if len(small) else np.zeros(0, int)
    width, first = np.repeat(n_right[small], n_left[small]), np.repeat(before[1][starts[small]], n_left[small])
    for k in range(0, len(rows), PAIRS // 64):
        w, f = width[k : k + PAIRS // 64], first[k : k + PAIRS // 64]
        i = np.repeat(rows[k : k + PAIRS // 64], w)
        j = rights[np.repeat(f, w) + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)]
        for c in range(0, len(i), PAIRS):
            a, b = i[c : c + PAIRS], j[c : c + PAIRS]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
            found.append((a[near], b[near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _compared(tables: int, least: float) -> Callable:
    def linked(rows: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t, node, n, ball, left, right = (rows.column(c).to_numpy() for c in ("t", "node", "n", "ball", "left", "right"))
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(node), tables, PROBES)
        found = []
        for at, values in _by_length(rows.column("v").combine_chunks()):
            own = np.zeros(len(node), bool)
            own[at] = True
            unit = np.zeros((len(node), values.shape[1]))
            unit[at] = units(values)
            i, j = _met(unit, starts, left & own, right & own, least)
            use = (node[i] != node[j]) & ((ball[i] < 0) | (ball[i] != ball[j]))
            found.append((i[use], j[use]))
        i, j = (np.concatenate(x) for x in zip(*found))
        mine = np.zeros(len(i), bool)
        order = np.arange(tables)
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            ab, ba = meeting(codes[a], codes[b]), meeting(codes[b], codes[a])
            before = ((ab | ba) & (order < t[a][:, None])).any(axis=1)
            again = np.take_along_axis(ba, t[a][:, None].astype(np.int64), 1)[:, 0]
            mine[k : k + len(a)] = ~before & ((node[a] < node[b]) | ~again)
        return node, n, i[mine], j[mine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, ["t", "bucket", "i", "j"]):
            node, n, i, j = linked(rows, starts)
            if not len(i):
                continue
            own, place = np.unique(node, return_inverse=True)
            links = np.bincount(place[i], n[j], len(own)) + np.bincount(place[j], n[i], len(own))
            some = np.flatnonzero(links)
            u, v = np.array(list(_spanning(node[i], node[j])), np.int64).reshape(-1, 2).T
            columns = np.concatenate([own[some], u]), np.concatenate([np.full(len(some), -1), v]), np.concatenate([links[some].astype(np.int64), np.zeros(len(u), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])
        settled()

    return run


def _blocks(posts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each post (t, bucket, node, own, ball) of a bucket that others share, with the blocks (i, j)
    in which it stands on the left (own buckets) or right. Small buckets are one block; large ones
    are cut into blocks of a ball or of what has none, and a ball's blocks never face their own."""
    at = posts.join(sizes, ["t", "bucket"])
    small = at.where(F.col("rows") <= 2 * BLOCK).select("t", "bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "ball", F.col("own").alias("left"), F.lit(True).alias("right"))
    large = at.where(F.col("rows") > 2 * BLOCK).select("t", "bucket", "node", "own", "ball")
    if large.isEmpty():
        return small
    parts = large.groupBy("t", "bucket", "ball").agg(F.count("*").alias("right"), F.count_if("own").alias("left"))
    parts = parts.withColumns({side: F.ceil(F.col(side) / BLOCK).cast("int") for side in ("left", "right")})
    many = parts.groupBy("t", "bucket").agg(F.collect_list(F.struct("ball", "left", "right")).alias("parts"))
    cut = large.join(parts, ["t", "bucket", "ball"]).join(many, ["t", "bucket"])

    def number(side: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(side)), F.greatest(F.col(side), F.lit(1))).cast("int")

    def named(ball: Column, k: Column) -> Column:
        return F.xxhash64(ball, k)

    def facing(side: str) -> Column:
        apart = F.filter("parts", lambda x: (F.col("ball") < 0) | (x["ball"] != F.col("ball")))
        return F.explode(F.flatten(F.transform(apart, lambda x: F.when(x[side] > 0, F.transform(F.sequence(F.lit(0), x[side] - 1), lambda k: named(x["ball"], k))).otherwise(F.array().cast("array<bigint>")))))

    lefts = cut.where("own").select("t", "bucket", named(F.col("ball"), number("left")).alias("i"), facing("right").alias("j"), "node", "ball", F.lit(True).alias("left"), F.lit(False).alias("right"))
    rights = cut.select("t", "bucket", facing("left").alias("i"), named(F.col("ball"), number("right")).alias("j"), "node", "ball", F.lit(False).alias("left"), F.lit(True).alias("right"))
    return small.unionByName(lefts).unionByName(rights)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept (see the contract in the docstring above)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = written(rows.withColumn("v", F.when(good, F.col("v"))), "vectors")
    nodes = written(marked.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    count, longest = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = marked.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not count:
        return _kept(alone)
    width = width_for(count, longest)
    tables = tables_for(longest, width, least)
    coded = written(nodes.select("node", "v").mapInArrow(_coded(width, tables), "node long, codes array<int>"), "codes")
    balls = _balls(nodes, coded) if least >= LEAST else None
    ball = F.coalesce("ball", F.lit(-1).cast("long")).alias("ball")
    with_ball = coded.withColumn("ball", F.lit(-1).cast("long")) if balls is None else coded.join(balls, "node", "left").select("node", "codes", ball)
    # own is null for a probe that repeats an earlier one of its table
    nth = lambda c, k: F.array_position(F.slice("codes", (F.floor(k / PROBES) * PROBES + 1).cast("int"), PROBES), c)
    spots = F.transform("codes", lambda c, k: F.struct(F.floor(k / PROBES).cast("int").alias("t"), c.alias("bucket"), F.when(nth(c, k) == k % PROBES + 1, k % PROBES == 0).alias("own")))
    posts = with_ball.select("node", "ball", F.explode(F.filter(spots, lambda p: p["own"].isNotNull())).alias("p")).select("p.t", "p.bucket", "node", "ball", "p.own")
    sizes = posts.groupBy("t", "bucket").agg(F.count("*").alias("rows"), F.count_if("own").alias("owners")).where("rows > 1 AND owners > 0").select("t", "bucket", "rows")
    placed = written(_blocks(posts, sizes), "blocks")
    facts = coded.join(nodes.select("node", "v", "n"), "node")
    met = placed.join(facts, "node").repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j")
    found = written(met.select("t", "bucket", "i", "j", "node", "n", "ball", "left", "right", "codes", "v").mapInArrow(_compared(tables, least), "a long, b long, links long"), "found")
    edges = found.where("b >= 0").select("a", "b")
    links = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "first", "n").join(links, "node", "left")
    if balls is not None:
        edges = edges.unionByName(balls.where("node <> ball").select(F.col("node").alias("a"), F.col("ball").alias("b")))
        weigh = balls.join(nodes.select("node", "n"), "node").groupBy("ball").agg(F.sum("n").alias("weight"))
        # a ball's pivot may be a member of its own ball only, as pivots are taken from what is left
        named = named.join(balls.join(weigh, "ball").select("node", "weight"), "node", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - F.col("n"), F.lit(0)))
    roots = components(edges).withColumnRenamed("root", "_root")
    named = named.join(roots, "node", "left").withColumn("_root", F.coalesce("_root", "node"))
    least_id = named.groupBy("_root").agg(F.min("first").alias("component_id"))
    named = written(named.join(least_id, "_root").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "classes")
    of = nodes.join(named, "node").select("v", "n_links", "component_id")
    members = marked.where("v IS NOT NULL").join(of, "v").select("vec_id", "n_links", "component_id")
    return _kept(members.unionByName(alone))


def _kept(df: DataFrame) -> DataFrame:
    return df.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM e UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN e ON reach.b = e.r GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM e JOIN c USING (r) LEFT JOIN n USING (r)
"""

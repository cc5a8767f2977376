"""Exact top-k by inner product: M-trees of paged metric nodes, searched best-first.

Vectors get one more coordinate, so that all are equally long and the largest inner product is the least distance. Rows go to
the nearest of a bounded number of pivots; crowded pivots are split, so that each tree is of bounded size, however many
vectors are alike. A query first searches the tree of its own row, then those trees that its k-th score does not
exclude, pairs of a tree and a block of queries at a time.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written
from .whitening import finite

SCALE, EVERY = 256, 50
#: Vectors of a tree, entries of a page, queries and roots of a block; pivots at most.
TREE, PAGE, QUERIES, ROOTS, PIVOTS = 8192, 64, 2048, 1024, 4096
#: Distances are right to this share of the vectors' length; bounds give way by it.
SLACK = 1e-6
#: Integers are exact as doubles up to here, and as longs up to there.
EXACT, WIDE = 2**53, 2**63
PAGES = "tree long, node int, object binary, reach double, leaf boolean, child array<int>, row array<long>, vec_id array<long>, entry binary, apart array<double>, radius array<double>"
FOUND = "row long, query_id long, vec_id long, other long, score long"


@dataclass(frozen=True)
class Space:
    """Integer vectors of d entries, the longest of squared length longest."""

    d: int
    longest: int

    @property
    def slack(self) -> float:
        return SLACK * math.sqrt(self.longest) + 1e-9

    def load(self, packed: list[bytes]) -> np.ndarray:
        """Vectors as rows; doubles where all inner products are exact as such."""
        x = np.frombuffer(b"".join(packed), np.int64).reshape(-1, self.d)
        return x.astype(float) if self.longest < EXACT else x

    def last(self, x: np.ndarray) -> np.ndarray:
        """The coordinate that makes all vectors equally long."""
        y = x.astype(float)
        return np.sqrt(np.maximum(self.longest - np.einsum("ij,ij->i", y, y), 0))

    def between(self, x: np.ndarray, last: np.ndarray, center: np.ndarray, center_last: float) -> np.ndarray:
        """Distances of vectors from one of them."""
        y = x.astype(float) - center.astype(float)
        return np.sqrt(np.einsum("ij,ij->i", y, y) + (last - center_last) ** 2)

    def from_query(self, length: float, scores):
        """Distances of a query of squared length from vectors with these scores; a query has 0 as its last coordinate."""
        return np.sqrt(np.maximum(length + self.longest - 2.0 * np.asarray(scores, float), 0))


def grow(space: Space, x: np.ndarray, seed: int) -> list[dict]:
    """Pages of the M-tree of rows x. An entry has its distance from the page's object and the radius of what is below.

    Page 0 is the root and hangs on the object x[0]; the object of any other is an entry of the page above, reach is the radius
    around it. object and entry hold indices of x.
    """
    last, rng = space.last(x), np.random.default_rng(seed)
    pages: list[dict] = []
    numbers = itertools.count(1)
    waiting = [(0, np.arange(len(x)), 0, space.between(x, last, x[0], last[0]))]
    while waiting:
        node, members, center, apart = waiting.pop()
        made = {"node": node, "object": center, "reach": float(apart.max()), "leaf": len(members) <= PAGE, "child": [], "entry": [], "apart": [], "radius": []}
        pages.append(made)
        if made["leaf"]:
            made.update(entry=members.tolist(), apart=apart.tolist(), radius=[0.0] * len(members))
            continue
        fans = min(16, -(-len(members) // PAGE))
        objects = rng.choice(len(members), fans, replace=False)
        far = np.stack([space.between(x[members], last[members], x[members[o]], last[members[o]]) for o in objects])
        if (far.argmin(axis=0) == 0).all() and far[0].max() > 0:  # the objects are alike: take the farthest as well
            objects = np.array([objects[0], far[0].argmax()])
            far = np.stack([space.between(x[members], last[members], x[members[o]], last[members[o]]) for o in objects])
        # equal vectors are dealt out evenly
        nearest = far.argmin(axis=0) if far.max() > 0 else np.arange(len(members)) % len(objects)
        for i, o in enumerate(objects):
            mine = nearest == i
            if mine.any():
                made["entry"].append(int(members[o]))
                made["apart"].append(float(apart[o]))
                made["radius"].append(float(far[i][mine].max()))
                made["child"].append(next(numbers))
                waiting.append((made["child"][-1], members[mine], int(members[o]), far[i][mine]))
    return pages


class Tree:
    """An M-tree read from its pages."""

    def __init__(self, space: Space, pages: list[dict]) -> None:
        self.space, self.pages, self.computed = space, {}, 0
        for p in pages:
            if p["node"] == 0:
                [self.root] = space.load([p["object"]])
            entry = space.load([p["entry"]])
            ids = np.array([WIDE - 1 if v is None else v for v in p["vec_id"]], np.int64)
            none = np.array([v is None for v in p["vec_id"]])
            self.pages[p["node"]] = (p["leaf"], p["child"], np.array(p["row"], np.int64), ids, none, entry, np.array(p["apart"]), np.array(p["radius"]))

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, bool, int, int]]:
        """The k best (-score, vec_id is null, vec_id, row) but the row own; less if only scores from floor on matter.

        Pages wait in the order of the least distance that anything below can have. An entry whose distance from the query
        must be too large, by the stored distance from its page's object and its radius, is not computed.
        """
        space = self.space
        length = float(query.astype(float) @ query.astype(float))
        best: list[tuple[int, bool, int, int]] = []
        reach = math.inf if floor is None else float(space.from_query(length, floor)) + space.slack
        waiting = [(0.0, 0, float(space.from_query(length, self.root @ query)))]
        while waiting:
            least, node, to_object = heapq.heappop(waiting)
            if least > reach:
                break
            leaf, child, rows, ids, none, entry, apart, radius = self.pages[node]
            near = np.flatnonzero(np.abs(to_object - apart) - radius - space.slack <= reach)
            scores = entry[near] @ query
            self.computed += len(near)
            distances = space.from_query(length, scores)
            if leaf:
                close = np.flatnonzero((distances <= reach) & (rows[near] != own))
                if len(close):
                    at = near[close]
                    if len(at) > k:
                        at = at[np.lexsort((rows[at], ids[at], none[at], -scores[close]))[:k]]
                    values = dict(zip(near.tolist(), scores.tolist()))
                    best = heapq.nsmallest(k, best + [(-int(values[i]), bool(none[i]), int(ids[i]), int(rows[i])) for i in at.tolist()])
                    if len(best) == k:
                        reach = min(reach, float(space.from_query(length, -best[-1][0])) + space.slack)
            else:
                for i, distance in zip(near.tolist(), distances.tolist()):
                    below = max(least, distance - radius[i] - space.slack)
                    if below <= reach:
                        heapq.heappush(waiting, (below, child[i], distance))
        return best


def points(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, Space]:
    """row, vec_id and x (floor(scale * entry), packed) of each sound row, and their space. Shorter vectors end in zeros."""
    sound = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(finite(F.col("embedding")))
    x = F.transform("embedding", lambda c: F.floor(scale * c))
    table = written(sound.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")))
    squares = F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda s, c: (s + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"))
    d, longest = table.select(F.max(F.size("x")), F.max(squares)).first()
    space = Space(d or 1, int(longest or 0))
    if space.longest >= WIDE:
        raise OverflowError("inner products of these vectors leave 64 bits")
    return table, space


def _packed(column: pa.Array, d: int) -> list[bytes]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(np.asarray(column.offsets))
    padded = np.zeros((len(column), d), np.int64)
    padded[np.arange(d) < sizes[:, None]] = flat
    return [v.tobytes() for v in padded]


def _placed(space: Space, pivots: np.ndarray):
    last = space.last(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                packed = _packed(batch.column("x"), space.d)
                x = space.load(packed)
                near = (x.astype(float) @ pivots.T.astype(float) + np.outer(space.last(x), last)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(packed, pa.binary()), pa.array(near, pa.int64())], ["row", "vec_id", "x", "pivot"])

    return run


def place(table: DataFrame, space: Space, size: int = TREE, most: int = PIVOTS) -> DataFrame:
    """row, vec_id, x (padded) and tree: the nearest pivot's, or one of several where more than size rows have that pivot."""
    n = table.count()
    chosen = table.orderBy(F.xxhash64("row"), "row").limit(min(most, max(1, -(-n // size)))).select("x").toArrow()
    pivots = space.load(_packed(chosen.column("x").combine_chunks(), space.d)) if n else np.zeros((1, space.d))
    near = written(table.mapInArrow(_placed(space, pivots), "row long, vec_id long, x binary, pivot long"))
    shares = F.broadcast(near.groupBy("pivot").agg(F.ceil(F.count("*") / size).alias("shares")))  # a row for each pivot
    tree = F.col("pivot") + most * F.pmod(F.xxhash64("row"), F.col("shares"))
    return near.join(shares, "pivot").select("row", "vec_id", "x", tree.alias("tree"))


def _paged(space: Space):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        tree, packed = key[0].as_py(), rows.column("x").to_pylist()
        row, ids = np.array(rows.column("row")), rows.column("vec_id").to_pylist()
        pages = grow(space, space.load(packed), tree % 2**32)
        made = [p | {"tree": tree, "row": [int(row[i]) for i in p["entry"]], "vec_id": [ids[i] for i in p["entry"]], "object": packed[p["object"]], "entry": b"".join(packed[i] for i in p["entry"])} for p in pages]
        return pa.Table.from_pylist(made, schema=_PAGE_TYPES)

    return run


_PAGE_TYPES = pa.schema([("tree", pa.int64()), ("node", pa.int32()), ("object", pa.binary()), ("reach", pa.float64()), ("leaf", pa.bool_()), ("child", pa.list_(pa.int32())), ("row", pa.list_(pa.int64())), ("vec_id", pa.list_(pa.int64())), ("entry", pa.binary()), ("apart", pa.list_(pa.float64())), ("radius", pa.list_(pa.float64()))])
_FOUND_TYPES = pa.schema([(c, pa.int64()) for c in ("row", "query_id", "vec_id", "other", "score")])


def build(placed: DataFrame, space: Space) -> DataFrame:
    """The pages of one M-tree for each tree of placed rows, a row each."""
    return placed.groupBy("tree").applyInArrow(_paged(space), PAGES)


def _searched(space: Space, k: int):
    def run(key: tuple[pa.Scalar, ...], pages: pa.Table, queries: pa.Table) -> pa.Table:
        if not pages.num_rows or not queries.num_rows:
            return pa.Table.from_pylist([], schema=_FOUND_TYPES)
        tree, found = Tree(space, pages.to_pylist()), []
        for q in queries.to_pylist():
            [x] = space.load([q["x"]])
            for score, none, vec_id, other in tree.search(x, q["row"], k, q["floor"]):
                found.append({"row": q["row"], "query_id": q["query_id"], "vec_id": None if none else vec_id, "other": other, "score": -score})
        return pa.Table.from_pylist(found, schema=_FOUND_TYPES)

    return run


def searched(pages: DataFrame, queries: DataFrame, space: Space, k: int) -> DataFrame:
    """Each query's k best of its tree; queries (row, query_id, x, tree, block, floor) meet the tree's pages by blocks."""
    wanted = queries.select("tree", "block").distinct().toDF("tree", "block")
    return pages.join(wanted, "tree").groupBy("tree", "block").cogroup(queries.groupBy("tree", "block")).applyInArrow(_searched(space, k), FOUND)


def _reached(space: Space):
    def run(key: tuple[pa.Scalar, ...], roots: pa.Table, queries: pa.Table) -> pa.Table:
        picked: dict[str, list] = {"row": [], "tree": []}
        if roots.num_rows and queries.num_rows:
            x = space.load(queries.column("x").to_pylist())
            lengths = np.einsum("ij,ij->i", x.astype(float), x.astype(float))
            floors = np.array([np.nan if f is None else f for f in queries.column("floor").to_pylist()], float)
            reach = np.where(np.isnan(floors), np.inf, space.from_query(lengths, floors)) + space.slack
            rows, own = np.array(queries.column("row")), np.array(queries.column("tree"))
            centers, radii, trees = space.load(roots.column("object").to_pylist()), np.array(roots.column("reach")), np.array(roots.column("tree"))
            far = space.from_query(lengths[:, None], x.astype(float) @ centers.T.astype(float)) - radii - space.slack
            at, to = np.nonzero((far <= reach[:, None]) & (own[:, None] != trees))
            picked = {"row": rows[at], "tree": trees[to]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in picked.items()})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by every, the k rows of largest inner product.

    Entries count as floor(256 * entry); the scores are exact integers. All rows but the query's own are candidates, also
    those that repeat it; fewer than k give as many; ties go to the smaller vec_id, null last. Rows whose vector is null
    or empty or has null, NaN or infinite entries take no part; shorter vectors count as ending in zeros; scores that
    could leave 64 bits are an error. A query that stands in several rows is answered for each. Other columns are ignored.
    """
    table, space = points(vectors)
    placed = written(place(table, space))
    pages = written(build(placed, space))
    asked = placed.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    first = written(searched(pages, asked.withColumn("floor", F.lit(None).cast("long")), space, k))
    floors = first.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select("row", "floor")
    asked = written(asked.join(floors, "row", "left"))
    # the roots' objects and radii meet the queries in blocks of either
    roots = pages.where("node = 0").select("tree", "object", "reach")
    root_blocks = max(1, -(-roots.count() // ROOTS))
    dealt = roots.withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(root_blocks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(root_blocks - 1).cast("long"))))
    pairs = dealt.groupBy("part", "block").cogroup(spread.groupBy("part", "block")).applyInArrow(_reached(space), "row long, tree long")
    rest = searched(pages, asked.drop("tree").join(pairs, "row"), space, k)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

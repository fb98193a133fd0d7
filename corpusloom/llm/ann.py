"""Largest inner products by vantage-point trees, one per shard.

An extra component sqrt(M^2 - |x|^2), M the largest length, turns the largest inner product into the
smallest Euclidean distance, where the triangle inequality holds. A vantage-point tree over a bounded
sample cuts space into cells; every row goes down it to its cell, and a cell's rows are dealt to
shards of a bounded size, each with a tree of its own that is kept as one row. A query first meets
its home cell. The k-th distance found there, and each cell's ranges of distances to the vantage
points above it, tell which other cells it must be sent to; there a subtree is skipped on the same
grounds: when its least possible distance, times the factor, exceeds the k-th one. Factor one is exact
search, larger factors skip more. So what is shuffled is the rows once and each query once for each
cell that it visits.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, written

#: Rows of a shard, queries of a block, rows of a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF = 8192, 4096, 128
#: Bounds of the upper tree: cells, and rows and bytes of the sample it is built on.
CELLS, SAMPLE_ROWS, SAMPLE_BYTES = 4096, 16_384, 64 << 20
#: Triangle-inequality pruning is relaxed by this; 1.0 restores exact search.
FACTOR = 1.0


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: no null, zero or non-finite vectors, no null id."""
    bad = "v is null or size(v) = 0 or exists(v, x -> x is null) or exists(v, x -> isnan(x) or abs(x) = double('infinity')) or forall(v, x -> x = 0)"
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return out.where(f"vec_id is not null and not coalesce({bad}, true)")


def lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """The rows with the extra component that gives all of them the length ``longest``."""
    return np.column_stack([rows, np.sqrt(np.maximum(0.0, longest * longest - (rows * rows).sum(axis=1)))])


def apart(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - vantage) ** 2).sum(axis=1))


def vantage_point(points: np.ndarray, rng) -> np.ndarray:
    """Of a few points the one from which the distances of some others spread most."""
    tried = points[rng.choice(len(points), min(8, len(points)), replace=False)]
    probe = points[rng.choice(len(points), min(64, len(points)), replace=False)]
    return tried[int(np.argmax([apart(probe, t).std() for t in tried]))].copy()


class Cells:
    """The upper tree: a path of vantage points, each with the half of the sample that lies nearer, leads to every cell."""

    def __init__(self, sample: np.ndarray, longest: float, many: int, seed: int = 5):
        self.longest, rng = longest, np.random.default_rng(seed)
        self.vantages: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int]] = []  # a cell is written as -1 - its number
        self.paths: list[list[int]] = []
        points = lifted(sample, longest)

        def grow(own: np.ndarray, path: list[int], share: int) -> int:
            if share <= 1 or len(own) < 4:
                self.paths.append(path)
                return -len(self.paths)
            at = len(self.vantages)
            self.vantages.append(vantage_point(points[own], rng))
            far = apart(points[own], self.vantages[at])
            sort = np.argsort(far, kind="stable")
            mid = len(own) // 2
            self.radii.append(float(far[sort[mid]]))
            self.children.append((0, 0))
            self.children[at] = (grow(own[sort[:mid]], [*path, at], share // 2), grow(own[sort[mid:]], [*path, at], share - share // 2))
            return at

        self.root = grow(np.arange(len(sample)), [], many)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            at, own = todo.pop()
            if at < 0:
                out[own] = -1 - at
            elif len(own):
                near = apart(points[own], self.vantages[at]) < self.radii[at]
                todo += [(self.children[at][0], own[near]), (self.children[at][1], own[~near])]
        return out

    def ranges(self, cell: int, points: np.ndarray) -> tuple[list[float], list[float]]:
        """Least and largest distance of the points to each vantage point of the cell's path."""
        far = [apart(points, self.vantages[v]) for v in self.paths[cell]]
        return [float(x.min()) for x in far], [float(x.max()) for x in far]

    def bounds(self, points: np.ndarray, known: dict[int, tuple[list, list]]) -> dict[int, np.ndarray]:
        """By cell of ``known`` (its ranges): how near any of its rows can lie to each point."""
        far = {v: apart(points, self.vantages[v]) for v in {v for c in known for v in self.paths[c]}}
        out = {}
        for cell, (low, high) in known.items():
            least = np.zeros(len(points))
            for v, a, b in zip(self.paths[cell], low, high):
                np.maximum(least, np.maximum(a - far[v], far[v] - b), out=least)
            out[cell] = least
        return out


class Tree:
    """Nodes over a permutation of the rows: leaves are slices, inner nodes hold a vantage point and both sides' distance ranges.

    Every node is cut in the middle, whatever ties there are, so the depth is the logarithm of the rows.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, longest: float, seed: int = 7, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.points = lifted(self.rows, longest)
        self.nodes: list[tuple] = []
        self.perm = np.arange(len(ids))
        self._build(0, len(ids), np.random.default_rng(seed), leaf)

    def _build(self, start: int, stop: int, rng, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        own = self.perm[start:stop]
        if len(own) <= leaf:
            self.nodes[at] = ("leaf", start, stop)
            return at
        vantage = vantage_point(self.points[own], rng)
        far = apart(self.points[own], vantage)
        sort = np.argsort(far, kind="stable")
        self.perm[start:stop] = own[sort]
        far, mid = far[sort], len(own) // 2
        near = self._build(start, start + mid, rng, leaf)
        away = self._build(start + mid, stop, rng, leaf)
        self.nodes[at] = ("node", vantage, (far[0], far[mid - 1], far[mid], far[-1]), near, away)
        return at

    def search(self, ids: np.ndarray, rows: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and row numbers (queries x k, padded with -inf), and how many products were made; rows stand in order of id.

        ``floor`` has each query's k-th score found elsewhere.
        """
        n = len(ids)
        points = np.column_stack([rows, np.zeros(n)])
        norm = float((self.points[0] ** 2).sum()) + (rows * rows).sum(axis=1)
        best, who = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        floor = np.full(n, -np.inf) if floor is None else floor
        made = 0

        def visit(leaf: tuple, q: np.ndarray) -> None:
            nonlocal made
            own = self.perm[leaf[1] : leaf[2]]
            score = np.einsum("ij,kj->ik", rows[q], self.rows[own])
            made += score.size
            score[ids[q][:, None] == self.ids[own][None, :]] = -np.inf
            score = np.concatenate([best[q], score], axis=1)
            name = np.concatenate([who[q], np.broadcast_to(own, (len(q), len(own)))], axis=1)
            top = np.lexsort((name, -score), axis=1)[:, :k]
            best[q], who[q] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)

        def distance(vantage: np.ndarray, q: np.ndarray) -> np.ndarray:
            return np.sqrt(((points[q] - vantage) ** 2).sum(axis=1))

        home = np.full(n, -1)

        def descend(at: int, q: np.ndarray) -> None:
            node = self.nodes[at]
            if node[0] == "leaf":
                home[q] = at
                visit(node, q)
                return
            near = distance(node[1], q) <= (node[2][1] + node[2][2]) / 2
            for child, part in ((node[3], q[near]), (node[4], q[~near])):
                if len(part):
                    descend(child, part)

        def walk(at: int, q: np.ndarray) -> None:
            node = self.nodes[at]
            if node[0] == "leaf":
                q = q[home[q] != at]
                if len(q):
                    visit(node, q)
                return
            d = distance(node[1], q)
            a, b, c, e = node[2]
            least = (np.maximum(0, np.maximum(d - b, a - d)), np.maximum(0, np.maximum(c - d, d - e)))
            for side in np.argsort([least[0].mean(), least[1].mean()], kind="stable"):
                kth = np.sqrt(np.maximum(0.0, norm[q] - 2 * np.maximum(best[q, -1], floor[q])))
                go = least[side] * factor <= kth * (1 + 1e-9) + 1e-9
                if go.any():
                    walk(node[3 + side], q[go])

        if n and len(self.ids):
            everyone = np.arange(n)
            if not np.isfinite(floor).all():
                descend(0, everyone)
            walk(0, everyone)
        return best, who, made


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


@dataclass
class Index:
    """``cells`` by number of components; ``shards`` (dim, cell, part, low, high, tree) with every row in one tree."""

    cells: dict[int, Cells]
    shards: DataFrame

    def ranges(self) -> dict[int, dict[int, tuple[list, list]]]:
        """By dim and cell: the ranges over its shards; as many rows as the upper trees have cells."""
        spread = self.shards.select("dim", "cell", F.posexplode_outer(F.arrays_zip("low", "high")).alias("at", "r"))
        spread = spread.groupBy("dim", "cell", "at").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
        rows = spread.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("r")).collect()
        out: dict = {}
        for row in rows:
            own = [x for x in row.r if x.at is not None]
            out.setdefault(row.dim, {})[row.cell] = ([x.low for x in own], [x.high for x in own])
        return out


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> Index:
    """Every usable row of ``vectors`` (vec_id, embedding) in one shard of about ``shard_rows``; rows of other lengths keep apart.

    Only the upper trees are built on a sample, of the smallest hashes. Rows that repeat stay rows of
    their own, a vec_id that repeats too; further columns are ignored; an empty table has no shards.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    base = usable(vectors).withColumn("dim", F.size("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = {r.dim: (r.n, r.longest * (1 + 1e-12)) for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).collect()}
    split = {d: min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d) + 1) / n for d, (n, _) in sizes.items() if n > shard_rows}
    drawn: dict = {}
    if split:
        share = F.element_at(F.create_map(*[F.lit(x) for d, s in split.items() for x in (d, float(s))]), F.col("dim"))
        some = base.where(F.col("dim").isin(*split)).where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30))
        for r in some.select("dim", "vec_id", "v").collect():
            drawn.setdefault(r.dim, []).append((r.vec_id, r.v))
    cells = {}
    for dim, (n, longest) in sizes.items():
        rows = np.array([v for _, v in sorted(drawn.get(dim, []))], np.float64).reshape(-1, dim)
        cells[dim] = Cells(rows, longest, min(CELLS, -(-n // shard_rows)) if len(rows) else 1)
    sent = spark.sparkContext.broadcast(cells)

    def place(batches):
        for batch in batches:
            dims, rows = np.asarray(batch.column(2)), batch.column(1)
            home = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                upper = sent.value[int(dim)]
                home[own] = upper.home(lifted(_matrix(rows.take(pa.array(own))), upper.longest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], ["vec_id", "v", "dim", "cell"])

    placed = written(base.select("vec_id", "v", "dim").mapInArrow(place, "vec_id long, v array<double>, dim int, cell int"), "placed")
    parts = placed.groupBy(F.col("dim").alias("_dim"), F.col("cell").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell")))  # a row per cell at most
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def grow(key, rows):
        dim, cell, part = (k.as_py() for k in key)
        upper = sent.value[dim]
        tree = Tree(np.asarray(rows["vec_id"]), _matrix(rows["v"]), upper.longest)
        low, high = upper.ranges(cell, tree.points)
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "part": pa.array([part], pa.int32()), "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64())), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    shards = dealt.select("dim", "cell", "part", "vec_id", "v").groupBy("dim", "cell", "part").applyInArrow(grow, "dim int, cell int, part int, low array<double>, high array<double>, tree binary")
    return Index(cells, written(shards, "shards"))


def met(index: Index, visits: DataFrame, k: int, factor: float, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, vec_id, score) of the best in each shard of the cells that ``visits`` (dim, cell, vec_id, v, floor) name; in blocks of queries."""
    load = visits.groupBy("dim", "cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / query_rows)).cast("int").alias("blocks"))
    names = index.shards.select("dim", "cell", "part").join(load, ["dim", "cell"])
    sent = visits.join(names, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"))
    trees = index.shards.select("dim", "cell", "part", "tree").join(load, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def find(left, right):
        out = {"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)}
        if len(left) and len(right):
            own, rows, floor = np.asarray(left["vec_id"]), _matrix(left["v"]), np.asarray(left["floor"], np.float64)
            tree = pickle.loads(right["tree"][0].as_py())
            best, place, _ = tree.search(own, rows, k, factor, floor)
            q, j = np.nonzero(np.isfinite(best))
            at = place[q, j]
            # left to right, as a plain loop over the components adds
            out = {"query_id": own[q], "vec_id": tree.ids[at], "score": np.add.accumulate(rows[q] * tree.rows[at], axis=1)[:, -1]}
        return pa.table(out)

    key = ["dim", "cell", "part", "block"]
    sent = sent.select(*key, "vec_id", "v", "floor").groupBy(*key)
    own = [f"_{c}" for c in key]  # both sides come from the same tables
    return sent.cogroup(trees.select(*key, "tree").toDF(*own, "tree").groupBy(*own)).applyInArrow(find, "query_id long, vec_id long, score double")


def nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def visits(index: Index, asked: DataFrame, factor: float | None = None) -> DataFrame:
    """(dim, cell, vec_id, v, floor): where queries (dim, vec_id, v, floor) go: home without a factor, else to all other cells that may hold nearer rows."""
    sent = asked.sparkSession.sparkContext.broadcast((index.cells, None if factor is None else index.ranges()))

    def route(batches):
        upper, known = sent.value
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims):
                if int(dim) not in upper:
                    continue
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                rows, own = _matrix(part.column(2)), upper[int(dim)]
                points = np.column_stack([rows, np.zeros(len(rows))])
                home = own.home(points)
                to = [(np.arange(len(rows)), home)]
                if factor is not None:
                    kth = np.sqrt(np.maximum(0.0, own.longest**2 + (rows * rows).sum(axis=1) - 2 * np.asarray(part.column(3), np.float64)))
                    least = own.bounds(points, known.get(int(dim), {}))
                    to = [(np.flatnonzero((b * factor <= kth * (1 + 1e-9) + 1e-9) & (home != c)), np.int32(c)) for c, b in least.items()]
                for q, cell in to:
                    if len(q):
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), pa.array(np.broadcast_to(cell, len(q)).astype(np.int32)), *(part.column(i).take(pa.array(q)) for i in (1, 2, 3))], ["dim", "cell", "vec_id", "v", "floor"])

    return asked.select("dim", "vec_id", "v", "floor").mapInArrow(route, "dim int, cell int, vec_id long, v array<double>, floor double")


def search(index: Index, queries: DataFrame, k: int = 20, factor: float = FACTOR, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query (vec_id, embedding).

    A query is never its own neighbour. Of queries that repeat a vec_id the smallest vector asks;
    a vec_id that repeats among the rows comes out as often as it is near. Ties go to the smaller
    vec_id. Unusable queries, and queries of a length that no row has, find nothing.
    """
    arrow_batches(queries.sparkSession)
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = written(asked.withColumn("floor", F.lit(float("-inf"))), "queries")
    first = written(met(index, visits(index, asked), k, factor, query_rows), "home")
    kth = nearest(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    again = asked.drop("floor").join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    others = written(visits(index, again, factor), "visits")
    found = first.unionByName(met(index, others, k, factor, query_rows))
    return nearest(found, k).select("query_id", "rank", "vec_id", "score")

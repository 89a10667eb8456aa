"""Exact top-k search by inner product: cover trees over queries and data, walked together."""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import cut, discard, scratch, table
from docketry.llm.vectors import matrix, products, usable

#: Rows of a block of data and of queries, each with a tree of its own, and of a leaf of these.
DATA_ROWS, QUERY_ROWS, DATA_LEAF, QUERY_LEAF = 2048, 256, 128, 32
#: Children of a node at most, and vectors that the top of the tree is fitted to at most: it decides where rows lie, not what is found.
FAN, SAMPLE, CELLS = 16, 8192, 512
#: Children of a node at the top, few so that a cell holds blocks of about DATA_ROWS rows.
TOP_FAN = 4
#: Blocks that each group of queries meets first, to know how good its answers are at least.
FIRST = 3
NONE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Tree:
    """Nodes breadth first. A node's points lie side by side from `lo` to `hi`, none farther than `radius` from its centre, which is one of them."""

    order: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    kids: np.ndarray
    norms: np.ndarray


def build(points: np.ndarray, leaf: int, fan: int = FAN) -> Tree:
    """A cover tree of the points. The children of a node are centres taken farthest first, the node's own before all, until they cover it at half its radius or `fan` are taken.

    So every point lies within a level's scale of its centre, centres of one node are at least that scale apart, and a
    node's centre is its first child's. A node of at most `leaf` points, or of equal ones, has no children.
    """
    f = points.astype(np.float64)
    order = np.arange(len(f))
    away = np.linalg.norm(f - f[int(np.argmin(np.linalg.norm(f - f.mean(axis=0), axis=1)))], axis=1)
    nodes, kids = [(0, len(f), int(np.argmin(away)), float(away.max()))], []
    while len(kids) < len(nodes):
        lo, hi, centre, radius = nodes[len(kids)]
        first = len(nodes)
        if hi - lo > leaf and radius > 0:
            own = order[lo:hi]
            near = np.linalg.norm(f[own] - f[centre], axis=1)
            owner, centres = np.zeros(hi - lo, np.int64), [centre]
            while len(centres) < fan and near[far := int(np.argmax(near))] > radius / 2:
                away = np.linalg.norm(f[own] - f[own[far]], axis=1)
                closer = away < near
                near[closer], owner[closer] = away[closer], len(centres)
                centres.append(int(own[far]))
            by = np.argsort(owner, kind="stable")
            order[lo:hi], near = own[by], near[by]
            ends = np.cumsum(np.bincount(owner, minlength=len(centres))).tolist()
            nodes += [(lo + a, lo + b, c, float(near[a:b].max())) for a, b, c in zip([0, *ends], ends, centres, strict=False)]
        kids.append((first, len(nodes)))
    lo, hi, centre, radius = (np.array(c) for c in zip(*nodes, strict=True))
    return Tree(order, f[centre], radius.astype(np.float64), lo, hi, np.array(kids), np.linalg.norm(f[centre], axis=1))


def bounds(q: Tree | np.ndarray, d: Tree | np.ndarray) -> np.ndarray:
    """No inner product of a point of a node of q and one of d is above this: by centres and covering radii, with room for rounding."""
    reach = q.radius[:, None] * d.norms + q.norms[:, None] * d.radius + q.radius[:, None] * d.radius
    return q.centres @ d.centres.T + reach + 1e-9 * (q.norms[:, None] * d.norms + reach) + 1


class Search:
    """The best k of one block of data for each query of a block, no worse than what the queries have already."""

    def __init__(self, queries: "Block", data: "Block", least: np.ndarray, k: int):
        self.q, self.d, self.k = queries, data, k
        self.least = least.copy()
        self.scores, self.ids = np.full((len(least), k), NONE), np.full((len(least), k), NO_ID)
        self.compared = 0
        self.bound = bounds(queries.tree, data.tree)
        self.repeats = len(np.unique(data.ids)) < len(data.ids)

    def run(self) -> "Search":
        q, d, stack = self.q.tree, self.d.tree, [(0, 0)]
        while stack:
            a, b = stack.pop()
            if self.bound[a, b] < self.least[q.lo[a] : q.hi[a]].min():
                continue
            a_leaf, b_leaf = q.kids[a, 0] == q.kids[a, 1], d.kids[b, 0] == d.kids[b, 1]
            if a_leaf and b_leaf:
                self.compare(slice(q.lo[a], q.hi[a]), slice(d.lo[b], d.hi[b]))
            elif a_leaf or (not b_leaf and d.radius[b] >= q.radius[a]):
                kids = np.arange(*d.kids[b])
                stack += [(a, int(x)) for x in kids[np.argsort(self.bound[a, kids], kind="stable")]]
            else:
                kids = np.arange(*q.kids[a])
                stack += [(int(x), b) for x in kids]
        return self

    def compare(self, a: slice, b: slice) -> None:
        scores = products(self.q.x[a], self.d.x[b])
        self.compared += scores.size
        if scores.dtype == object:
            if scores.size and max(abs(int(scores.max())), abs(int(scores.min()))) > NO_ID:
                raise OverflowError("a score is too large for a 64-bit integer")
            scores = scores.astype(np.int64)
        ids = np.broadcast_to(self.d.ids[b], scores.shape)
        hit = (scores >= self.least[a, None]) & (ids != self.q.ids[a, None])
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            return
        at = rows + a.start
        scores = np.hstack([self.scores[at], np.where(hit[rows], scores[rows], NONE)])
        ids = np.hstack([self.ids[at], np.where(hit[rows], ids[rows], NO_ID)])
        by = np.lexsort((ids, ~scores), axis=1)
        scores, ids = np.take_along_axis(scores, by, 1), np.take_along_axis(ids, by, 1)
        if self.repeats:  # an id counts once, by its best score
            for r in range(len(rows)):
                _, first = np.unique(ids[r], return_index=True)
                again = np.ones(ids.shape[1], bool)
                again[first] = False
                scores[r], ids[r] = np.where(again, NONE, scores[r]), np.where(again, NO_ID, ids[r])
                order = np.lexsort((ids[r], ~scores[r]))
                scores[r], ids[r] = scores[r][order], ids[r][order]
        self.scores[at], self.ids[at] = scores[:, : self.k], ids[:, : self.k]
        self.least[at] = np.maximum(self.least[at], self.scores[at, -1])


@dataclass
class Block:
    ids: np.ndarray
    x: np.ndarray
    tree: Tree

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, leaf: int) -> "Block":
        tree = build(x, leaf)
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.abs(x).max(initial=0) <= np.iinfo(t).max)
        return cls(ids[tree.order], x[tree.order].astype(kind), tree)

    def packed(self) -> bytes:
        return pickle.dumps(self, protocol=5)


BLOCK = "block long, cell int, n int, centre array<double>, radius double, packed binary"


def _placed(rows: DataFrame, d: int, scale: float, top: Tree) -> DataFrame:
    """Rows with the cell of the top tree whose centre is nearest and the distance from it: (cell, away, id, vector)."""
    leaves = np.flatnonzero(top.kids[:, 0] == top.kids[:, 1])
    centres = top.centres[leaves[np.argsort(top.lo[leaves])]]  # in the tree's order: near ones side by side
    half = (centres**2).sum(axis=1) / 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d, scale).astype(np.float64)
            cell = np.argmax(x @ centres.T - half, axis=1)
            away = np.linalg.norm(x - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(away), batch.column(0), batch.column(1)], ["cell", "away", "id", "vector"])

    return rows.mapInArrow(place, "cell int, away double, id long, vector array<double>")


def _blocks(placed: DataFrame, d: int, scale: float, parts: int, size: int, leaf: int, apart: bool) -> DataFrame:
    """Blocks of at most `size` rows that lie near each other, each with its tree. Data blocks keep to one cell, query blocks don't.

    Rows are dealt by ranges of cell and distance, of id and a row number for equal ones, so that no cell is a task's alone.
    """
    keys = ("cell", "away", "id", "nth")
    dealt = placed.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, []

        def one(part: int) -> pa.RecordBatch:
            nonlocal made
            cell = held[0][0]
            block = Block.of(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), leaf)
            number, made = (part << 32) + made, made + 1
            held.clear()
            root = block.tree
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([cell], pa.int32()), pa.array([len(block.ids)], pa.int32()), pa.array([root.centres[0].tolist()]), pa.array([float(root.radius[0])]), pa.array([block.packed()])], ["block", "cell", "n", "centre", "radius", "packed"])

        part = 0
        for batch in batches:
            cells, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            x, at = matrix(batch.column(2), d, scale), 0
            part = batch.column(3)[0].as_py() if len(ids) else part
            while at < len(ids):
                same = cells[at:] == cells[at]
                stop = len(ids) if not apart or same.all() else at + int(np.argmin(same))
                if held and apart and held[0][0] != cells[at]:
                    yield one(part)
                room = size - sum(len(h[1]) for h in held)
                stop = min(stop, at + room)
                held.append((int(cells[at]), ids[at:stop], x[at:stop]))
                at = stop
                if sum(len(h[1]) for h in held) == size:
                    yield one(part)
        if held:
            yield one(part)

    return dealt.select("cell", "id", "vector", F.spark_partition_id().alias("part")).mapInArrow(pack, BLOCK)


def _heads(rows: list) -> Tree:
    """Centres and radii of collected cells, in the shape that bounds() takes."""
    centres = np.array([r.centre for r in rows], np.float64).reshape(len(rows), -1)
    return Tree(None, centres, np.array([r.radius for r in rows], np.float64), None, None, None, np.linalg.norm(centres, axis=1))


def _cells(data: DataFrame) -> list:
    """A row for each cell, CELLS at most: the centre of its largest block, how far its blocks reach from that, and that block."""
    largest = data.groupBy("cell").agg(F.max_by(F.struct("block", "centre", "n"), F.struct("n", "block")).alias("of"))
    away = F.sqrt(F.aggregate(F.zip_with("centre", "of.centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return data.select("cell", "centre", "radius").join(largest, "cell").groupBy("cell").agg(F.max(away + F.col("radius")).alias("radius"), F.first("of").alias("of")).select("cell", "radius", "of.*").collect()


def _searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """The answers of (query block, block, least scores) pairs: (qblock, at, query_id, id, score)."""
    joined = pairs.join(queries.select(F.col("block").alias("qblock"), F.col("packed").alias("asked")), "qblock").join(data.select("block", "packed"), "block").select("qblock", "least", "asked", "packed")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, least, asked, packed in zip(*(batch.column(i) for i in range(4)), strict=True):
                q, d = pickle.loads(asked.as_buffer()), pickle.loads(packed.as_buffer())
                start = np.full(len(q.ids), NONE) if not least.is_valid else np.asarray(least.values, np.int64)
                found = Search(q, d, start, k).run()
                at, rank = np.nonzero(found.ids != NO_ID)
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * m, pa.int64()), pa.array(at, pa.int32()), pa.array(q.ids[at]), pa.array(found.ids[at, rank]), pa.array(found.scores[at, rank])], ["qblock", "at", "query_id", "id", "score"])

    return joined.mapInArrow(search, "qblock long, at int, query_id long, id long, score long")


def _least(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qblock, least): what the k-th answer of each query of a block scores at least, in the block's order."""
    best = Window.partitionBy("qblock", "at").orderBy(F.desc("score"))
    known = found.groupBy("qblock", "at", "id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k)
    by_query = known.groupBy("qblock").agg(F.map_from_entries(F.collect_list(F.struct("at", "score"))).alias("known"))  # QUERY_ROWS entries at most
    listed = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("known", i), F.lit(int(NONE))))
    return queries.select(F.col("block").alias("qblock"), "n", "centre", "radius").join(by_query, "qblock", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<int,bigint>"))).withColumn("least", listed)


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best other rows by the integer inner product of floor(scale * component); ties go to the smaller id.

    Rows of a null id, and vectors that are null or hold a null or an entry that isn't finite, take no part; a shorter
    vector counts as one with zeros at its end. Rows of one id count once, as query and as answer, by their best score, and never answer each other.
    Other columns are ignored; an empty table, or one without queries, gives no rows; scores beyond 64-bit integers end the query with an error.

    Data and queries are dealt to blocks by a tree that is fitted to a sample of at most SAMPLE vectors; every row is indexed. Each block has a cover tree.
    Groups of queries meet a few blocks first; pairs of groups and cells, of groups and blocks, and of nodes inside them are left out where centres
    and covering radii keep every product below the group's worst k-th score, so results are exact whatever the sample.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = df.sparkSession
    rows = usable(df.withColumn("_query", F.coalesce(is_query, F.lit(False))).where(F.col(id_col).isNotNull()), id_col, vector_col, "_query").withColumn("id", F.col("id").cast("long"))
    n, asked, d = rows.agg(F.count("*"), F.count_if("_query"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    share = min(1.0, SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(SAMPLE).toArrow()
    fitted = matrix(sample.column(0).combine_chunks(), d, scale) if len(sample) else np.zeros((1, d), np.int64)
    top = build(fitted, max(1, -(-len(fitted) // max(1, min(CELLS // TOP_FAN, n // DATA_ROWS)))), TOP_FAN)
    path = scratch(spark, "cover-tree")
    ask = rows.where("_query").dropDuplicates(["id", "vector"])
    _blocks(_placed(rows.select("id", "vector"), d, scale, top), d, scale, n // (4 * DATA_ROWS) + 1, DATA_ROWS, DATA_LEAF, True).write.parquet(f"{path}/data")
    _blocks(_placed(ask.select("id", "vector"), d, scale, top), d, scale, asked // (4 * QUERY_ROWS) + 1, QUERY_ROWS, QUERY_LEAF, False).write.parquet(f"{path}/queries")
    data, queries = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/queries")
    cells = _cells(data)
    heads, first_blocks = _heads(cells), np.array([c.block for c in cells])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(0))
            centres = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(at), -1)
            best = np.argsort(-(centres @ heads.centres.T), axis=1, kind="stable")[:, :FIRST]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, best.shape[1])), pa.array(first_blocks[best].ravel())], ["qblock", "block"])

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, least = np.asarray(batch.column(0)), batch.column(3)
            centres = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(at), -1)
            q = Tree(None, centres, np.asarray(batch.column(2)), None, None, None, np.linalg.norm(centres, axis=1))
            worst = np.array([min(x.as_py()) for x in least], np.float64)
            i, j = np.nonzero(bounds(q, heads) >= worst[:, None])
            again = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), batch.column(2).take(again), least.take(again), pa.array(worst[i]), pa.array([cells[x].cell for x in j], pa.int32())], ["qblock", "q_centre", "q_radius", "least", "worst", "cell"])

    tried = queries.select("block", "centre").mapInArrow(nearest, "qblock long, block long")
    before = cut(_searched(tried.withColumn("least", F.lit(None).cast("array<bigint>")), queries, data, k))
    known = _least(before, queries, k).select("qblock", "centre", "radius", "least")
    near = known.mapInArrow(reachable, "qblock long, q_centre array<double>, q_radius double, least array<bigint>, worst double, cell int")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda c: F.sqrt(dot(c, c))
    reach = F.col("q_radius") * size("centre") + F.col("radius") * size("q_centre") + F.col("q_radius") * F.col("radius")
    bound = dot("q_centre", "centre") + reach + 1e-9 * (size("q_centre") * size("centre") + reach) + 1
    pairs = near.join(data.select("block", "cell", "centre", "radius"), "cell").where(bound >= F.col("worst")).select("qblock", "block", "least").join(tried, ["qblock", "block"], "left_anti")
    found = before.unionByName(_searched(pairs, queries, data, k)).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"))
    discard(spark, path)
    return ranked


def op11_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")

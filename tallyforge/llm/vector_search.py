"""Exact top-k by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyforge.llm.shared import table, written

SCALE = 1024
TOP = 10
LEAF = 128
#: Vectors in one shard's tree, which with a batch of queries is what a task holds.
SHARD_VECTORS = 8192
#: Shards that a query has searched after each round; its k-th best score so far goes along to the next.
ROUNDS = (1, 4, 16)
#: Parts of one shuffle, at most; a part holds several shards beyond that, one after the other.
SHUFFLE_PARTS = 1 << 15
RESULT = "query_id long, vec_id long, score long"


class KdTree:
    """Median splits on the widest side, with the tight box of every node."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.nodes: list[tuple[int, int, int, int]] = []  # begin, end, left, right (-1 for a leaf)
        lows, highs = [], []
        place = np.arange(len(ids))
        stack = [(0, len(ids), -1, 0)]
        while stack:
            begin, end, parent, side = stack.pop()
            here = self.points[place[begin:end]]
            low, high = here.min(axis=0), here.max(axis=0)
            me = len(self.nodes)
            self.nodes.append((begin, end, -1, -1))
            lows.append(low)
            highs.append(high)
            if parent >= 0:
                b, e, x, y = self.nodes[parent]
                self.nodes[parent] = (b, e, me, y) if side == 0 else (b, e, x, me)
            widest = int(np.argmax(high - low))
            if end - begin > leaf and high[widest] > low[widest]:
                middle = (end - begin) // 2
                parted = np.argpartition(here[:, widest], middle, kind="introselect")
                place[begin:end] = place[begin:end][parted]
                stack += [(begin, begin + middle, me, 0), (begin + middle, end, me, 1)]
        self.ids, self.points = self.ids[place], self.points[place]
        self.lows, self.highs = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that a point of each node's box can have with each query."""
        return np.maximum(queries, 0) @ self.highs.T + np.minimum(queries, 0) @ self.lows.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: int | None):
        """``(score, vec_id)`` of the best k, best first; ``floor`` is a k-th score that others have reached."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        queue = [(-int(bounds[0]), 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else None
            least = floor if least is None or (floor is not None and floor > least) else least
            if least is not None and -bound < least:  # equal scores may still win by id
                break
            begin, end, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(queue, (-int(bounds[left]), left))
                heapq.heappush(queue, (-int(bounds[right]), right))
                continue
            scores = self.points[begin:end] @ query
            ids = self.ids[begin:end]
            good = ids != query_id
            if least is not None:
                good &= scores >= least
            scores, ids = scores[good], ids[good]
            if len(scores) > k:
                first = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[first], ids[first]
            for item in zip(scores.tolist(), (-ids).tolist()):
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def whole_vector(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, or null for a vector that is null or has a null or non-finite one."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = vector.isNotNull() & ~F.exists(vector, bad)
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


ROWS = ["dim", "shard", "asked", "id", "floor", "v"]


def _search_sorted(k: int):
    """Searches rows sorted by shard, each shard's vectors before its queries: builds the tree, then streams queries by it."""

    def answers(tree: KdTree, ids: np.ndarray, asked: np.ndarray, floors: list) -> pa.RecordBatch:
        bounds = tree.bounds(asked)
        found = [(q, vec, score) for i, (q, floor) in enumerate(zip(ids.tolist(), floors)) for score, vec in tree.search(q, asked[i], bounds[i], k, floor)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))], ["query_id", "vec_id", "score"])

    def run(batches):
        key, held, tree = None, [], None
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(ROWS)}
            dim, shard, asked, ids = (np.asarray(columns[c]) for c in ROWS[:4])
            flat = np.asarray(columns["v"].flatten())
            offset = np.concatenate(([0], np.cumsum(dim)))
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(asked) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if i == j:
                    continue
                points = flat[offset[i] : offset[j]].reshape(j - i, -1)
                if key != (dim[i], shard[i]):
                    key, held, tree = (dim[i], shard[i]), [], None
                if not asked[i]:
                    held.append((ids[i:j], points))
                elif held or tree:
                    if tree is None:
                        tree, held = KdTree(*(np.concatenate(x) for x in zip(*held))), []
                    yield answers(tree, ids[i:j], points, columns["floor"].slice(i, j - i).to_pylist())

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows by integer inner product, ties to smaller ids.

    Queries are the rows of ``vectors`` for which ``is_query`` holds; every row but those with the query's own
    id is a candidate.  Components count as ``floor(1024 * x)``.  Vectors that are null or empty or hold a null
    or non-finite component take no part, nor do rows without an id; vectors are compared only with those of their own
    length; rows that repeat an id are candidates each.  Ids are whole numbers, others are refused.  Scores are
    64-bit numbers, so components must stay below 2**28 or so.  Fewer candidates than k give fewer rows; an empty
    table gives none.

    Rows are dealt to shards by a hash of their id and place.  In a few rounds each query goes to more shards: its
    home first, and the k-th best score found so far goes along to the next ones.  A task sorts its shard's
    vectors before the shard's queries, builds the tree once and streams the queries by it, so vectors are
    shuffled once a round and a task holds one shard and a batch of queries.
    """
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise ValueError(f"ids must be whole numbers: {id_col}")
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("asked"), whole_vector(F.col(vector_col)).alias("v")).where("size(v) > 0 AND id IS NOT NULL")
    whole = written(whole.withColumn("dim", F.size("v")).withColumn("place", F.monotonically_increasing_id()))
    shards = max(1, -(-whole.count() // shard_vectors))
    none = F.lit(None).cast("long").alias("floor")
    cand = whole.select("dim", F.pmod(F.xxhash64("id", "place"), F.lit(shards)).alias("shard"), F.lit(0).alias("asked"), "id", none, "v")
    asked = written(whole.where("asked").select("dim", "id", "v").dropDuplicates(["id", "v"]))
    home = F.pmod(F.xxhash64("id", F.lit("home")), F.lit(shards))
    found, done = None, 0
    for upto in sorted({min(r, shards) for r in (*ROUNDS, shards)}):
        floors = asked.withColumn("floor", none)
        if found is not None:
            order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
            found = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
            kth = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            floors = asked.join(kth, "id", "left")
        turns = F.explode(F.sequence(F.lit(done).cast("long"), F.lit(upto - 1).cast("long")))
        dealt = floors.withColumn("turn", turns).select("dim", F.pmod(home + F.col("turn"), F.lit(shards)).alias("shard"), F.lit(1).alias("asked"), "id", "floor", "v")
        sorted_ = cand.unionByName(dealt).repartition(min(shards, SHUFFLE_PARTS), "dim", "shard").sortWithinPartitions("dim", "shard", "asked")
        fresh = sorted_.select(*ROWS).mapInArrow(_search_sorted(k), RESULT)
        found, done = fresh if found is None else found.unionByName(fresh), upto
    # One id may be asked with several vectors; such queries share their id's rows, as ranks by id do.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_vector_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op9_vector_search": op9_vector_search}

ORACLES = {
    "op9_vector_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""
}

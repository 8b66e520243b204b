"""Exact top-k inner-product search by best-first search of M-trees.

Integer vectors x get one more coordinate sqrt(M - |x|^2) (M: the largest squared norm), queries
get 0 there. Then |q - x|^2 = |q|^2 + M - 2 q.x, so the nearest neighbours in this metric are
the largest inner products.

The upper level of the tree is distributed: a bounded number of routing objects, medoids of a
bounded sample, to which every vector is dealt by distance, each with a covering radius. A query
goes to the most promising partition first; its k-th score there, carried on, spares it all
partitions whose lower bound is beyond. Below, a partition is cut into pages of bounded size, each
a tree in one task: metric nodes with a routing object, a covering radius and each child's
distance to its parent. Search pops the node with the least lower bound; |d(q,p) - d(x,p)|,
from stored parent distances, discards children before any distance to them is computed.

Scores are exact: int64 where a tree's sums cannot overflow; wider vectors are kept in a
partition of their own and scanned, in Python's integers where int64 does not hold the sums.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.storage import written

#: Partitions: at most PIVOTS, about one for PIVOT_VECTORS vectors, with routing objects from a
#: sample of at most PIVOT_SAMPLE vectors (fewer if they are long: SAMPLE_VALUES components in all).
PIVOTS, PIVOT_VECTORS, PIVOT_SAMPLE, SAMPLE_VALUES = 256, 4096, 4096, 1 << 20
#: Vectors of one tree, queries that meet it in one task, objects of a leaf page, children of an inner page.
PAGE_VECTORS, QUERY_BLOCK, LEAF, FANOUT = 8192, 4096, 64, 16
#: Sums of products below this size are taken in int64.
INT64_SUMS = 1 << 62
_SLACK = 1e-6  # relative, for the float distances that only prune
_NONE = -(2**63 - 1)  # below all scores
_WIDE = -1  # the partition of vectors too wide for int64 norms


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows of integers as points whose last coordinate makes all norms sqrt(top)."""
    flat = x.astype(np.float64)
    return np.concatenate([flat, np.sqrt(np.maximum(0.0, top - (flat * flat).sum(1)))[:, None]], 1)


class MTree:
    """An M-tree bulk-loaded by recursive pivot partitioning. ``x``: int64 rows, ``ids``: int64."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = LEAF, top: float | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        norms = (self.x * self.x).sum(1)
        self.top = float(norms.max() if len(norms) else 0) if top is None else top
        self.computed = 0  # scores and distances to routing objects, in all searches
        points = lifted(self.x, self.top)
        self.leaves: list[dict] = []
        self.root = self._build(points, np.arange(len(ids)), page) if len(ids) else None
        if self.root:  # rows in the order of the leaves
            order = np.concatenate([leaf.pop("rows") for leaf in self.leaves])
            self.ids, self.x = self.ids[order], self.x[order]
        self.exact = np.float64 if _largest(self.x) < 1 << 26 else np.int64  # of what products are taken, if the queries allow
        self.values = self.x.astype(self.exact)

    def _build(self, points: np.ndarray, rows: np.ndarray, page: int) -> dict:
        pts = points[rows]
        centre = pts.mean(0)
        route = points[rows[int(np.argmin(((pts - centre) ** 2).sum(1)))]]
        dist = np.sqrt(((pts - route) ** 2).sum(1))
        node = {"route": route, "radius": float(dist.max()), "children": None}
        if len(rows) > page and node["radius"] > 0:
            k = min(FANOUT, max(2, len(rows) // page))
            pivots = [int(np.argmax(dist))]  # farthest-first pivots
            near = np.sqrt(((pts - pts[pivots[0]]) ** 2).sum(1))
            owner = np.zeros(len(rows), dtype=np.int64)
            while len(pivots) < k and near.max() > 0:
                pivots.append(int(np.argmax(near)))
                d = np.sqrt(((pts - pts[pivots[-1]]) ** 2).sum(1))
                owner[d < near] = len(pivots) - 1
                near = np.minimum(near, d)
            parts = [rows[owner == j] for j in range(len(pivots))]
            parts = [p for p in parts if len(p)]
            if len(parts) > 1:
                node["children"] = [self._build(points, p, page) for p in parts]
                node["routes"] = np.stack([c["route"] for c in node["children"]])
                node["parent"] = np.sqrt(((node["routes"] - route) ** 2).sum(1))
                return node
        lo = self.leaves[-1]["hi"] if self.leaves else 0
        node |= {"rows": rows, "lo": lo, "hi": lo + len(rows), "parent": dist, "number": len(self.leaves)}
        self.leaves.append(node)
        return node

    def _descend(self, node: dict, d: np.ndarray, who: np.ndarray, points: np.ndarray, limit: np.ndarray, low: np.ndarray, far: np.ndarray) -> None:
        """Lower bounds and distances of the leaves that queries ``who``, at distance ``d`` of the node, may need."""
        if node["children"] is None:
            far[who, node["number"]], low[who, node["number"]] = d, np.maximum(0.0, d - node["radius"])
            return
        for child, parent in zip(node["children"], node["parent"], strict=True):
            may = np.abs(d - parent) - child["radius"] <= limit[who]
            if may.any():
                there = who[may]
                self.computed += len(there)
                to = np.sqrt(((points[there] - child["route"]) ** 2).sum(1))
                close = to - child["radius"] <= limit[there]
                self._descend(child, to[close], there[close], points, limit, low, far)

    def search(self, q: np.ndarray, k: int, skip: int | None = None, floor: int | None = None) -> list[tuple[int, int]]:
        """:meth:`search_all` of one query."""
        return self.search_all(q[None, :], k, [skip], [floor])[0]

    def search_all(self, queries: np.ndarray, k: int, skip: list[int | None], floor: list[int | None]) -> list[list[tuple[int, int]]]:
        """The k best (score, id) of every query, best first; ties to smaller ids. A query's ``skip`` takes no
        part, nor need scores below its ``floor``."""
        n = len(queries)
        if self.root is None or k < 1 or not n:
            return [[] for _ in range(n)]
        kind = self.exact if _largest(queries) * max(1, _largest(self.x)) * queries.shape[1] < 1 << 52 else np.int64
        values, asked = (self.values if kind == self.exact else self.x), queries.astype(kind)
        points = np.concatenate([queries.astype(np.float64), np.zeros((n, 1))], 1)
        base = (points * points).sum(1) + self.top
        slack = _SLACK * (1.0 + 2 * np.sqrt(base))
        omit = np.array([_NONE if i is None else i for i in skip], np.int64)
        omits = np.array([i is not None for i in skip])
        least = np.array([_NONE if f is None else f for f in floor], np.int64)
        best, of = np.full((n, k), _NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max)

        def reach(who) -> np.ndarray:
            within = np.sqrt(np.maximum(0.0, base[who] - 2.0 * least[who])) + slack[who]
            return np.where(least[who] == _NONE, np.inf, within)

        limit = reach(slice(None))
        low, far = np.full((n, len(self.leaves)), np.inf), np.zeros((n, len(self.leaves)))
        self._descend(self.root, np.sqrt(((points - self.root["route"]) ** 2).sum(1)), np.arange(n), points, limit, low, far)
        order = np.argsort(low, axis=1, kind="stable")
        at, size = 0, 1
        while at < len(self.leaves):
            cols = order[:, at : at + size]
            who, which = np.nonzero((np.take_along_axis(low, cols, 1) <= limit[:, None]) & np.isfinite(np.take_along_axis(low, cols, 1)))
            if not len(who):
                break  # bounds only grow along a query's order
            which = cols[who, which]
            by = np.argsort(which, kind="stable")
            who, which = who[by], which[by]
            cuts = np.concatenate([[0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(which)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                leaf, them = self.leaves[which[lo]], who[lo:hi]
                need = np.abs(far[them, which[lo]][:, None] - leaf["parent"][None, :]) <= limit[them][:, None]
                some, rows = need.any(1), np.flatnonzero(need.any(0)) + leaf["lo"]
                them = them[some]
                if not len(them):
                    continue
                self.computed += int(need.sum())
                scores = (asked[them] @ values[rows].T).astype(np.int64)
                ids = np.broadcast_to(self.ids[rows], scores.shape)
                good = (scores >= least[them][:, None]) & ~((ids == omit[them][:, None]) & omits[them][:, None])
                up = good.any(1)
                if not up.any():
                    continue
                them, good = them[up], good[up]
                s = np.concatenate([best[them], np.where(good, scores[up], _NONE)], 1)
                i = np.concatenate([of[them], np.where(good, ids[up], np.iinfo(np.int64).max)], 1)
                first = np.lexsort((i, -s), axis=-1)[:, :k]
                best[them], of[them] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
                least[them] = np.maximum(least[them], best[them, -1])
                limit[them] = reach(them)
            at, size = at + size, 2 * size
        return [[(x, y) for x, y in zip(a, b, strict=True) if x != _NONE] for a, b in zip(best.tolist(), of.tolist(), strict=True)]


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """Rows (vec_id, vec array<double>) with floor(scale * x), whole numbers of any size; vectors
    that take no part are left out.

    Left out: null vectors and ids, null, NaN or infinite components. Empty vectors stay (their
    inner products are 0). A finite component that is no finite double after scaling is an error.
    """
    inf = float("inf")
    raw = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf))

    def whole(v):
        x = v * F.lit(float(scale))
        kept = F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)  # beyond 2**52 all doubles are whole
        return F.when((F.abs(x) == inf) & (F.abs(v) < inf), F.raise_error(F.lit("a component is beyond the doubles after scaling")).cast("double")).otherwise(kept)

    return df.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))).select("vec_id", F.transform("v", whole).alias("vec"))


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _matrix(column: pa.Array, width: int, exact: bool = False) -> np.ndarray:
    """The vectors of whole numbers as rows of int64 (``exact``: of Python's integers), zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] if len(column) else np.zeros(0)
    values = np.array([int(c) for c in flat.tolist()], dtype=object) if exact else flat.astype(np.int64)
    size = np.diff(at)
    if (size == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=values.dtype)
    out[np.arange(width) < size[:, None]] = values
    return out


def _scan(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, skip: int | None) -> list[tuple[int, int]]:
    """As :meth:`MTree.search`, by exact scores of all rows, whatever their size."""
    a, b = sorted((_largest(x), _largest(q)))
    kind = np.int64 if max(a, 1) * b * len(q) < INT64_SUMS else object
    scores = (x.astype(kind, copy=False) @ q.astype(kind, copy=False)).tolist()
    return [(-s, i) for s, i in heapq.nsmallest(k, ((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != skip))]


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of ``points`` (fewer if there are no more different ones): medoids, from far-apart seeds."""
    picked = [int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))]
    near = ((points - points[picked[0]]) ** 2).sum(1)
    while len(picked) < count and near.max() > 0:
        picked.append(int(np.argmax(near)))
        near = np.minimum(near, ((points - points[picked[-1]]) ** 2).sum(1))
    pivots = points[picked]
    for _ in range(5):
        owner = _distances(points, pivots).argmin(1)
        centres = np.stack([points[owner == j].mean(0) if (owner == j).any() else pivots[j] for j in range(len(pivots))])
        pivots = points[_distances(points, centres).argmin(0)]
    return np.unique(pivots, axis=0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of rows; rounding may take a little off or add it."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


def _largest_component(vec: str) -> Column:
    return F.coalesce(F.greatest(F.array_max(vec).cast("double"), -F.array_min(vec).cast("double")), F.lit(0.0))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its k best candidates with another id.

    Both inputs are rows (vec_id, vec) of whole numbers as :func:`quantised` gives them. Vectors of
    different lengths are compared as if the shorter ended in zeros. Repeated candidate rows each
    count; repeated query ids are searched once. The query set is stated (it meets all partitions
    that its bounds do not spare); pages and blocks of queries are bounded and dealt by a hash of the
    id, so none grows with a hot value. Ranks are exact for components of any size; a result whose
    score is beyond 64 bits is an error. Empty inputs give no rows.
    """
    spark = candidates.sparkSession
    facts = candidates.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("w"), F.max(_largest_component("vec")).alias("top")).first()
    asked = queries.dropDuplicates(["vec_id"])
    n_asked, longest, top = asked.agg(F.count("*"), F.max(F.size("vec")), F.max(_largest_component("vec"))).first()
    width = max(facts["w"] or 0, longest or 0, 1)
    limit = math.isqrt(INT64_SUMS // width)
    # a bound of all scores (doubles round longs: doubled)
    bound = 4 * width * (int(facts["top"] or 0) + 1) * (int(top or 0) + 1)
    key_bytes = bound.bit_length() // 8 + 1 if bound >= INT64_SUMS else 0

    narrow = candidates.where(_largest_component("vec") < limit)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = (narrow.agg(F.max(square)).first()[0] or 0.0) * (1 + 1e-9)
    some = narrow.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(PIVOT_SAMPLE, SAMPLE_VALUES // width))).select("vec").toArrow()["vec"]
    points = lifted(_matrix(some, width), norm)
    pivots = choose_pivots(points, min(PIVOTS, -(-facts["n"] // PIVOT_VECTORS))) if len(points) else np.zeros((0, width + 1))

    def deal(batches):
        for b in batches:
            wide = b.column(2).to_numpy(zero_copy_only=False)
            home, far = np.full(b.num_rows, _WIDE, np.int32), np.zeros(b.num_rows)
            if not wide.all():
                d = _distances(lifted(_matrix(b.column(1).filter(pa.array(~wide)), width), norm), pivots)
                home[~wide], far[~wide] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home), pa.array(far)], names=["vec_id", "vec", "pivot", "far"])

    is_wide = (_largest_component("vec") >= limit).alias("wide")
    dealt = written(candidates.select("vec_id", "vec", is_wide).mapInArrow(deal, "vec_id long, vec array<double>, pivot int, far double"), "topk-vectors")
    # a row for each partition, fewer than PIVOTS + 2
    found = {r["pivot"]: r for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    radius = np.array([found[p]["radius"] if p in found else -np.inf for p in range(len(pivots))])
    pages = {p: -(-r["n"] // PAGE_VECTORS) for p, r in found.items()}
    page_count = F.coalesce(*[F.when(F.col("pivot") == p, n) for p, n in pages.items()], F.lit(1))
    blocks = max(1, -(-n_asked // QUERY_BLOCK))
    block_of = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int")
    cells = dealt.select("pivot", F.pmod(F.xxhash64("vec_id"), page_count).cast("int").alias("page"), "vec_id", "vec").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))

    def aim(batches):
        for b in batches:
            wide = b.column(2).to_numpy(zero_copy_only=False)
            low, base = np.zeros((b.num_rows, len(pivots))), np.zeros(b.num_rows)
            if not wide.all() and len(pivots):
                q = _matrix(b.column(1).filter(pa.array(~wide)), width).astype(np.float64)
                low[~wide] = np.where(np.isinf(radius), np.inf, _distances(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots) - radius)
                base[~wide] = (q * q).sum(1) + norm
            home = low.argmin(1) if len(pivots) else np.zeros(b.num_rows, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(pivots), pa.int32()), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(home.astype(np.int32)), lists, pa.array(base)], names=["vec_id", "vec", "wide", "home", "low", "base"])

    aimed = written(asked.select("vec_id", "vec", is_wide).mapInArrow(aim, "vec_id long, vec array<double>, wide boolean, home int, low array<double>, base double"), "topk-queries")
    schema = "query_id long, vec_id long, score long" + (", key binary" if key_bytes else "")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out, scan = [], key[0].as_py() == _WIDE
        if left.num_rows and right.num_rows:
            ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("vec"), width, exact=scan)
            asking, wide = right.column("vec_id").to_pylist(), np.array(right.column("wide").to_pylist(), bool)
            if not scan and not wide.all():
                them, floors = np.flatnonzero(~wide), right.column("floor").to_pylist()
                q = _matrix(right.column("vec").filter(pa.array(~wide)), width)
                best = MTree(ids, x, top=norm).search_all(q, k, [asking[i] for i in them], [floors[i] for i in them])
                out += [(asking[i], j, s) for i, b in zip(them, best, strict=True) for s, j in b]
            for i in range(len(asking)) if scan else np.flatnonzero(wide):
                q = _matrix(right.column("vec").slice(i, 1), width, exact=True)[0]
                out += [(asking[i], j, s) for s, j in _scan(ids, x, q, k, asking[i])]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        if not key_bytes:
            return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])
        fitting = [s if -(1 << 63) <= s < 1 << 63 else None for s in cols[2]]
        keys = [(s + bound).to_bytes(key_bytes, "big") for s in cols[2]]  # in the order of the scores
        return pa.table([*(pa.array(c, pa.int64()) for c in (cols[0], cols[1], fitting)), pa.array(keys, pa.binary())], names=["query_id", "vec_id", "score", "key"])

    def searched(rows: DataFrame, label: str) -> DataFrame:
        """Results of queries (pivot, vec_id, vec, wide, floor), met with all pages of their partition."""
        at = rows.withColumn("page", F.explode(F.sequence(F.lit(0), page_count - 1))).withColumn("block", block_of)
        keys = ("pivot", "page", "block")
        return written(cells.groupBy(*keys).cogroup(at.groupBy(*keys)).applyInArrow(search, schema), label)

    order = Window.partitionBy("query_id").orderBy(F.desc("key" if key_bytes else "score"), "vec_id")
    first = F.array("home", F.lit(_WIDE)) if _WIDE in pages else F.array("home")
    ask = ("pivot", "vec_id", "vec", "wide", "floor")
    near = searched(aimed.withColumn("pivot", F.explode(first)).withColumn("floor", F.lit(None).cast("long")).select(*ask), "topk-near")
    least = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").cast("long").alias("floor"))
    if key_bytes:  # scores may be wider than the bound's type: nothing is spared
        least = least.withColumn("floor", F.lit(None).cast("long"))
    carried = aimed.join(least, F.col("vec_id") == F.col("q"), "left")
    slack = _SLACK * (1 + 2 * F.sqrt("base"))
    reach = F.when(F.col("wide") | F.col("floor").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("base") - 2.0 * F.col("floor"))) + 2 * slack)
    others = F.filter(F.transform("low", lambda x, i: F.when((x <= F.col("reach")) & (x < float("inf")) & (i != F.col("home")), i)), lambda i: i.isNotNull())
    far = searched(carried.withColumn("reach", reach).withColumn("pivot", F.explode(others)).select(*ask), "topk-far")
    score = F.coalesce("score", F.raise_error(F.lit("a score of the top k is beyond 64 bits")).cast("long")) if key_bytes else F.col("score")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))

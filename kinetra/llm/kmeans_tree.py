"""Approximate nearest neighbours in a hierarchical k-means tree, searched best bin first.

The tree is grown by Spark: the rows of every leaf that holds more than ``leaf_rows`` are sampled, k-means
cuts the leaf into ``branches`` parts, again and again, in a task of its own, and the subtrees are grafted. So
leaves stay small however large the table is, up to ``MAX_LEAVES``. A query walks the tree through a priority
queue: it descends to the nearest child and queues the others by the distance to their centres, then goes on
with the nearest queued node, leaf after leaf. How many leaves it visits is calibrated: for some queries, none
of them in a sample that the tree is fitted on, the true neighbours are found by brute force over all vectors, and
visits widen until the mean recall reaches the target. A query's answer comes from the leaves that it visits
and from nothing else. Distances are exact, in double precision.

Scale: of equal vectors only the ``k + 1`` of smallest id can be an answer, so the others are left out before
anything is gathered. Vectors move once, to their group of neighbouring leaves, and a query once to each group
that it visits a leaf of. A group with many vectors is cut into chunks by a hash of the id and its queries go
to every chunk; many queries of a group are cut likewise. A chunk returns a query's best ``k`` at most.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.common import batch, dropped, materialize, scratch

CHUNK_ROWS = 8192
#: Leaves (neighbours in the tree) that make a group, and queries that a group handles at once.
GROUP_LEAVES, QUERY_BLOCK = 128, 256
#: Queries whose distances to all centres are computed at once.
WALK_BLOCK = 32
#: Rows of a leaf that its subtree is fitted on, about; how finely a hash cuts a leaf.
FIT_ROWS, HASHES = 4096, 1 << 30
#: The tree is broadcast: about 40 MB at this bound with 64 components. Beyond, leaves grow with the table.
MAX_LEAVES = 65_536


@dataclass
class Tree:
    """Nodes by number: the children's numbers and centres; a leaf has a leaf number instead."""

    children: list[list[int]] = field(default_factory=lambda: [[]])
    centres: list[np.ndarray | None] = field(default_factory=lambda: [None])
    leaf: list[int] = field(default_factory=lambda: [0])
    n_leaves: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, branches: int = 8, leaf_rows: int = 32, seed: int = 11) -> Tree:
        """k-means with ``branches`` centres, again in each part, until a part has ``leaf_rows`` rows or equal ones."""
        tree, r = cls(), np.random.default_rng(seed)
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            centres = _kmeans(rows, branches, r)
            part = _squares(rows, centres).argmin(axis=1)
            used = np.unique(part)
            if len(used) > 1:
                todo += zip(tree._split(node, centres[used]), (rows[part == k] for k in used), strict=True)
        tree.number()
        return tree

    def _split(self, node: int, centres: np.ndarray) -> list[int]:
        own = list(range(len(self.children), len(self.children) + len(centres)))
        self.children[node], self.centres[node] = own, centres
        self.children += [[] for _ in own]
        self.centres += [None] * len(own)
        self.leaf += [0] * len(own)
        return own

    def number(self) -> None:
        """Number the leaves depth first, so that neighbours in the tree have neighbouring numbers."""
        self.n_leaves, todo = 0, [0]
        while todo:
            node = todo.pop()
            self.leaf[node] = -1 if self.children[node] else self.n_leaves
            self.n_leaves += not self.children[node]
            todo += reversed(self.children[node])

    def graft(self, parts: dict[int, Tree]) -> None:
        """Put a subtree in the place of each leaf named."""
        for node, leaf in list(enumerate(self.leaf)):
            part = parts.get(leaf) if leaf >= 0 else None
            todo = [(node, 0)] if part is not None else []
            while todo:
                own, theirs = todo.pop()
                if part.children[theirs]:
                    todo += zip(self._split(own, part.centres[theirs]), part.children[theirs], strict=True)
        self.number()

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row, by the nearest child at each node."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _squares(x[rows], self.centres[node]).argmin(axis=1)
                todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node])]
        return out

    def leaves(self, d: list[float]) -> Iterator[int]:
        """Leaves in best-bin-first order, by a query's distances to all centres."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                own = self.children[node]
                node = min(own, key=d.__getitem__)
                for child in own:
                    if child != node:
                        heapq.heappush(queue, (d[child], child))
            yield self.leaf[node]

    def walks(self, q: np.ndarray) -> Iterator[Iterator[int]]:
        """``leaves`` of each query."""
        points = np.zeros((len(self.children), q.shape[1]))
        for own, centres in zip(self.children, self.centres, strict=True):
            if own:
                points[own] = centres
        for i in range(0, len(q), WALK_BLOCK):
            d = _squares(q[i : i + WALK_BLOCK], points) + (q[i : i + WALK_BLOCK] ** 2).sum(axis=1)[:, None]
            for row in d:
                yield self.leaves(row.tolist())


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, up to what is the same for all centres."""
    return (c * c).sum(axis=1)[None, :] - 2 * x @ c.T


def _kmeans(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _squares(x, centres).argmin(axis=1)
        centres = np.stack([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
    return centres


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of rows that take part: an id, finite numbers without null, not all zero, of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["n"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    e = x - q
    return np.sqrt((e * e).sum(axis=1))


def _placed(vectors: DataFrame, tree: Tree) -> DataFrame:
    """``(vec_id, v, leaf)`` of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.assign(_matrix(b.column("v"))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    return vectors.mapInArrow(run, "vec_id long, v array<double>, leaf int")


def _fitting(sizes: dict[int, int], branches: int, leaf_rows: int):
    """The function that makes a subtree of the sampled rows of one leaf."""

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_numpy()).astype(np.float64)
        # a sample stands for the whole leaf, so its own leaves hold as many rows less
        least = max(4, int(leaf_rows * min(1.0, len(x) / sizes[key[0]])))
        return pd.DataFrame({"leaf": [key[0]], "tree": [pickle.dumps(Tree.fit(x, branches, least, 11 + key[0]))]})

    return fit


def grow(vectors: DataFrame, fitted: DataFrame, branches: int, leaf_rows: int, fit_rows: int = FIT_ROWS, max_leaves: int = MAX_LEAVES) -> tuple[Tree, DataFrame]:
    """A tree for ``vectors(vec_id, v)`` with leaves of ``leaf_rows`` rows or little more, and the vectors in its leaves.

    Leaves are split on about ``fit_rows`` rows of ``fitted``, those of smallest hash, until no leaf is
    too large, none of the too large ones can be cut (equal vectors, or no row to fit on) or there are ``max_leaves``.
    """
    tree, done = Tree(), set()
    while True:
        placed = materialize(_placed(vectors, tree), "leaves")
        sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # bounded by max_leaves
        large = [k for k, n in sizes.items() if n > 2 * leaf_rows and k not in done]
        if not large or tree.n_leaves >= max_leaves:
            return tree, placed
        # sizes are known, so a hash tells what is in a leaf's sample, and no leaf is gathered or ranked
        bounds = [(k, int(HASHES * min(1.0, fit_rows / sizes[k]))) for k in large]
        bounds = F.broadcast(placed.sparkSession.createDataFrame(bounds, "leaf int, below long"))
        rows = _placed(fitted, tree).join(bounds, "leaf").where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(HASHES)) < F.col("below")).drop("below")

        fit = _fitting({k: sizes[k] for k in large}, branches, leaf_rows)

        found = rows.groupBy("leaf").applyInPandas(fit, "leaf int, tree binary").collect()
        parts = {r["leaf"]: pickle.loads(r["tree"]) for r in found}  # noqa: S301
        kept, room = {}, max_leaves - tree.n_leaves
        for k in sorted(parts, key=lambda k: -sizes[k]):
            if parts[k].n_leaves > 1 and parts[k].n_leaves - 1 <= room:
                kept[k], room = parts[k], room - parts[k].n_leaves + 1
        if not kept:
            return tree, placed
        # leaves that could not be cut keep that mark under their new numbers
        still = {k for k in {*done, *large} if k not in kept}
        nodes = {leaf: node for node, leaf in enumerate(tree.leaf) if leaf in still}
        tree.graft(kept)
        done = {tree.leaf[node] for node in nodes.values()}
        dropped(placed)


def brute_force(vectors: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> dict[int, list[tuple[float, int, int]]]:
    """True neighbours ``(distance, vec_id, leaf)`` of a bounded list of queries in ``vectors(vec_id, v, leaf)``; a task keeps ``k`` for each."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best: list[list[tuple[float, int, int]]] = [[] for _ in asked]
        if asked:
            own, q = np.array([i for i, _ in asked]), np.stack([v for _, v in asked])
        for rows in batches if asked else ():
            if not rows.num_rows:
                continue
            x, ids, leaf = _matrix(rows.column("v")), rows.column("vec_id").to_numpy(), rows.column("leaf").to_numpy()
            # squares by matrix product pick the candidates, with room for its rounding; their distances are then taken exactly
            xx, qq = (x * x).sum(axis=1)[:, None], (q * q).sum(axis=1)[None, :]
            squares = xx + qq - 2 * x @ q.T
            room = 1e-9 * (xx.max() + qq)
            last = np.array([b[-1][0] ** 2 if len(b) == k else np.inf for b in best])
            if len(x) > k:
                last = np.minimum(last, np.partition(squares, k, axis=0)[k])
            for i in range(len(asked)):
                at = np.flatnonzero((squares[:, i] <= last[i] + 2 * room[0, i]) & (ids != own[i]))
                new = zip(_distances(x[at], q[i]).tolist(), ids[at].tolist(), leaf[at].tolist(), strict=True)
                best[i] = sorted({*best[i], *new})[:k]
        flat = [(asked[i][0], *x) for i, b in enumerate(best) for x in b]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int32())
        yield batch(**{c: ([x[j] for x in flat], kinds[j]) for j, c in enumerate(("q", "d", "vec_id", "leaf"))})

    found = vectors.mapInArrow(run, "q long, d double, vec_id long, leaf int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    out: dict[int, list[tuple[float, int, int]]] = {q: [] for q, _ in queries}
    for q, d, vec, leaf in found.withColumn("r", rank).where(F.col("r") <= k).select("q", "d", "vec_id", "leaf").collect():
        out[q].append((d, vec, leaf))
    return out


def calibrate(tree: Tree, queries: list[tuple[int, np.ndarray]], truth: dict[int, list[tuple[float, int, int]]], target: float) -> int:
    """Leaves to visit: the fewest with which the mean recall of ``queries`` is ``target`` or more."""
    need: list[int] = []
    for (q, _), walk in zip(queries, tree.walks(np.stack([v for _, v in queries])) if queries else (), strict=True):
        wanted: dict[int, int] = {}
        for _, _, leaf in truth[q]:
            wanted[leaf] = wanted.get(leaf, 0) + 1
        for i, leaf in enumerate(walk if wanted else (), 1):
            need += [i] * wanted.pop(leaf, 0)
            if not wanted:
                break
    return sorted(need)[int(np.ceil(target * len(need))) - 1] if need else 1


def search(
    embeddings: DataFrame,
    k: int = 10,
    every: int = 100,
    target: float = 0.94,
    checked: int = 200,
    branches: int = 8,
    leaf_rows: int = 32,
    fit_rows: int = FIT_ROWS,
    visits: int | None = None,
) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every query, nearest first, ties to smaller ids.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows of another id. The tree
    is fitted on samples of about ``fit_rows`` rows a leaf, without queries as far as there are other rows.
    ``visits`` leaves are searched; if it is None it is calibrated to recall ``target`` on the ``checked`` queries
    of smallest id hash. A query goes on as long as its leaves hold ``k`` rows or fewer. Vectors that are null, zero, of odd length, or hold null or non-finite components
    take no part, nor do rows without an id; rows that repeat an id count once, with their nearest vector. Where there are fewer than
    ``k`` candidates all are found. An empty table gives no rows; other columns are not read.
    """
    with scratch(embeddings.sparkSession) as keep:
        return _searched(embeddings, k, every, target, checked, branches, leaf_rows, fit_rows, visits, keep)


def _searched(embeddings, k, every, target, checked, branches, leaf_rows, fit_rows, visits, keep) -> DataFrame:  # noqa: ANN001
    spark = embeddings.sparkSession
    whole = materialize(usable(embeddings).distinct(), "vectors")
    asked = whole.where(F.col("vec_id") % every == 0)
    # ranks are cut in the tasks before the shuffle, so many copies of one vector never meet
    equal = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    vectors = materialize(whole.withColumn("r", equal).where(F.col("r") <= k + 1).drop("r"), "different")
    fair = vectors.where(F.col("vec_id") % every != 0)
    tree, placed = grow(vectors, vectors if fair.isEmpty() else fair, branches, leaf_rows, fit_rows)
    keep(placed)
    if visits is None:
        some = [(r["vec_id"], np.array(r["v"])) for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(checked).collect()]
        visits = calibrate(tree, some, brute_force(placed, some, k), target)

    # one number for each leaf, and leaves are bounded
    ids_in = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.countDistinct("vec_id").alias("n")).collect()}
    shared = spark.sparkContext.broadcast((tree, ids_in))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held = shared.value
        for b in batches:
            groups = []
            for order in t.walks(_matrix(b.column("v"))) if b.num_rows else ():
                met: dict[int, list[int]] = {}
                n = 0
                for i, leaf in enumerate(order):
                    if i >= visits and n > k:
                        break
                    met.setdefault(leaf // GROUP_LEAVES, []).append(leaf)
                    n += held.get(leaf, 0)
                groups.append(list(met.items()))
            kind = pa.list_(pa.struct([("part", pa.int32()), ("leaves", pa.list_(pa.int32()))]))
            out = pa.array([[{"part": g, "leaves": m} for g, m in x] for x in groups], kind)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), out], names=["query_id", "q", "visits"])

    schema = "query_id long, q array<double>, visits array<struct<part: int, leaves: array<int>>>"
    walked = keep(materialize(asked.mapInArrow(walk, schema), "walks"))
    visited = walked.select("query_id", "q", F.explode("visits").alias("x")).select("query_id", "q", "x.part", "x.leaves")
    grouped = placed.withColumn("part", F.floor(F.col("leaf") / GROUP_LEAVES).cast("int"))
    asks = visited.groupBy("part").agg(F.count("*").alias("asks"))
    cut = lambda c: F.ceil(F.col(c) / CHUNK_ROWS).cast("int")
    shape = grouped.groupBy("part").agg(F.count("*").alias("rows")).join(asks, "part").select("part", cut("rows").alias("across"), cut("asks").alias("down"))
    shape = keep(materialize(shape, "shape"))
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visited.join(shape, "part").select("query_id", "q", "leaves", "part", pick("query_id", "down").alias("down"), spread("across").alias("across"))
    right = grouped.join(shape, "part").select("vec_id", "v", "leaf", "part", pick("vec_id", "across").alias("across"), spread("down").alias("down"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [_near(a.iloc[i : i + QUERY_BLOCK], b, k) for i in range(0, len(a) if len(b) else 0, QUERY_BLOCK)]
        out = pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return out.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    key = ("part", "across", "down")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _near(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of each query's visited leaves among the vectors ``b``."""
    x, ids = np.stack(b["v"].to_numpy()).astype(np.float64), b["vec_id"].to_numpy()
    q, own = np.stack(a["q"].to_numpy()).astype(np.float64), a["query_id"].to_numpy()
    leaves, at = np.unique(b["leaf"].to_numpy(), return_inverse=True)
    visited = np.stack([np.isin(leaves, m) for m in a["leaves"]], axis=1)
    xx, qq = (x * x).sum(axis=1)[:, None], (q * q).sum(axis=1)[None, :]
    # squares by matrix product pick the candidates, with room for its rounding; their distances are then taken exactly
    room = 1e-9 * (xx + qq)
    squares = np.maximum(xx + qq - 2 * x @ q.T, 0)
    near = visited[at] & (ids[:, None] != own[None, :])
    for j in np.flatnonzero(near.sum(axis=0) > 2 * k):
        rows = np.flatnonzero(near[:, j])
        if len(np.unique(ids[rows])) == len(rows):
            last = np.partition(squares[rows, j], k)[k]
            near[rows, j] = squares[rows, j] <= last + 2 * room[rows, j].max()
    r, c = np.nonzero(near)
    e = x[r] - q[c]
    out = pd.DataFrame({"c": c, "vec_id": ids[r], "score": np.sqrt((e * e).sum(axis=1))})
    out = out.sort_values(["c", "score", "vec_id"], kind="stable").drop_duplicates(["c", "vec_id"])
    out = out[out.groupby("c").cumcount() < k]
    return pd.DataFrame({"query_id": own[out["c"].to_numpy()], "vec_id": out["vec_id"].to_numpy(), "score": out["score"].to_numpy()})

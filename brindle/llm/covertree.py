"""Operator 10. Embedding near-duplicates by dual traversal of cover trees.

Equal vectors become one weighted point. Pivots from a bounded sample split the points into cells, each with its covering
radius; cells are cut into blocks by hash, and each block builds a tree of nested centres whose radii halve level by
level. Pairs of cells, then pairs of tree nodes, are dropped when their centres lie further apart than the threshold and
both covering radii; node pairs that lie wholly within it count in bulk, so a dense group never becomes a list of pairs.
What is left at the leaves is compared by cosine in double precision. All threshold pairs are found and no other.

In many dimensions unrelated vectors are about equally far apart, so cells seldom separate and the number of block pairs
grows with the square of the blocks; then the tree saves the work below its first level only.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own component; a row without a vec_id links with nothing and has no component; vectors of different lengths don't link;
rows that repeat a vec_id count as vectors each; ties at exactly the threshold link; an empty table gives none; other columns, labels too, are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, ragged, shared_dir

#: Points in a block, about; and pivots, at most.
BLOCK, PIVOTS = 8192, 2048
#: A level of radius 1 separates nothing: two unrelated vectors are 1.41 apart, and its nodes reach that far.
RADII = (0.5, 0.25, 0.125, 0.0625, 0.0)
EPS = 1e-9
#: More than a cosine of unit vectors in single precision can be off.
SINGLE = 2e-5
STRIP = 512


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision at length one; scaled first so that squares neither overflow nor vanish."""
    v = raw.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def build(raw: np.ndarray) -> dict:
    """A tree over the rows of raw: the order of points that makes each node a range, and for each level its nodes."""
    v = unit(raw).astype(np.float32)  # radii are rounded up by SINGLE
    order = np.arange(len(v))
    nodes = [(0, len(v))]  # ranges of order; the first point is the centre
    levels = []
    for radius in RADII:
        least = 1 - radius * radius / 2 + 1e-12 if radius else 2.0
        start, end, far, first = [], [], [], []
        for a, b in nodes:
            first.append(len(start))
            rest = order[a:b]
            if b - a > 1:
                near = v[rest] @ v[rest].T if b - a <= BLOCK * 2 else None
                left, parts = np.arange(b - a), []
                while len(left):
                    at = left[0]
                    cos = near[at, left] if near is not None else v[rest[left]] @ v[rest[at]]
                    inside = cos >= least
                    inside[0] = True
                    own = left[inside]
                    cover = math.sqrt(max(0.0, 2 - 2 * (float(cos[inside].min()) - SINGLE))) + EPS if len(own) > 1 else 0.0
                    parts.append((own, cover))
                    left = left[~inside]
                order[a:b] = rest[np.concatenate([p for p, _ in parts])]
            else:
                parts = [(rest, 0.0)]
            for p, cover in parts:
                start.append(a)
                a += len(p)
                end.append(a)
                far.append(cover)
        levels.append((np.array(start), np.array(end), np.array(far)))
        if len(levels) > 1:
            levels[-2] += (np.array(first), np.append(first[1:], len(start)))
        nodes = list(zip(start, end))
    return {"order": order, "levels": levels}


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def dual(x: dict, y: dict, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each point, label of each point) over x's points and then y's (x's alone if same)."""
    reach = math.sqrt(2 - 2 * cosine)
    vx, vy = x["v"], y["v"]
    off = 0 if same else len(vx)
    n = len(vx) if same else len(vx) + len(vy)
    sx, sy = np.concatenate([[0], np.cumsum(x["w"])]), np.concatenate([[0], np.cumsum(y["w"])])
    bulk, links = np.zeros(n + 1), np.zeros(n)
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    start_x, start_y = x["levels"][0][0], y["levels"][0][0]
    first: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rx, ry = x["levels"][0][2], y["levels"][0][2]
    wide = np.flatnonzero(ry > 0)
    px, py = vx[start_x].astype(np.float32), vy[start_y].astype(np.float32)
    for s in range(0, len(start_x), STRIP):
        low = s if same else 0  # each pair once
        cos = px[s : s + STRIP] @ py[low:].T
        # |a - b| <= t exactly where cos >= 1 - t^2 / 2; in single precision first, with room for its error
        t = reach + EPS + rx[s : s + STRIP, None]
        keep = cos >= (1 - t * t / 2 - SINGLE).astype(np.float32)  # holds for single points of y; its wider nodes follow
        more = wide[wide >= low]
        t = t + ry[None, more]
        keep[:, more - low] = cos[:, more - low] >= 1 - t * t / 2 - SINGLE
        i, j = np.nonzero(keep)
        i, j = i + s, j + low
        if same:
            i, j = i[i <= j], j[i <= j]
        cos = np.einsum("ij,ij->i", vx[start_x[i]], vy[start_y[j]])
        t = reach + EPS + rx[i] + ry[j]
        sound = cos >= 1 - t * t / 2
        first.append((i[sound], j[sound], cos[sound]))
    i, j, cos = (np.concatenate(z) for z in zip(*first)) if first else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    for level in range(len(RADII)):
        lx, ly = x["levels"][level], y["levels"][level]
        ax, bx, ay, by = lx[0][i], lx[1][i], ly[0][j], ly[1][j]
        far = lx[2][i] + ly[2][j]
        dist = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
        inside = (dist + far <= reach - EPS) & (far > 0)
        for a, b, c, d in zip(ax[inside], bx[inside], ay[inside], by[inside]):
            own = same and a == c
            bulk[a] += sy[d] - sy[c]
            bulk[b] -= sy[d] - sy[c]
            if not own:
                bulk[off + c] += sx[b] - sx[a]
                bulk[off + d] -= sx[b] - sx[a]
                edges.append((np.full(d - c, a), off + np.arange(c, d)))
            else:
                links[a:b] -= x["w"][a:b]
            edges.append((np.arange(a, b), np.full(b - a, off + c)))
        single = ~inside & (bx - ax == 1) & (by - ay == 1)
        hit = single & (cos >= cosine)
        if same:
            hit &= ax != ay
        a, c = ax[hit], ay[hit]
        np.add.at(links, a, y["w"][c])
        np.add.at(links, off + c, x["w"][a])
        edges.append((a, off + c))
        go = ~inside & ~single
        i, j = i[go], j[go]
        if level + 1 == len(RADII) or not len(i):
            break
        ci, cj = lx[3][i], ly[3][j]
        ni, nj = lx[4][i] - ci, ly[4][j] - cj
        pair = np.repeat(np.arange(len(i)), ni * nj)
        k = ragged(np.zeros(len(i), np.int64), ni * nj)
        i2, j2 = ci[pair] + k // nj[pair], cj[pair] + k % nj[pair]
        if same:
            once = (i[pair] != j[pair]) | (i2 <= j2)
            i2, j2 = i2[once], j2[once]
        lx, ly = x["levels"][level + 1], y["levels"][level + 1]
        keep_i, keep_j, keep_cos = [], [], []
        for s in range(0, len(i2), 1 << 17):
            p, q = i2[s : s + (1 << 17)], j2[s : s + (1 << 17)]
            cos = np.einsum("ij,ij->i", vx[lx[0][p]], vy[ly[0][q]])
            t = reach + EPS + lx[2][p] + ly[2][q]
            keep = cos >= 1 - t * t / 2
            keep_i.append(p[keep])
            keep_j.append(q[keep])
            keep_cos.append(cos[keep])
        i, j, cos = np.concatenate(keep_i), np.concatenate(keep_j), np.concatenate(keep_cos)
    links += np.cumsum(bulk)[:n]
    a, b = (np.concatenate(z) for z in zip(*edges)) if edges else (np.zeros(0, int), np.zeros(0, int))
    return links, _least_labels(n, a.astype(np.int64), b.astype(np.int64))


def _blocks(points: DataFrame, n: int, dim: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(cell, chunk, radius, tree) by block, and (c1, c2) for the cells near enough to hold links."""
    spark = points.sparkSession
    want = max(1, min(PIVOTS, n // block))
    rows = points.orderBy(F.xxhash64("rep"), "rep").limit(want).select("embedding").collect()
    pivots = unit(np.array([r[0] for r in rows], np.float64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            cos = unit(v) @ pivots.T
            cell = cos.argmax(axis=1)
            far = np.sqrt(np.maximum(0.0, 2 - 2 * cos[np.arange(len(cell)), cell])) + EPS
            names = ["rep", "weight", "embedding", "cell", "far"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(cell.astype(np.int32)), pa.array(far)], names)

    placed = points.mapInArrow(assign, f"rep long, weight long, embedding {points.schema['embedding'].dataType.simpleString()}, cell int, far double").checkpoint()
    cells = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("size"))  # at most PIVOTS rows
    size = {r["cell"]: (r["radius"], r["size"]) for r in cells.collect()}
    chunk = F.create_map(*(F.lit(int(x)) for c, (_, s) in size.items() for x in (c, -(-s // block))))
    held = placed.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunk[F.col("cell")])).groupBy("cell", "chunk")
    held = held.agg(F.collect_list(F.struct("rep", "weight", "embedding")).alias("points"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column("points").slice(k, 1).flatten()
                raw = part.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                tree = build(raw)
                order = tree.pop("order")
                tree |= {"raw": raw[order], "id": part.field("rep").to_numpy()[order], "w": part.field("weight").to_numpy()[order].astype(np.float64)}
                yield pa.RecordBatch.from_arrays([batch.column("cell").slice(k, 1), batch.column("chunk").slice(k, 1), pa.array([pickle.dumps(tree)], pa.binary())], ["cell", "chunk", "tree"])

    trees = held.mapInArrow(plant, "cell int, chunk long, tree binary").checkpoint()
    return trees, size, pivots


def threshold_links(points: DataFrame, n: int, dim: int, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(rep, links, root): from each pair of blocks, how many vectors a point links to there, and a point it is joined with."""
    spark = points.sparkSession
    trees, size, pivots = _blocks(points, n, dim, block)
    cells = sorted(size)
    radius = np.array([size[c][0] for c in cells])
    t = np.minimum(2.0, math.sqrt(2 - 2 * cosine) + radius[:, None] + radius[None, :] + 4 * EPS)
    near = pivots[cells] @ pivots[cells].T >= 1 - t * t / 2 - 1e-12
    a, b = np.nonzero(np.triu(near | np.eye(len(cells), dtype=bool)))
    near_cells = spark.createDataFrame(pd.DataFrame({"cell": np.array(cells, np.int32)[a], "c2": np.array(cells, np.int32)[b]}), "cell int, c2 int")
    right = trees.select(F.col("cell").alias("c2"), F.col("chunk").alias("k2"), F.col("tree").alias("y"))
    pairs = trees.join(near_cells, "cell").join(right, "c2").where("cell <> c2 or chunk <= k2")
    pairs = pairs.select("tree", F.when((F.col("cell") != F.col("c2")) | (F.col("chunk") != F.col("k2")), F.col("y")).alias("y"))
    pairs = pairs.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch.column("tree"), batch.column("y")):
                x = pickle.loads(one.as_py())
                x["v"] = unit(x["raw"])
                y = x
                if other.is_valid:
                    y = pickle.loads(other.as_py())
                    y["v"] = unit(y["raw"])
                links, label = dual(x, y, y is x, cosine)
                ids = x["id"] if y is x else np.concatenate([x["id"], y["id"]])
                some = links > 0.5
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.rint(links[some]).astype(np.int64)), pa.array(ids[label[some]])], ["rep", "links", "root"])

    return pairs.mapInArrow(compare, "rep long, links long, root long")


def embedding_groups(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding)."""
    shared_dir(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    sound = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    points = rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    points = points.withColumn("rep", F.monotonically_increasing_id()).checkpoint()  # numbers are fixed here
    parts = []
    for r in points.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect():  # a row for each length of vector
        parts.append(threshold_links(points.where(F.size("embedding") == r["dim"]).drop("least"), r["n"], r["dim"], cosine, block))
    found = vectors.sparkSession.createDataFrame([], "rep long, links long, root long")
    for p in parts:
        found = found.unionByName(p)
    found = found.checkpoint()
    count = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    classes = points.join(count, "rep", "left").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    good = rows.where(sound).join(classes, "embedding").select("vec_id", "n_links", "component_id")
    bad = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
c AS (SELECT vec_id AS node, vec_id AS reach FROM e UNION SELECT c.node, l.b FROM c JOIN l ON c.reach = l.a),
g AS (SELECT node, min(reach) AS component_id FROM c GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(g.component_id, vec_id) AS component_id, vec_id = coalesce(g.component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN g ON g.node = vec_id
"""

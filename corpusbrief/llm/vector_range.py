"""Operator 8, embedding near-duplicates by an exact metric range join.

Only vectors of one label (and one dimension) are compared.  Vectors are scaled to length one, where cosine >= c
is distance <= eps with eps^2 = 2 - 2c.  A group of up to twice ``cell_rows`` vectors is one cell.  In a larger one
pivots are drawn by a hash of the vector, one for ``cell_rows`` vectors and one at least.  Where that would be
too many, cells grow so that half of ``max_pivots`` are expected from the hash, and a quarter at most from groups
that need their one: what is collected and broadcast is bounded however many labels there are.  A vector belongs to the
cell of its nearest pivot, and is replicated to every cell whose pivot is at most 2 eps further away (by the
triangle inequality no other cell can hold a partner of it) and whose half space comes within eps of it.  Cells join independently; each counts all
links of its own vectors in blocks and emits, beside the counts, a spanning forest of its links.  A dense
region draws many pivots, so its work is spread over as many cells.

Equal vectors are merged first and weighted by their number, so copies are never compared.  Counts come from
double-precision dot products against ``min_cosine`` itself; eps only prunes, with a margin.

Rows: NULL, empty or zero vectors, NULL or non-finite components and NULL labels link with nothing
(n_links 0, a component of their own, kept); rows with the same id are vectors of their own; a component's
id is its smallest vec_id; rows with a NULL id link and count, but never name a component with other ids;
an empty table gives an empty table.  Only id, vector and label are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.strategies import materialize
from .common import local_components, shuffle_partitions, table
from .components import connected_components

MARGIN = 1e-6  # far above the rounding of distances between unit vectors in double precision


def unit_rows(column: pa.Array) -> np.ndarray:
    """The rows of a fixed-length list column in double precision, each scaled to length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # first to a safe range: squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))


def cell_links(x: np.ndarray, own: np.ndarray, node: np.ndarray, weight: np.ndarray, cosine: float):
    """For own rows: the weight of their partners; and a forest (a, b) of the links they take part in."""
    n = len(x)
    count, root = np.zeros(n, np.int64), np.arange(n)
    touched = np.zeros(n, bool)
    mine = np.flatnonzero(own)
    step = max(1, (1 << 22) // max(1, n))  # at most 4M products at a time

    def find(i: np.ndarray) -> np.ndarray:
        while not np.array_equal(root[i], i):
            i = root[i]
        return i

    for at in range(0, len(mine), step):
        rows = mine[at:at + step]
        hit = x[rows] @ x.T >= cosine
        hit[np.arange(len(rows)), rows] = False
        count[rows] = hit @ weight
        for k in np.flatnonzero(hit.any(1)).tolist():
            both = np.append(np.flatnonzero(hit[k]), rows[k])
            touched[both] = True
            tops = np.unique(find(both))
            if len(tops) > 1:
                root[tops] = tops[0]
    at = np.flatnonzero(touched)
    return count, (node[at], node[find(at)])


def near_vectors(vectors: DataFrame, min_cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", cell_rows: int = 1000, max_pivots: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = (F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
            & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"),
                          F.coalesce(fine, F.lit(False)).alias("fine"))
    # copies become one vector; its name is a 64-bit hash of (label, vector), unlike vec_ids never NULL or repeated
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", "v")))
    merged = materialize(rows.where("fine").groupBy("node").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label")),
        "vectors").withColumn("dim", F.size("v"))

    total = merged.count()
    scale = max(cell_rows, -(-2 * total // max_pivots))
    large = (merged.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min("node").alias("least_node"))
             .where(F.col("n") > 2 * scale))  # fewer than total / (2 * scale), so at most max_pivots / 4 groups
    drawn = merged.join(F.broadcast(large), ["label", "dim"]).where(
        (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < (1 << 30) // scale) | (F.col("node") == F.col("least_node")))
    pivots: dict[tuple, list] = {}
    for r in drawn.select(F.col("label").cast("string").alias("label"), "dim", "node", "v").collect():  # see the module text
        pivots.setdefault((r.label, r.dim), []).append((r.node, r.v))
    first, packed = 0, {}
    for k in sorted(pivots):
        p = np.array([x for _, x in sorted(pivots[k])], np.float64)
        p = p / np.abs(p).max(1, keepdims=True)
        packed[k] = (first, p / np.sqrt((p * p).sum(1, keepdims=True)))
        first += len(p)
    shared = spark.sparkContext.broadcast(packed)
    eps = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))

    def placed(piece: pa.RecordBatch, x: np.ndarray, cell: list, own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), pa.array(own), piece.column(0), piece.column(1),
                                           pa.array(list(x), pa.list_(pa.float64()))], names=["cell", "own", "node", "copies", "v"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's name is ``dimension/pivot/label``, without a pivot where the group is one cell."""
        for b in batches:
            label, dim = np.array(b.column(3).to_pylist(), object), b.column(4).to_numpy()
            group = list(zip(label.tolist(), dim.tolist()))
            whole = np.array([k not in shared.value for k in group], bool)
            for d in np.unique(dim[whole]).tolist():
                part = b.filter(pa.array(whole & (dim == d)))
                cell = [f"{d}//{x}" for x in label[whole & (dim == d)]]
                yield placed(part, unit_rows(part.column(2)), cell, np.ones(len(part), bool))
            for k in sorted({k for k in group if k in shared.value}):
                part = b.filter(pa.array((label == k[0]) & (dim == k[1])))
                start, p = shared.value[k]
                for at in range(0, len(part), 512):
                    piece = part.slice(at, 512)
                    x = unit_rows(piece.column(2))
                    d = distances(x, p)
                    home = d.argmin(1)
                    near = d <= d.min(1, keepdims=True) + 2 * eps + MARGIN
                    # a partner in cell j lies beyond the plane halfway between both pivots, so x is within eps of it
                    near &= (x * p[home]).sum(1)[:, None] - x @ p.T <= eps * distances(p[home], p) + MARGIN
                    i, cell = np.nonzero(near)
                    names = [f"{k[1]}/{start + c}/{k[0]}" for c in cell.tolist()]
                    yield placed(piece.take(pa.array(i)), x[i], names, cell == home[i])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "links", "a", "b"]

        def close(held: list[pa.RecordBatch]):
            t = pa.Table.from_batches(held)
            own, node = t["own"].to_numpy(), t["node"].to_numpy()
            x = t["v"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            count, (a, c) = cell_links(x, own, node, t["copies"].to_numpy(), min_cosine)
            at = np.flatnonzero(own)
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(count[at]), none(len(at)), none(len(at))], names=names)
            yield pa.RecordBatch.from_arrays([none(len(a)), none(len(a)), pa.array(a), pa.array(c)], names=names)

        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by cell
            cell = np.array(b.column(0).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for s, e in zip(cuts, cuts[1:]):
                if held and e > s and held[-1].column(0)[0].as_py() != cell[s]:
                    yield from close(held)
                    held = []
                if e > s:
                    held.append(b.slice(s, e - s))
        if held:
            yield from close(held)

    n = shuffle_partitions(spark, max(first, total // scale), 8)
    cells = (merged.select("node", "copies", "v", F.col("label").cast("string").alias("label"), "dim")
             .mapInArrow(deal, "cell string, own boolean, node long, copies long, v array<double>"))
    joined = materialize(cells.repartition(n, "cell").sortWithinPartitions("cell")
                         .mapInArrow(join, "node long, links long, a long, b long"), "cells")
    links = joined.where("node is not null").select("node", "links")
    roots = connected_components(joined.where("a is not null"), "a", "b").withColumnRenamed("node", "linked")
    classes = (merged.select("node", "least", "copies").join(links, "node")
               .join(roots, F.col("node") == F.col("linked"), "left")
               .select("node", "least", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(named, "root").select(F.col("node").alias("of"), "n_links", "component_id")
    out = rows.where("fine").join(classes, F.col("node") == F.col("of")).select("id", "n_links", "component_id").unionByName(
        rows.where("not fine").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").cast("bigint").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast("bigint").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_vector_range(spark, sf_dir) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
number AS (SELECT a, count(*)::BIGINT AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN number ON vec_id = number.a
"""

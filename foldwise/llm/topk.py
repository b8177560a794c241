"""Operator 1: exact top-k search by a Voronoi kNN join.

Pivots are a bounded sample of the data; each vector belongs to the cell of its
nearest pivot p at distance d.  Cells are cut into rings of distance, and each ring
has a summary: size, and largest distance.  For a query q, a vector x of a ring
scores between q.p - |q| * d_max and q.p + |q| * d_max (Cauchy-Schwarz on x - p).

From the rings' lower bounds alone each query gets a bound that its k-th score
cannot fall below; a first search in the ring with the best upper bound raises
it to a real k-th score.  Then a query is sent only to rings whose upper bound
reaches that score.  A ring's vectors are dealt over blocks of about ``BLOCK``,
and a query meets each block's matrix.  Vectors are never replicated; queries go
where they may find something.  At most PIVOTS * RINGS summaries reach the driver.

Scores are integer inner products, exact in doubles up to 2^53, and the bounds
are widened by a relative slack, so rounding never drops a candidate.

Defined results: vectors null, empty, of another length than most, or with null or
non-finite components take no part; null ids take none either; ties go to the
smaller id; rows that share an id are candidates each, but a query never finds
rows of its own id; repeated query rows are one query (the smallest vector);
fewer candidates than k give all; empty tables give an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import partitions, rows_out, saved

#: Neighbours; pivots (at most); vectors of a block; relative slack of the bounds.
K, PIVOTS, BLOCK, SLACK = 5, 64, 2048, 1e-9
#: Rings of equal width that a cell's distances are cut into for its blocks.
RINGS = 8


def quantised(vectors: DataFrame, vec: str, id_col: str, scale: int = 256) -> DataFrame:
    """``id`` and ``v``: every component x as floor(scale * x), for whole vectors of
    the commonest length."""
    x = F.col(vec)
    ok = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & ~F.exists(
        x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    rows = vectors.where(ok).select(F.col(id_col).cast("bigint").alias("id"),
                                    F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double")).alias("v"))
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1)
    return rows.join(F.broadcast(width.select("width")), F.size("v") == F.col("width")).select("id", "v")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest pivot and the distance to it."""
    square = (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)
    cell = square.argmin(1)
    return cell, np.sqrt(((v - pivots[cell]) ** 2).sum(1))


def cells(data: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id``, ``v``, ``cell`` and ``dist`` of every vector."""
    shared = data.sparkSession.sparkContext.broadcast(pivots)
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, dist = nearest(matrix(b.column("v")), shared.value)
                yield rows_out(schema, b.column("id"), b.column("v"), cell.astype(np.int32), dist)

    return data.mapInArrow(run, "id bigint, v array<double>, cell int, dist double")


def blocks(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every vector with its ``block``, and the rings' summaries (``tile``, ``cell``,
    ``n``, ``far``, ``parts``).  Thin neighbouring rings of a cell are one tile; a tile
    of many vectors is dealt over ``parts`` blocks by a hash of the id."""
    far = placed.groupBy("cell").agg(F.max("dist").alias("reach"))
    ring = F.when(F.col("reach") > 0, F.least(F.floor(F.col("dist") / F.col("reach") * RINGS), F.lit(RINGS - 1))).otherwise(0).cast("int")
    ringed = placed.join(far, "cell").withColumn("ring", ring).drop("reach")
    sizes = ringed.groupBy("cell", "ring").agg(F.count("*").alias("size"))
    inner = Window.partitionBy("cell").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("tile", F.floor(F.coalesce(F.sum("size").over(inner), F.lit(0)) / BLOCK))
    parts = F.ceil(F.sum("size").over(Window.partitionBy("cell", "tile")) / BLOCK)
    sizes = sizes.select("cell", "ring", F.concat_ws("/", "cell", "tile").alias("tile"), parts.alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    out = saved(ringed.join(sizes, ["cell", "ring"]).withColumn("block", F.concat_ws("/", "tile", part)))
    return out, out.groupBy("cell", "tile").agg(F.count("*").alias("n"), F.max("dist").alias("far"), F.first("parts").alias("parts"))


def routed(queries: DataFrame, pivots: np.ndarray, summary: list[tuple[str, int, int, float, int]], k: int, first: bool) -> DataFrame:
    """(query id, v, block) for each block that a query must see: with ``first``
    those of the tile with the best upper bound, else of all others whose upper
    bound reaches ``least``, the k-th score known so far.  A query comes with
    ``own``, the number of rows of its id, which are no results."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, summary))
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("block", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, rows = shared.value
        names = [r[0] for r in rows]
        cell, size, far, parts = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                q = matrix(part.column("v"))
                norm = np.sqrt((q * q).sum(1))[:, None]
                middle = (q @ p.T)[:, cell]
                slack = SLACK * (1 + norm * (far + np.sqrt((p * p).sum(1))[cell]))
                upper, lower = middle + norm * far + slack, middle - norm * far - slack
                if first:
                    chosen = np.zeros(upper.shape, bool)
                    chosen[np.arange(len(q)), upper.argmax(1)] = True
                else:
                    # k vectors score at least this much, even if all rows of the query's id are among those counted
                    order = np.argsort(-lower, 1)
                    own = part.column("own").to_numpy()[:, None]
                    full = np.cumsum(size[order], 1) >= k + own
                    at_least = np.where(full.any(1), np.take_along_axis(lower, order, 1)[np.arange(len(q)), full.argmax(1)], -np.inf)
                    known = np.array([-np.inf if x is None else x for x in part.column("least").to_pylist()])
                    chosen = upper >= np.maximum(at_least, known)[:, None]
                    chosen[np.arange(len(q)), upper.argmax(1)] = False      # seen before
                i, j = np.nonzero(chosen)
                for lo in range(0, len(i), 4096):
                    each = [(x, f"{names[y]}/{z}") for x, y in zip(i[lo:lo + 4096].tolist(), j[lo:lo + 4096].tolist()) for z in range(parts[y])]
                    at_query = pa.array([x for x, _ in each], pa.int64())
                    yield rows_out(schema, part.column("id").take(at_query), part.column("v").take(at_query), [x for _, x in each])

    return queries.mapInArrow(run, "id bigint, v array<double>, block string")


def solved(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows (query_id, vec_id, score) in each block it was sent
    to.  A task reads one block's vectors, then streams the queries past them."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    both = data.select("block", F.lit(0).alias("kind"), "id", "v").unionByName(asked.select("block", F.lit(1).alias("kind"), "id", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vs, ready = None, [], [], None
        for b in batches:
            names, kinds, id_, v = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3))
            change = [i for i in range(1, len(names)) if names[i] != names[i - 1] or kinds[i] != kinds[i - 1]]
            for i, j in zip([0, *change], [*change, len(names)]):
                if names[i] != now:
                    now, ids, vs, ready = names[i], [], [], None
                if kinds[i] == 0:
                    ids.append(id_[i:j])
                    vs.append(v[i:j])
                    continue
                if not ids:
                    continue
                if ready is None:
                    own = np.concatenate(ids)
                    order = np.argsort(own, kind="stable")
                    ready = own[order], np.concatenate(vs)[order]
                for at in range(i, j, 512):
                    yield best(id_[at:min(at + 512, j)], v[at:min(at + 512, j)], *ready, k, schema)

    return (both.repartition(partitions(data.sparkSession), "block").sortWithinPartitions("block", "kind")
            .mapInArrow(run, "query_id bigint, vec_id bigint, score bigint"))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, schema: pa.Schema) -> pa.RecordBatch:
    """Each query's k best rows, ids ascending in ``ids``: a stable sort breaks ties."""
    score = q @ v.T
    score[q_ids[:, None] == ids[None, :]] = -np.inf
    if score.shape[1] > k:
        # everything above the k-th value, and as many of its ties as are needed, smallest ids first
        kth = -np.partition(-score, k - 1, 1)[:, k - 1:k]
        need = k - (score > kth).sum(1)
        tie = score == kth
        keep = (score > kth) | tie & (np.cumsum(tie, 1) <= need[:, None])
    else:
        keep = np.ones(score.shape, bool)
    i, j = np.nonzero(keep & np.isfinite(score))
    return rows_out(schema, q_ids[i], ids[j], score[i, j].astype(np.int64))


def top_k(data: DataFrame, is_query: Column, id_col: str = "vec_id", vec: str = "embedding", k: int = K) -> DataFrame:
    """The ``k`` other rows of greatest inner product for every row where
    ``is_query`` holds: query_id, rank, vec_id, score."""
    spark = data.sparkSession
    rows = saved(quantised(data, vec, id_col))
    chosen = rows.orderBy(F.md5(F.col("id").cast("string")), "id", "v").limit(PIVOTS).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = np.unique(np.array([r.v for r in chosen]), axis=0)
    placed, summary = blocks(cells(rows, pivots))
    tiles = [(r.tile, r.cell, r.n, r.far, r.parts) for r in summary.collect()]
    marked = data.where(is_query).select(F.col(id_col).cast("bigint").alias("id")).distinct()
    queries = rows.join(marked, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = saved(solved(placed, routed(queries, pivots, tiles, k, True), k))
    kth = (home.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") == k)
           .select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least")))
    rest = routed(queries.join(kth, "id", "left"), pivots, tiles, k, False)
    found = home.unionByName(solved(placed, rest, k))
    return (found.withColumn("rank", F.row_number().over(best_first).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import saved


class Union:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def link(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if a != b:
            if b < a:
                a, b = b, a
            self.up[b] = a

    def stars(self) -> list[tuple]:
        """(member, root) of every member that is not a root."""
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


#: Edges that one task contracts at a time.
CONTRACT = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges (u, v) as stars around their smallest member: the same components, fewer edges."""
    kind = edges.schema["u"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([("u", arrow), ("v", arrow)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, n = Union(), 0
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                union.link(x, y)
            n += b.num_rows
            if n > CONTRACT and (stars := union.stars()):
                u, v = zip(*stars)
                yield pa.RecordBatch.from_arrays([pa.array(u, arrow), pa.array(v, arrow)], schema=schema)
                union, n = Union(), 0
        if stars := union.stars():
            u, v = zip(*stars)
            yield pa.RecordBatch.from_arrays([pa.array(u, arrow), pa.array(v, arrow)], schema=schema)

    return edges.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


#: Edges of a node beyond which it is a hub, at least; hubs at most (their table is broadcast).
HUB, HUBS = 1000, 10_000


def _with_least(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v), ``n`` or so of them, with the smallest v of each u (``m``),
    and the table (u, m), which is written out so that the plan above it stays small.
    A hub's edges are dealt by v to as many shards as its degree needs, so no task gets
    more than some ``HUB`` of them or an even part; there are at most HUBS hubs."""
    most = max(HUB, -(-n // HUBS))
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count("*") / most).cast("int").alias("shards")))
    floor = least.select("u", "m")
    hubs = least.where("shards > 1").select("u", "shards")
    if hubs.isEmpty():
        return edges.join(floor, "u").select("u", "v", "m"), floor
    dealt = edges.join(F.broadcast(hubs), "u", "left").select(
        "u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("shards").cast("bigint")).cast("int"), F.lit(0)).alias("shard"))
    shards = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    return dealt.join(shards, ["u", "shard"]).select("u", "v", "m"), floor


def _form(edges: DataFrame) -> tuple[int, bool]:
    """Number of ``edges`` (u, v), v < u, and whether they are stars around the smallest
    nodes: each u has one edge, and no v is a u."""
    sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    row = sides.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).agg(
        F.sum("out").alias("n"), F.max(F.when(F.col("out") > 0, F.col("out") + F.col("into"))).alias("most")).first()
    return row.n or 0, (row.most or 0) <= 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the smallest node
    of its component.  Alternates large and small stars until only stars are left;
    each step is a small plan over tables in shared storage (the driver plans and keeps
    a few exchanges at a time), and only two numbers reach the driver."""
    now = saved(contracted(edges).where("u != v").distinct())
    while not (form := _form(now))[1]:
        n = 2 * form[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = saved(_with_least(both, n)[0].where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        least, floor = _with_least(large, n)
        small = least.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
        now = saved(small.distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Connected components of a link table of any size.

1. Each task replaces its links by a spanning star forest (union-find over the rows of
   the task): a link is kept only if it joins something new there.
2. While the forest holds more than ``local_links`` links, the graph is contracted: every
   node hooks to the node of its neighbourhood, itself included, that comes first in the
   round's hash order (a partial aggregate, so a node with many links costs one row a task); the
   links are rewritten to the hooked nodes and made distinct, and step 1 runs again.  A
   random order leaves at most three quarters of the nodes in expectation whatever the graph looks like, so
   the rounds grow with the logarithm of its size.  The joins look up one row per node; the
   side with many links of one node is dealt over salts.
3. A forest of at most ``local_links`` links (a constant) is finished by one task.
4. The hooks of the rounds are composed from the last round back to the first, and each
   component takes its least id.

Every round is written once to shared storage, so lost executors repeat at most a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.session import scratch_path

#: Links that one task may finish: some hundred MB at most.
LOCAL_LINKS = 1_000_000
SALTS = 16


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(u, v)`` links -> ``(node, least node reached in this task)`` of every node but the least."""
    parent: dict = {}
    kind = None

    def root(x):
        while (p := parent[x]) != x:
            parent[x] = x = parent[p]                      # path halving
        return x

    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, z = root(u), root(v)
            if a != z:
                parent[max(a, z)] = min(a, z)
    nodes = list(parent)
    for lo in range(0, len(nodes), 1 << 16):
        stars = [(x, r) for x in nodes[lo:lo + (1 << 16)] if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], kind) for k in (0, 1)], names=["u", "v"])


def _looked_up(rows: DataFrame, col: str, hooks: DataFrame) -> DataFrame:
    """``rows`` with ``col`` replaced by its hook; many rows may share a value.  Hooks grow with the nodes:
    merged, never broadcast by the size of their files."""
    other = [c for c in rows.columns if c != col]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = hooks.select(F.col("id").alias(col), F.col("to").alias("_to"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return salted.join(copies.hint("merge"), [col, "_salt"], "left").select(*other, F.coalesce("_to", col).alias(col)).select(*rows.columns)


def connected_components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``(id, comp)`` for every node of the links ``(u, v)`` (one type, no nulls) that has a
    neighbour: ``comp`` is the least id of its component.  Links may repeat, run either way or be loops."""
    kind = links.schema[0].dataType.simpleString()
    pair = f"u {kind}, v {kind}"
    edges = _written(links.toDF("u", "v").mapInArrow(_forest, pair), "links")
    rounds: list[DataFrame] = []
    while edges.count() > local_links:
        def ranked(c: str):
            return F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("x"))

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(ranked("v")).alias("m"))
        hooks = _written(first.select(F.col("u").alias("id"), F.least(ranked("u"), F.col("m"))["x"].alias("to")), "hooks")
        rounds.append(hooks)
        again = _looked_up(_looked_up(edges, "u", hooks), "v", hooks).where("u <> v")
        edges = _written(again.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().mapInArrow(_forest, pair), "links")
    stars = edges.coalesce(1).mapInArrow(_forest, pair).toDF("id", "comp")
    if not rounds:
        stars = _written(stars, "components")
        roots = stars.select(F.col("comp").alias("id")).distinct()
        return stars.unionByName(roots.select("id", F.col("id").alias("comp")))
    out = _written(stars, "components")
    for hooks in reversed(rounds):
        # a node goes where the node that it hooked to goes
        out = _written(_looked_up(hooks, "to", out.select("id", F.col("comp").alias("to"))).toDF("id", "comp"), "components")
    least = out.groupBy("comp").agg(F.min("id").alias("to")).select(F.col("comp").alias("id"), "to")
    return _looked_up(out, "comp", least)

"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Shingles are runs of ``SHINGLE`` words; two texts are linked when the Jaccard
similarity of their shingle sets is ``SIMILARITY`` or more.

1. Texts of one word sequence are one *class* (a group-by with map-side combine), so
   exact copies of any number cost one row afterwards.
2. Every class has ``TREES`` tries of ``DEPTH`` min-hashes each; a trie's node of depth
   ``d`` is the set of classes that share the first ``d`` values.  Matched prefixes are
   shortened from ``DEPTH`` until a pair at the threshold meets in some tree with
   probability ``RECALL`` (``prefix_length``).
3. Candidate groups.  In each node every class is compared with one pivot, by the
   estimate from ``TREES * DEPTH`` one-byte min-hashes: first in the nodes of the longest prefix,
   then in shortened nodes that still hold several groups.  Jaccard distance is a
   metric: a class within 0.2 of the pivot is linked only to classes within 0.4 of it,
   so a pivot's neighbours at 0.6 (less four standard errors) stay in its group, and classes surely at 0.8
   (plus four) are done with.  What a second pivot would be needed for is joined
   without a look at the estimate.  All of this is linear in the nodes.
4. Exact verification: all classes of a candidate group are compared on their whole
   shingle sets, in blocks of ``BLOCK`` against blocks, a block pair per task step.  Each
   gives link counts and a spanning set of the links per class: no pair becomes a row.
5. Verified links are closed to components (:mod:`cohortline.operators.components`).

A trie is held as the hashes of its nodes at two depths, the whole signature and the prefix
shortened to the target recall, and sorted by Spark's grouping of those hashes; there are no
pointers and no further depths, as exact verification makes shorter prefixes needless.

Defined results.  Null and empty texts, texts without words and null ids stand alone
(class of its own, no links).  A text of fewer than ``SHINGLE`` words has one
shingle.  ``doc_id`` is expected to be unique; rows that repeat an id repeat its result.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.tables import doc_text, key_runs, written
from cohortline.llm.textnum import Words, blocks, mix, sequence_keys, shingles
from cohortline.operators.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.999
BLOCK = 256
KEEP, SETTLED = 0.48, 0.90     # estimates at 0.6 and 0.8, four standard errors to the safe side


def prefix_length(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Shorten the prefix from ``depth`` until two texts of the threshold's similarity
    share one in some tree with probability ``recall``."""
    for d in range(depth, 1, -1):
        if 1 - (1 - similarity ** d) ** trees >= recall:
            return d
    return 1


# ── signatures ──────────────────────────────────────────────────────────────

def _multipliers(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def min_hashes(sh: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """``(texts, n)`` minima over each text's shingles (texts start at ``first``; none empty)."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    y = sh.astype(np.uint32)
    out = np.empty((len(first), n), np.uint32)
    t = np.empty_like(x)
    with np.errstate(over="ignore"):
        for k, a in enumerate(_multipliers(n)):
            np.multiply(x, a, out=t)
            t += y
            t ^= np.uint32((int(a) * 0x9E3779B1) & 0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat(t, first)
    return out


def node_keys(sig: np.ndarray, trees: int, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of each text's node in each tree at the prefix length, and 15 bits that tell
    its nodes of the whole depth apart."""
    sig = sig.reshape(len(sig), trees, depth)
    h = np.broadcast_to(mix(np.arange(trees, dtype=np.uint64) + np.uint64(17)), sig.shape[:2]).copy()
    node = h
    with np.errstate(over="ignore"):
        for d in range(depth):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + sig[:, :, d])
            if d + 1 == length:
                node = h
    return node.view(np.int64), (h >> np.uint64(49)).astype(np.int16)


_SIGNED = "doc_id bigint, k1 bigint, k2 bigint, nodes array<bigint>, deeper array<smallint>, sketch binary"


def _signature_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in blocks(texts, 1 << 18):
                w = Words(texts[lo:hi])
                sh, doc = shingles(w, SHINGLE)
                if not len(sh):
                    continue
                has, first = np.unique(doc, return_index=True)
                k1, k2 = sequence_keys(w)
                sig = min_hashes(sh, first, TREES * DEPTH)
                node, deeper = node_keys(sig, TREES, DEPTH, length)
                at = pa.array(np.arange(len(has) + 1, dtype=np.int32) * TREES)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo).take(pa.array(has)),
                     pa.array(k1[has].view(np.int64)), pa.array(k2[has].view(np.int64)),
                     pa.ListArray.from_arrays(at, pa.array(node.reshape(-1))),
                     pa.ListArray.from_arrays(at, pa.array(deeper.reshape(-1))),
                     pa.array([x.tobytes() for x in (sig & np.uint32(255)).astype(np.uint8)], pa.binary())],
                    names=["doc_id", "k1", "k2", "nodes", "deeper", "sketch"])
    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shingle sets, sorted distinct 64-bit hashes as bytes, in place of ``text``."""
    for b in batches:
        texts = b.column("text").to_pylist()
        rest = [c for c in b.schema.names if c != "text"]
        for lo, hi in blocks(texts):
            sh, doc = shingles(Words(texts[lo:hi]), SHINGLE)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            sets = [np.unique(sh[a:z]).tobytes() for a, z in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(c).slice(lo, hi - lo) for c in rest] + [pa.array(sets, pa.binary())],
                                             names=rest + ["set"])


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x == y).mean(axis=1))], names=["a", "b", "est"])


def estimate(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``a, b, est``: the estimated similarity of each pair."""
    sa = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    sb = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb").mapInArrow(_estimates, "a bigint, b bigint, est double")


# ── candidate groups ────────────────────────────────────────────────────────

def _stars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every other row of a group with the group's least id: ``keys, a, b``."""
    pivots = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n > 1").drop("n")
    return rows.join(pivots, keys).where("id <> a").select(*keys, "a", F.col("id").alias("b"))


def _mixed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of nodes that hold several groups."""
    m = rows.select("node", "id").join(comps, "id", "left").select("node", "id", F.coalesce("comp", "id").alias("comp"))
    nodes = m.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node")
    return rows.select("node", "id").join(nodes, "node", "left_semi")


def candidate_groups(reps: DataFrame, sketches: DataFrame) -> DataFrame:
    """``id, comp`` of classes in candidate groups of two at least."""
    rows = reps.select("id", F.explode(F.arrays_zip("nodes", "deeper")).alias("n")).select(
        F.col("n.nodes").alias("node"), F.col("n.deeper").alias("deeper"), "id")
    live = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    members = written(rows.join(live, "node", "left_semi"), "members")
    sketches = written(sketches.join(members.select("id").distinct(), "id", "left_semi"), "sketches")
    # the longest prefix
    edges = written(estimate(_stars(members, ["node", "deeper"]).select("a", "b").distinct(), sketches)
                    .where(F.col("est") >= KEEP), "edges").select("a", "b")
    comps = connected_components(edges)
    # the shortened prefix, where it meets several groups
    star = written(_stars(_mixed(members, comps), ["node"]), "stars")
    tested = written(estimate(star.select("a", "b").distinct(), sketches), "tested")
    edges = edges.unionByName(tested.where(F.col("est") >= KEEP).select("a", "b"))
    comps = connected_components(edges)
    # classes not settled by their pivot: no second pivot, the node's rest is one group
    rest = star.join(tested.where(F.col("est") < SETTLED), ["a", "b"]).select("node", F.col("b").alias("id"))
    more = written(_stars(_mixed(rest, comps), ["node"]).select("a", "b").distinct(), "edges")
    return comps if more.isEmpty() else connected_components(edges.unionByName(more))


# ── exact verification ──────────────────────────────────────────────────────

def _block_links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, 3):
            side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            itself = t.column("bi")[0] == t.column("bj")[0]
            if itself:
                right = left
            elif not len(left) or not len(right):
                continue                            # a block without members
            common = shared_counts([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(s) for s in sets])
            union = size[left][:, None] + size[right][None, :] - common
            ok = common >= similarity * union - 1e-9
            if itself:
                np.fill_diagonal(ok, False)
            # least id reached over links, until nothing changes
            peer = ids.copy()
            none = np.iinfo(np.int64).max
            while True:
                new = peer.copy()
                new[left] = np.minimum(new[left], np.where(ok, peer[right][None, :], none).min(axis=1))
                new[right] = np.minimum(new[right], np.where(ok, new[left][:, None], none).min(axis=0))
                if (new == peer).all():
                    break
                peer = new
            n = np.zeros(len(ids), np.int64)
            n[left] += ok.sum(axis=1)
            if not itself:
                n[right] += ok.sum(axis=0)
            linked = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(peer[linked]), pa.array(n[linked])], names=["id", "peer", "links"])
    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets (products of 0/1 matrices over
    slices of the shingles that occur twice)."""
    out = np.zeros((len(left), len(right)), np.float32)
    values, place = np.unique(np.concatenate(left + right), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    step = min(8192, max(1, len(values)))
    for lo in range(0, len(values), step):
        a, b = np.searchsorted(place, [lo, lo + step])
        m = np.zeros((len(left) + len(right), step), np.float32)
        m[row[a:b], place[a:b] - lo] = 1
        out += m[:len(left)] @ m[len(left):].T
    return np.rint(out).astype(np.int64)


def verified_links(groups: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``id, peer, links``: link counts of each class per block pair, and the least id it
    reaches there."""
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    place = (groups.join(sizes, "comp").select("id", "comp", F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"))
             .withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumnRenamed("id", "doc_id"))
    sets = (texts.join(place.hint("merge"), "doc_id").select(F.col("doc_id").alias("id"), "comp", "nb", "blk", "text")
            .mapInArrow(_set_rows, "id bigint, comp bigint, nb int, blk int, set binary"))
    meets = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(
        F.least("blk", o).alias("bi"), F.greatest("blk", o).alias("bj"), F.when(o < F.col("blk"), 1).otherwise(0).alias("side")))
    dealt = sets.select("comp", "id", "set", F.inline(meets)).select("comp", "bi", "bj", "side", "id", "set")
    return (dealt.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "side", "id")
            .mapInArrow(_block_links(similarity), "id bigint, peer bigint, links bigint"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, copy_id, class_id, n_links``.

    ``copy_id`` is the least id of the texts of the same words, ``class_id`` the least id
    of all texts joined by links, ``n_links`` the number of other different texts
    (copy groups) that are similar to it."""
    texts = doc_text(docs)
    named = texts.where("doc_id IS NOT NULL")
    signed = written(named.mapInArrow(_signature_rows(prefix_length(similarity)), _SIGNED), "signatures")
    copies = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_id"))
    first = copies.select(F.col("copy_id").alias("doc_id"), "k1", "k2")
    reps = signed.join(first, ["doc_id", "k1", "k2"], "left_semi").withColumnRenamed("doc_id", "id")
    groups = candidate_groups(reps.select("id", "nodes", "deeper"), reps.select("id", "sketch").dropDuplicates(["id"]))
    links = written(verified_links(groups, named, similarity), "links")
    classes = (connected_components(links.select(F.col("id").alias("a"), F.col("peer").alias("b")))
               .select(F.col("id").alias("copy_id"), F.col("comp").alias("class_id"))
               .join(links.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "copy_id"), "copy_id"))
    member = (signed.select("doc_id", "k1", "k2").distinct()
              .join(copies.join(classes, "copy_id", "left"), ["k1", "k2"]).drop("k1", "k2"))
    return (texts.select("doc_id").join(member, "doc_id", "left")
            .select("doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"),
                    F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"),
                    F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links")))

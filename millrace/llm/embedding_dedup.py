"""Near-duplicate embeddings by a pivot-permutation index.

A bounded sample of vectors serves as pivots, and every vector is described by its
``near`` nearest pivots in order, its permutation. Inverted lists are kept for pairs of
pivots: a vector enters those of each pair among its ``entered`` nearest. Of two vectors of a
list, the shared pivots are counted whose places in the two permutations differ by ``shift``
at most; with SHARED of them they are candidates. Candidates are verified by their cosine
in double precision, so no link is false; links are missed only where the permutations
differ by more. The more pivots there are, the closer they are to each other, so beyond
FEW_PIVOTS permutations are longer and may differ more.

The lists hold permutations, not vectors. Vectors are dealt to blocks by their first two
pivots; a candidate pair marks its pair of blocks and both vectors in it, and each marked
vector travels once to each such pair of blocks, where the marked ones are compared. The
task returns a count and a local root for each vector, not its pairs. Lists and blocks
above ``block`` vectors are cut, and every pair of parts of a list is looked at on its own:
no task holds more than two parts, and no pair is lost.

Equal vectors of a label are one class with a multiplicity, so copies are not expanded.
The number of pivots grows with the root of the number of classes, up to MOST_PIVOTS; the
lists of tables above MOST_PIVOTS ** 2 classes grow with the table.

Vectors that are null, empty, zero, or hold null or non-finite components, and those with
a null label or vec_id, link with nothing; they keep their row (kept is false for a null
vec_id). Vectors of unlike length never link. Rows that repeat a vec_id are vectors of
their own, and link by what they hold; a component is named by the least vec_id in it, and
every row of that vec_id is kept. Where cosines tie, the earlier pivot is nearer. Very long
vectors are compared whole. An empty table gives an empty result. Only vec_id, embedding
and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches, source_partitions, written
from millrace.llm.components import components
from millrace.llm.runs import starts_of, whole_groups

#: Pivots are the square root of the number of classes, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 64, 8192
#: What makes a candidate: shared pivots. Pivots of a permutation, those whose pairs have a
#: list, and how far places may differ: up to FEW_PIVOTS pivots, and beyond.
SHARED, FEW_PIVOTS, SHORT, LONG = 3, 512, (6, 5, 3), (8, 6, 4)
BLOCK = 512
#: No two pivots have this cosine or more.
APART = 0.8


def usable() -> Column:
    """Whether a row can link: vec_id and label are there, all components finite, one not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    sound = finite & F.exists("embedding", lambda x: x != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, group, h1, h2) of the usable rows.

    ``group`` stands for label and length; equal vectors of a label, and only they, agree
    in h1 and h2 (128 bits).
    """
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    plain = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0 becomes 0
    rows = vectors.where(usable()).select("vec_id", plain.alias("embedding"), F.xxhash64("label", F.size("embedding")).alias("group"))
    return rows.withColumns({"h1": F.xxhash64("group", "embedding"), "h2": F.xxhash64(F.lit(1), "embedding", "group")})


def pick_pivots(reps: DataFrame, n: int) -> np.ndarray:
    """The pivots: at most MOST_PIVOTS vectors of the commonest length, by the order of a hash.

    Twice as many are drawn, and those near an earlier one are passed over: pivots inside
    one dense cluster would make its members differ in their nearest pivots.
    """
    size = reps.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n)))
    rows = reps.where(F.size("embedding") == size["d"]).orderBy(F.xxhash64("node", F.lit("pivot")), "node").limit(2 * wanted).select("embedding").collect()
    found = np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = unit(found)
    chosen = [0]
    for i in range(1, len(found)):
        if len(chosen) < wanted and (found[chosen] @ found[i]).max() < APART:
            chosen.append(i)
    return found[chosen]


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column, as they are stored."""
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def postings(reps: DataFrame, pivots: np.ndarray, near: int, entered: int) -> DataFrame:
    """(group, list, first, node, order): each class in the lists of the pairs of its nearest
    pivots; ``first`` is the list of its first two, ``order`` its permutation."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        k = min(near, len(at))
        pairs = np.array(list(combinations(range(min(k, entered)), 2)) or [(0, 0)])
        for batch in batches:
            rows = rows_of(batch.column("embedding"))
            order = np.zeros((len(rows), k), np.uint16)
            fits = [i for i, v in enumerate(rows) if len(v) == at.shape[1]]
            for part in range(0, len(fits), 1024):
                which = fits[part : part + 1024]
                cosines = unit(np.array([rows[i] for i in which])) @ at.T
                order[which] = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
            low, high = (f(order[:, pairs[:, 0]], order[:, pairs[:, 1]]).astype(np.int64) for f in (np.minimum, np.maximum))
            lists = (low << 16) | high
            # vectors of another length than the pivots' share one list of their group, once
            enter = np.ones(lists.shape, bool)
            enter[np.setdiff1d(np.arange(len(rows)), fits), 1:] = False
            of, which = np.nonzero(enter)
            take = lambda c: batch.column(c).take(pa.array(of))
            packed = pa.array([o.tobytes() for o in order], pa.binary()).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([take("group"), pa.array(lists[of, which]), pa.array(lists[of, 0]), take("node"), packed], names=["group", "list", "first", "node", "order"])

    return reps.select("group", "node", "embedding").mapInArrow(describe, "group long, list long, first long, node long, order binary")


def dealt(lists: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The postings with the parts (p1, p2) of their list that they meet in, their own of
    these, and their vector's block; and (node, own), each vector's block."""
    sizes = lists.groupBy("group", "list").agg(F.count("*").alias("n")).where(F.col("n") > block)
    wide = written(sizes.select("group", "list", F.ceil(F.col("n") / block).cast("int").alias("parts")), "wide")
    part = lambda n: F.pmod(F.xxhash64("node"), F.coalesce(n, F.lit(1))).cast("int")
    firsts = wide.select("group", F.col("list").alias("first"), F.col("parts").alias("blocks"))
    placed = lists.join(firsts, ["group", "first"], "left").withColumn("block", F.xxhash64("group", "first", part(F.col("blocks"))))
    rows = placed.join(wide, ["group", "list"], "left").withColumns({"parts": F.coalesce("parts", F.lit(1)), "own": part(F.col("parts"))})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("group", "list", F.least("own", "other").alias("p1"), F.greatest("own", "other").alias("p2"), "own", "node", "order", "block")
    return rows, placed.where("list = first").select("node", F.col("block").alias("own"))


def pairs_of(runs: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions i < j with equal ``runs``, which lie together, some at a time."""
    at, step = np.arange(len(runs)), 1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        at = at[at + step < len(runs)]
        at = at[runs[at] == runs[at + step]]
        held.append((at, at + step))
        step += 1
        if sum(len(i) for i, _ in held) > most or not len(at):
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []


def agreeing(order: np.ndarray, i: np.ndarray, j: np.ndarray, shift: int) -> np.ndarray:
    """Which pairs of permutations share SHARED pivots, at places that differ by ``shift`` at most."""
    k = order.shape[1]
    close = np.abs(np.subtract.outer(np.arange(k), np.arange(k))) <= shift
    counts = [((order[i[c : c + 50_000], :, None] == order[j[c : c + 50_000], None, :]) & close).sum(axis=(1, 2)) for c in range(0, len(i), 50_000)]
    return np.concatenate([np.zeros(0, np.int64), *counts]) >= min(SHARED, k)


def candidates(rows: DataFrame, shift: int) -> DataFrame:
    """(group, b1, b2, node): the vectors of candidate pairs in their pairs of blocks, once each."""
    keys = ["group", "list", "p1", "p2"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            cols = {k: table.column(k).to_numpy() for k in [*keys, "own", "node", "block"]}
            order = np.frombuffer(b"".join(table.column("order").to_pylist()), np.uint16).reshape(table.num_rows, -1)
            edges = starts_of(*(cols[k] for k in keys))
            runs = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            for i, j in pairs_of(runs):
                across = (cols["p1"][i] == cols["p2"][i]) | (cols["own"][i] != cols["own"][j])
                i, j = i[across], j[across]
                good = agreeing(order, i, j, shift)
                i, j = i[good], j[good]
                b_i, b_j = cols["block"][i], cols["block"][j]
                found = np.stack([np.tile(cols["group"][i], 2), np.tile(np.minimum(b_i, b_j), 2), np.tile(np.maximum(b_i, b_j), 2), np.concatenate([cols["node"][i], cols["node"][j]])])
                if found.size:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(found, axis=1)], names=["group", "b1", "b2", "node"])

    sorted_rows = rows.repartition(source_partitions(rows), *keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(look, "group long, b1 long, b2 long, node long").distinct()


def verify(marked: DataFrame, least: float, kind: str) -> DataFrame:
    """(node, links, root) from each pair of blocks, whose vectors are of the numpy ``kind``;
    links counts the copies of what node links with there."""
    keys = ["group", "b1", "b2"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 4_000):
            cols = {k: table.column(k).to_numpy() for k in [*keys, "own", "node", "copies"]}
            rows = rows_of(table.column("embedding").combine_chunks())
            edges = starts_of(*(cols[k] for k in keys))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                x = unit(np.array(rows[a:b], dtype=kind))
                own, b1, b2 = cols["own"][a:b], cols["b1"][a], cols["b2"][a]
                left, right = np.flatnonzero(own == b1), np.flatnonzero(own == b2)
                i, j = np.nonzero(x[left] @ x[right].T >= least)
                i, j = left[i], right[j]
                once = i < j if b1 == b2 else i != j
                i, j = i[once], j[once]
                if not len(i):
                    continue
                node, copies = cols["node"][a:b], cols["copies"][a:b]
                links = (np.bincount(i, copies[j], b - a) + np.bincount(j, copies[i], b - a)).astype(np.int64)
                root = node.copy()
                while True:
                    low = root.copy()
                    np.minimum.at(low, i, root[j])
                    np.minimum.at(low, j, root[i])
                    if (low == root).all():
                        break
                    root = low
                has = links > 0
                out.append((node[has], links[has], root[has]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["node", "links", "root"])

    sorted_rows = marked.select(*keys, "own", "node", "copies", "embedding").repartition(source_partitions(marked), *keys).sortWithinPartitions(*keys, "node")
    return sorted_rows.mapInArrow(compare, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, lengths: tuple[int, int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``; ``lengths`` are
    near, entered and shift, by default those for the number of pivots."""
    bounded_batches(vectors.sparkSession)
    vectors = vectors.select("vec_id", "embedding", "label")
    rows = keyed(vectors)
    reps = rows.groupBy("group", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    reps = written(reps.withColumnRenamed("h1", "node"), "classes")
    n = reps.count()
    ids = vectors.select("vec_id")
    if not n:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    kind = "<f4" if isinstance(reps.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    pivots = pick_pivots(reps, n)
    near, entered, shift = lengths or (SHORT if len(pivots) <= FEW_PIVOTS else LONG)
    lists = written(postings(reps, pivots, near, entered), "lists")
    placed, homes = dealt(lists, block)
    marked = written(candidates(placed, shift), "marked")
    met = marked.join(homes, "node").join(reps.select("node", "copies", "embedding"), "node")
    found = written(verify(met, least, kind), "found")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    # only classes that differ from a lone vector are joined back
    facts = reps.select("node", "h2", "rep", "copies").join(linked, "node", "left").join(joined, "node", "left").where("copies > 1 or links > 0")
    facts = written(facts.withColumn("component", F.coalesce("component", "node")), "facts")
    names = facts.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = facts.join(names, "component").select(F.col("node").alias("h1"), "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = rows.select("vec_id", "h1", "h2").join(written(named, "named"), ["h1", "h2"], "left").select("vec_id", "n_links", "component_id")
    every = rows.unionByName(vectors.where(~usable()).select("vec_id", F.lit(None).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id")))
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

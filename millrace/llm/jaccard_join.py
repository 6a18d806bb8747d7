"""N-gram Jaccard self-join: size-aware, small sets by fixed-size subsets, large sets by inverted lists.

Documents become sets of 64-bit hashes of their five-word shingles. Sets of sizes a and b
reach the threshold only if they share c(a, b) elements (6/7 of their mean size at 0.75).

* light: a set up to the boundary enumerates its subsets of each size c that a partner of
  up to the boundary may need. Two such sets link only if they meet in a subset.
* heavy: a larger set, and a smaller one that a larger may link with, enters the inverted
  lists of its prefix: all but the last ``least * size`` elements in one common order.
  Two sets that link share an element at places of at most a - c and b - c of that order.
  Elements that many sets hold come last, so that shared passages and set phrases stay
  out of the lists. The order decides the length of lists only, never the result.
* the boundary is the size at which the two ways' costs over the sizes at hand are least.

Equal sets are one node from the start. A list keeps a set only if another of its sets
fits it in size and place; lists with the same members are one list.

Sets are dealt to blocks, those of one long list together. A pair of sets that a sketch
(elements by bucket, the more the larger the set) can't tell apart marks its pair of
blocks and both sets in it. In each marked pair of blocks the marked sets are then
compared exactly, and the task returns each set's least linked set, never its pairs. So
what is written grows with the sets and blocks, not with the square of a group.

1. in each list, every set is held against the next by size and against the list's
   middle, and what links is formed to components;
2. lists that still hold several components are looked through in full, in pairs of
   blocks, for pairs of unlike components that the sketches let pass.

The links found are a forest: enough to connect every component, and no more of a group
than its sets and blocks. With it come the classes of equal sets (``set_id``, the least id
that has the set) and the component of each. No pair is dropped unless its bound, or its
exact count, says that it doesn't link.

* ``jaccard_components`` gives every document's class and component; ``one_of_each`` keeps a
  document of each component. Both stop here: rows and shuffles follow the sets, however
  large a group is. Only the looks at lists that stay mixed (sets that share elements in
  their prefixes and don't link) are still pairs, within tasks; the rows dealt for a list
  of n are n ** 1.5 / 16 at most.
* ``jaccard_components(links=True)`` and ``jaccard_links`` count or give all links. Every link
  lies inside a component, so all pairs of distinct sets inside each are then compared, in
  pairs of blocks, which is work by the square of a group of unlike near copies.

``n_links`` counts the other rows that a row's text links with, those of equal sets among
them; repeated rows count as often as they are there, as they do in ``n_equal``.

Null or empty texts, and those without words, are linked with nothing. Rows with a null
doc_id link with nothing and have a null component. Rows of one doc_id count as
one document with several texts. Very long texts are read whole; a set too large for a
block is a block of its own. An empty table gives an empty result. Where sizes tie, order
is by the sets' hashes, and no result depends on it. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, sized, source_partitions, written
from millrace.llm.components import components
from millrace.llm.runs import cut_groups, starts_of, whole_groups
from millrace.llm.tokens import batched
from millrace.llm.words import digest, mixed, shingle_sets

#: Elements are counted over every SAMPLED-th distinct set of the whole table; those that
#: so many of these hold come late in the order, the COMMONEST of them at most. All of it
#: is a matter of speed only.
SAMPLED, MET, COMMONEST = 32, 4, 200_000
#: Lists of an element held by more sets, as counted so, are dealt to several tasks.
LONG_LIST = 50_000
#: Sets of a list that are looked at together, and how these grow with the root of a list.
BLOCK, BLOCK_ROOTS = 1024, 16
#: Pairs of sets that are held against each other at a time.
PAIRS = 1 << 18
#: Sketches have a power of two of buckets: LEAST_BUCKETS, or a quarter of the elements.
LEAST_BUCKETS = 64
#: Sets and elements of a block that is compared exactly.
MOST_SETS, MOST_ELEMENTS = 1024, 500_000
#: Light sets have at most this many elements; a candidate costs as much as so many rows.
MOST_LIGHT, PAIR_COST = 12, 4


def needed(a, b, percent: int = 75):
    """Shared elements that sets of a and b elements need: overlap >= percent/(100+percent) of a+b."""
    return -(-percent * (a + b) // (100 + percent))


def near(a, b, percent: int = 75):
    """Whether sets of a and b elements may link."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def prefix_length(n: int, percent: int = 75) -> int:
    return n - -(-percent * n // 100) + 1


@lru_cache(maxsize=256)
def subset_sizes(n: int, boundary: int, percent: int = 75) -> tuple[int, ...]:
    """The subset sizes that light partners of a set of n may need."""
    partners = [b for b in range(1, boundary + 1) if 100 * min(n, b) >= percent * max(n, b)]
    return tuple(sorted({needed(n, b, percent) for b in partners}))


@lru_cache(maxsize=256)
def _picks(n: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n), size)))


def boundary_by_cost(sizes: dict[int, int], percent: int = 75) -> int:
    """The boundary of least cost for ``sizes`` (sets by number of elements).

    A light set costs a row for each subset; a set in the lists a row for each element of
    its prefix and a look at the members that it meets there, taken to be as many as sets
    of its size to one in a hundred.
    """
    total = max(1, sum(sizes.values()))

    def cost(boundary: int) -> float:
        spent = 0.0
        for n, count in sizes.items():
            if n <= boundary:
                spent += count * sum(comb(n, c) for c in subset_sizes(n, boundary, percent))
            if n > boundary or 100 * n >= percent * (boundary + 1):
                spent += count * prefix_length(n, percent) * (1 + PAIR_COST * count / total)
        return spent

    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def keys_of(found: np.ndarray, common: np.ndarray, weight: np.ndarray, boundary: int, percent: int = 75) -> tuple[np.ndarray, np.ndarray]:
    """The lists that a set (sorted hashes) enters, and its place in each: the element's
    place in the order, 0 for subsets."""
    n, keys, places = len(found), [found[:0]], [np.zeros(0, np.int64)]
    if n <= boundary:
        spread = mixed(found + np.uint64(0x9E3779B97F4A7C15))
        for c in subset_sizes(n, boundary, percent):
            keys.append(mixed(spread[_picks(n, c)].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
            places.append(np.zeros(len(keys[-1]), np.int64))
    if n > boundary or 100 * n >= percent * (boundary + 1):
        prefix = prefix_length(n, percent)
        late = np.zeros(n, np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, found), len(common) - 1)
            late = np.where(common[at] == found, weight[at], 0)
        keys.append(found[np.argsort(late, kind="stable")[:prefix]] if late.any() else found[:prefix])
        places.append(np.arange(prefix))
    return np.concatenate(keys), np.concatenate(places)


def level_of(n: np.ndarray) -> np.ndarray:
    """The power of two of a sketch's buckets, by the set's size."""
    buckets = np.maximum(LEAST_BUCKETS, -(-np.asarray(n, np.int64) // 4))
    return np.ceil(np.log2(buckets)).astype(np.int64)


def sketch_of(found: np.ndarray) -> bytes:
    """Elements by bucket: bytes, or 32-bit numbers where a bucket holds more than 255."""
    buckets = 1 << int(level_of(len(found)))
    counts = np.bincount((found & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes()


def folded(sketch: bytes, level: int, to: int) -> np.ndarray:
    """A sketch of 2**level buckets, as it would be with 2**to."""
    counts = np.frombuffer(sketch, np.uint8 if len(sketch) == 1 << level else "<u4")
    return counts.reshape(-1, 1 << to).sum(axis=0, dtype=np.uint32)


def bounds(sketch: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """The most elements that the sets i and j of each pair may share, by their sketches."""
    levels, out = level_of(n), np.zeros(len(i), np.int64)
    low = np.minimum(levels[i], levels[j])
    for level in np.unique(low).tolist():
        at = np.flatnonzero(low == level)
        rows, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        drawn = np.stack([folded(sketch[r], int(levels[r]), level) for r in rows.tolist()])
        if drawn.max() < 256:
            drawn = drawn.astype(np.uint8)
        left, right = place[: len(at)], place[len(at) :]
        for k in range(0, len(at), max(1, step >> level)):
            cut = slice(k, k + max(1, step >> level))
            out[at[cut]] = np.minimum(drawn[left[cut]], drawn[right[cut]]).sum(axis=1, dtype=np.int64)
    return out


def _node(packed: bytes) -> int:
    return int.from_bytes(packed[:8], "little", signed=True)


def describe(documents: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows in one pass: for each document (doc_id, th, n, node, sketch), and
    (h, met) for the elements of the sampled sets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            sets = shingle_sets(table.column("text").combine_chunks(), width)
            n = np.array([len(x) for x in sets], np.int64)
            packed = [digest(x) if len(x) else None for x in sets]
            once = {p: x for p, x in zip(packed, sets) if p and _node(p) % SAMPLED == 0}
            h, met = np.unique(np.concatenate(list(once.values())), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            h = h.view(np.int64)
            k = len(sets)
            blank = lambda kind: pa.nulls(len(h), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([table.column("doc_id").combine_chunks(), blank(pa.int64())]),
                    pa.concat_arrays([table.column("th").combine_chunks(), blank(pa.int64())]),
                    pa.concat_arrays([pa.array(n), blank(pa.int64())]),
                    pa.concat_arrays([pa.array([p and _node(p) for p in packed], pa.int64()), blank(pa.int64())]),
                    pa.concat_arrays([pa.array([sketch_of(x) if len(x) else None for x in sets], pa.binary()), blank(pa.binary())]),
                    pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(h)]),
                    pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(met)]),
                ],
                names=["doc_id", "th", "n", "node", "sketch", "h", "met"],
            )

    return documents.mapInArrow(read, "doc_id long, th long, n long, node long, sketch binary, h long, met long")


#: Size and place in one number, in this order; places are below 2**31.
PLACE_BITS = 31


def postings(documents: DataFrame, common: np.ndarray, weight: np.ndarray, boundary: int, width: int, percent: int) -> DataFrame:
    """(h, salt, node, at): each distinct set of a batch in its lists, ``at`` being its size
    and its place. The lists of very common elements are dealt out by salt; salt is -1 elsewhere."""
    shared = documents.sparkSession.sparkContext.broadcast((common, weight))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, much = shared.value
        long_ones, pieces = late[much > LONG_LIST], -(-much[much > LONG_LIST] // LONG_LIST)
        for table in batched(batches):
            once = {digest(x): x for x in shingle_sets(table.column("text").combine_chunks(), width) if len(x)}
            if not once:
                continue
            keys = [keys_of(x, late, much, boundary, percent) for x in once.values()]
            counts = [len(k) for k, _ in keys]
            h = np.concatenate([k for k, _ in keys])
            node = np.repeat(np.array([_node(p) for p in once], np.int64), counts)
            at = np.repeat(np.array([len(x) for x in once.values()], np.int64), counts) << PLACE_BITS
            at |= np.concatenate([p for _, p in keys])
            salt = np.full(len(h), -1, np.int32)
            if len(long_ones):
                found = np.minimum(np.searchsorted(long_ones, h), len(long_ones) - 1)
                is_long = long_ones[found] == h
                salt[is_long] = (node[is_long] % pieces[found[is_long]]).astype(np.int32)
            for k in range(0, len(h), 200_000):
                cut = slice(k, k + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array(salt[cut]), pa.array(node[cut]), pa.array(at[cut])], names=["h", "salt", "node", "at"])

    return documents.mapInArrow(read, "h long, salt int, node long, at long")


def _upto(flag: np.ndarray) -> np.ndarray:
    """The last position before each, within the array, where ``flag`` holds; -1 if none."""
    at = np.where(flag, np.arange(len(flag)), -1)
    return np.append(-1, np.maximum.accumulate(at)[:-1]) if len(flag) else at


def lists_of(rows: DataFrame, percent: int) -> DataFrame:
    """(list, node, n, place, after, middle): the lists, each set of members once.

    Of two sets the smaller must hold the element in the part of its prefix that sets of
    its own size or larger need. Sets without a partner for which this holds, and whose
    size allows a link, are left out. ``after`` is the next set by size and ``middle`` the
    list's middle one, if their sizes allow a link. A list of any length passes through in
    pieces; a list in several pieces, or with a salt, keeps all its sets.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, in_pieces in cut_groups(batches, ["h", "salt"]):
            h, salt, node, at = (table.column(k).to_numpy() for k in ("h", "salt", "node", "at"))
            fresh = np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1]))
            h, salt, node, at = h[fresh], salt[fresh], node[fresh], at[fresh]
            n, place = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
            whole = (salt < 0) & (not in_pieces)
            edges = starts_of(h, salt)
            lead = place <= n - needed(n, n, percent)
            before = _upto(lead)
            first = np.repeat(edges[:-1], np.diff(edges))
            served = (before >= first) & near(n, n[before], percent)
            follows = np.append(first[1:] == first[:-1], False)
            serves = lead & follows & near(n, np.append(n[1:], 0), percent)
            keep = served | serves | ~whole
            if not keep.any():
                continue
            h, node, n, place, whole, first = h[keep], node[keep], n[keep], place[keep], whole[keep], first[keep]
            edges = starts_of(first)
            length = np.diff(edges)
            # clashing names would only make one list of two
            names = mixed(np.add.reduceat(mixed(node.view(np.uint64)), edges[:-1]) + length.astype(np.uint64)).view(np.int64)
            name = np.where(whole, np.repeat(names, length), h)
            after = np.append(node[1:], 0)
            follows = np.append(first[1:] == first[:-1], False) & near(n, np.append(n[1:], 0), percent)
            middle_at = np.repeat(edges[:-1] + length // 2, length)
            middle = node[middle_at]
            has_middle = near(n, n[middle_at], percent) & (middle != node)
            arrays = [pa.array(name), pa.array(node), pa.array(n), pa.array(place), pa.array(after, mask=~follows), pa.array(middle, mask=~has_middle)]
            yield pa.RecordBatch.from_arrays(arrays, names=["list", "node", "n", "place", "after", "middle"])

    dealt = rows.repartition(source_partitions(rows), "h", "salt").sortWithinPartitions("h", "salt", "at", "node")
    found = dealt.mapInArrow(read, "list long, node long, n long, place long, after long, middle long")
    return found.groupBy("list", "node").agg(F.first("n").alias("n"), F.min("place").alias("place"), F.min("after").alias("after"), F.min("middle").alias("middle"))


def block_of(lists: DataFrame) -> DataFrame:
    """(node, block): sets of one long list share blocks of MOST_SETS sets and MOST_ELEMENTS elements."""
    parts = F.greatest(F.ceil(F.count("*") / MOST_SETS), F.ceil(F.sum("n") / MOST_ELEMENTS)).alias("parts")
    sizes = lists.groupBy("list").agg(F.count("*").alias("members"), parts)
    longest = lists.select("list", "node").join(sizes, "list").groupBy("node").agg(F.max(F.struct("members", "list", "parts")).alias("m"))
    return longest.select("node", F.xxhash64("m.list", F.pmod(F.xxhash64("node"), F.col("m.parts"))).alias("block"))


def bounded_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(b1, b2, node) of the pairs (u, v) whose sketches allow a link, once each; ``nodes``
    have their block."""
    side = lambda name: nodes.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "sketch", "block")))
    joined = pairs.join(side("u"), "u").join(side("v"), "v")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n_u, n_v, b_u, b_v = (batch.column(c).to_numpy() for c in ("u", "v", "n_u", "n_v", "block_u", "block_v"))
            k = batch.num_rows
            most = bounds(batch.column("sketch_u").to_pylist() + batch.column("sketch_v").to_pylist(), np.concatenate([n_u, n_v]), np.arange(k), np.arange(k, 2 * k))
            good = most >= needed(n_u, n_v, percent)
            yield marked(u[good], v[good], b_u[good], b_v[good])

    return joined.mapInArrow(read, "b1 long, b2 long, node long").distinct()


def marked(u: np.ndarray, v: np.ndarray, b_u: np.ndarray, b_v: np.ndarray) -> pa.RecordBatch:
    """Both sets of each pair, in their pair of blocks, once."""
    b1, b2 = np.tile(np.minimum(b_u, b_v), 2), np.tile(np.maximum(b_u, b_v), 2)
    rows = np.stack([b1, b2, np.concatenate([u, v])])
    rows = np.unique(rows, axis=1) if rows.size else rows
    return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["b1", "b2", "node"])


def unlike_pairs(lists: DataFrame, grouped: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(b1, b2, node) of the pairs of one list, but of unlike components, whose sketches
    allow a link, once each; ``nodes`` have their block."""
    placed = lists.select("list", "node", "place").join(grouped, "node", "left").select("list", "node", "place", F.coalesce("component", "node").alias("component"))
    mixed_lists = placed.groupBy("list").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members")).where("a <> b").select("list", "members")
    block = F.greatest(F.lit(BLOCK), F.sqrt("members") * BLOCK_ROOTS)
    rows = placed.join(mixed_lists, "list").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(nodes.select("node", "n", "sketch", "block"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("list", F.least("own", "other").alias("p1"), F.greatest("own", "other").alias("p2"), "own", "node", "n", "place", "component", "block", "sketch")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["list", "p1", "p2"]
        for table in whole_groups(batches, keys, 20_000):
            cols = {k: table.column(k).to_numpy() for k in [*keys, "own", "node", "n", "place", "component", "block"]}
            drawn = table.column("sketch").to_pylist()
            edges = starts_of(*(cols[k] for k in keys))
            found = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = cols["own"][a:b]
                left, right = a + np.flatnonzero(own == cols["p1"][a]), a + np.flatnonzero(own == cols["p2"][a])
                step = max(1, PAIRS // max(1, len(right)))
                for k in range(0, len(left), step):
                    i, j = left[k : k + step, None], right[None, :]
                    n_i, n_j = cols["n"][i], cols["n"][j]
                    fits = (cols["component"][i] != cols["component"][j]) & near(n_i, n_j, percent)
                    least = needed(n_i, n_j, percent)
                    fits &= (cols["place"][i] <= n_i - least) & (cols["place"][j] <= n_j - least)
                    if cols["p1"][a] == cols["p2"][a]:
                        fits &= i < j
                    x, y = np.nonzero(fits)
                    if len(x):
                        found.append(np.stack([left[k : k + step][x], right[y]]))
                if sum(f.shape[1] for f in found) > 500_000:
                    yield kept(cols, drawn, found)
                    found = []
            if found:
                yield kept(cols, drawn, found)

    def kept(cols: dict[str, np.ndarray], drawn: list[bytes], found: list[np.ndarray]) -> pa.RecordBatch:
        i, j = np.concatenate(found, axis=1)
        good = bounds(drawn, cols["n"], i, j) >= needed(cols["n"][i], cols["n"][j], percent)
        i, j = i[good], j[good]
        return marked(cols["node"][i], cols["node"][j], cols["block"][i], cols["block"][j])

    dealt = rows.repartition(source_partitions(rows), "list", "p1", "p2").sortWithinPartitions("list", "p1", "p2")
    return dealt.mapInArrow(read, "b1 long, b2 long, node long").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared elements of each set on the left with each on the right.

    Elements that many sets hold are counted by matrix products, the others by their
    holders' pairs, as is cheaper.
    """
    shared = np.zeros((len(left), len(right)), np.float32)
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    known, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = [np.repeat(np.arange(len(k)), k) for k in sizes]
    at = [at[: len(rows[0])], at[len(rows[0]) :]]
    held = [np.bincount(x, minlength=len(known)) for x in at]
    many = 256 * held[0] * held[1] >= len(left) * len(right)
    place = np.cumsum(many) - 1
    dense = [(r[many[x]], place[x[many[x]]]) for r, x in zip(rows, at)]
    for k in range(0, int(many.sum()), 4096):
        pair = []
        for (r, x), side in zip(dense, (left, right)):
            cut = (x >= k) & (x < k + 4096)
            held_by = np.zeros((len(side), min(4096, int(many.sum()) - k)), np.float32)
            held_by[r[cut], x[cut] - k] = 1
            pair.append(held_by)
        shared += pair[0] @ pair[1].T
    # each remaining element on the left meets its holders on the right, which lie together
    few = ~many & (held[0] > 0) & (held[1] > 0)
    r, x = rows[0][few[at[0]]], at[0][few[at[0]]]
    order = np.argsort(at[1], kind="stable")
    starts, by_element = np.cumsum(held[1]) - held[1], rows[1][order]
    edges = np.searchsorted(np.cumsum(held[1][x]), np.arange(0, int(held[1][x].sum()) + 1_000_000, 1_000_000))
    for a, b in zip(edges[:-1].tolist(), [*edges[1:-1].tolist(), len(x)]):
        count = held[1][x[a:b]]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        cell = np.repeat(r[a:b] * len(right), count) + by_element[np.repeat(starts[x[a:b]], count) + step]
        shared += np.bincount(cell, minlength=shared.size).reshape(shared.shape)
    return shared


def block_links(sets: DataFrame, percent: int, answer, schema: str) -> DataFrame:
    """``answer(node, copies, i, j)`` of the linked pairs i, j of each pair of blocks.

    ``sets`` has (g, b1, b2, own, node, copies, elements): the sets of each pair of blocks,
    ``own`` being a set's own block of the two. A set may come several times.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["g", "b1", "b2"]
        for table in whole_groups(batches, keys, 1):
            cols = {k: table.column(k).to_numpy() for k in [*keys, "own", "node", "copies"]}
            packed = table.column("elements")
            edges = starts_of(*(cols[k] for k in keys))
            out: list[list[np.ndarray]] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                # rows are sorted by node, so repeated sets lie together
                rows = a + np.flatnonzero(np.append(True, np.diff(cols["node"][a:b]) != 0))
                own = cols["own"][rows]
                left, right = np.flatnonzero(own == cols["b1"][a]), np.flatnonzero(own == cols["b2"][a])
                if len(rows) < 2 or not len(left) or not len(right):
                    continue
                sets = [np.frombuffer(packed[r].as_py(), np.uint64) for r in rows.tolist()]
                n = np.array([len(x) for x in sets], np.int64)
                both = overlaps([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
                links = (100 + percent) * both >= percent * np.add.outer(n[left], n[right])
                if cols["b1"][a] == cols["b2"][a]:
                    links = np.triu(links, 1)
                i, j = np.nonzero(links)
                if len(i):
                    out.append(answer(cols["node"][rows], cols["copies"][rows], left[i], right[j]))
                if sum(len(c[0]) for c in out) > 100_000:
                    yield from batches_of(out)
                    out = []
            if out:
                yield from batches_of(out)

    def batches_of(out: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = [np.concatenate(c) for c in zip(*out)]
        for k in range(0, len(found[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in found], names=names)

    dealt = sets.repartition(source_partitions(sets), "g", "b1", "b2").sortWithinPartitions("g", "b1", "b2", "node")
    return dealt.mapInArrow(read, schema)


def least_linked(node: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """(u, v): each linked set with the least set that it reaches."""
    root = node.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        if (low == root).all():
            break
        root = low
    has = root != node
    return [node[has], root[has]]


def summed_links(node: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """(node, links): how many rows each set links with."""
    links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
    return [node[links > 0], links[links > 0].astype(np.int64)]


def linked_pairs(node: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """(u, v), each pair once."""
    return [np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]


def with_elements(wanted: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """``wanted`` (doc_id, th, own, ...) with the sets' elements in place of doc_id and th."""
    carried = [c for c in wanted.columns if c not in ("doc_id", "th")]
    rows = documents.join(sized(wanted), ["doc_id", "th"]).select(*carried, "text")
    schema = rows.drop("text").withColumn("elements", F.lit("").cast("binary")).schema

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            packed = [x.tobytes() for x in shingle_sets(table.column("text").combine_chunks(), width)]
            yield from table.drop_columns(["text"]).append_column("elements", pa.array(packed, pa.binary())).to_batches(max_chunksize=2_000)

    return rows.mapInArrow(draw, schema)


def forest(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v) that connect what links among the marked sets (b1, b2, node) of each pair of
    blocks; the sets of a pair of blocks meet in one task."""
    pairs = written(pairs, "pairs")
    wanted = written(pairs.select("node").distinct().join(nodes.select("node", "doc_id", "th", "copies", F.col("block").alias("own")), "node"), "wanted")
    sets = with_elements(wanted, documents, width).join(sized(pairs), "node")
    return block_links(sets.select(F.lit(0).alias("g"), "b1", "b2", "own", "node", "copies", "elements"), percent, least_linked, "u long, v long")


def links_inside(grouped: DataFrame, nodes: DataFrame, documents: DataFrame, width: int, percent: int, pairs: bool = False) -> DataFrame:
    """(node, links) from each pair of blocks of a component, links counting the copies of
    the unlike sets that node links with there; or all linked pairs (u, v), each once. All
    pairs of a component are compared."""
    members = grouped.join(nodes.select("node", "doc_id", "th", "copies", "n"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / MOST_SETS), F.ceil(F.sum("n") / MOST_ELEMENTS)).cast("int")
    totals = members.groupBy("component").agg(blocks.alias("blocks"))
    wanted = members.join(totals, "component").select("doc_id", "th", "node", F.col("component").alias("g"), "copies", "blocks")
    wanted = written(wanted.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    rows = with_elements(wanted, documents, width).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "node", "copies", "elements")
    return block_links(rows, percent, *((linked_pairs, "u long, v long") if pairs else (summed_links, "node long, links long")))


def linked_nodes(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The usable documents with the hash of their text (th), the facts of all (doc_id, th,
    n, node), the nodes, and links (u, v) enough to connect each component."""
    bounded_batches(documents.sparkSession)
    held = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    described = written(describe(held, width), "described")
    facts = described.where("h is null").select("doc_id", "th", "n", "node", "sketch")
    met = described.where("h is not null").groupBy("h").agg(F.sum("met").alias("met")).where(F.col("met") >= MET)
    common = met.orderBy(F.desc("met"), "h").limit(COMMONEST).toPandas()
    h = common["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, weight = h[order], SAMPLED * common["met"].to_numpy(np.int64)[order]
    # a set's document: the least id, with the hash of its text
    sets = facts.where("node is not null and doc_id is not null")
    rep = F.min(F.struct("doc_id", "th"))
    nodes = sets.groupBy("node").agg(rep.alias("r"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.select("node", "r.doc_id", "r.th", "copies", "n", "sketch"), "nodes")
    sizes = {r["n"]: r["count"] for r in nodes.where(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").count().collect()}
    usable = held.where("doc_id is not null")
    lists = written(lists_of(postings(usable, h, weight, boundary_by_cost(sizes, percent), width, percent), percent), "lists")
    listed = written(nodes.join(block_of(lists), "node"), "listed")
    first = lists.select("node", F.explode(F.array_distinct(F.array_compact(F.array("after", "middle")))).alias("to"))
    first = first.select(F.least("node", "to").alias("u"), F.greatest("node", "to").alias("v")).distinct()
    close = written(forest(bounded_pairs(first, listed, percent), listed, usable, width, percent), "close")
    grouped = written(components(close), "grouped")
    more = written(forest(unlike_pairs(lists, grouped, listed, percent), listed, usable, width, percent), "more")
    return usable, facts, nodes, close.unionByName(more)


def jaccard_components(documents: DataFrame, width: int = 5, percent: int = 75, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id and n_equal (other rows of an equal set) of
    every document, and with ``links`` n_links."""
    usable, facts, nodes, edges = linked_nodes(documents, width, percent)
    # ids of several texts: the sets of each are connected, and rows without words go with them
    known = facts.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most"), (F.count("*") - F.count("node")).alias("bare"))
    several = written(known.where("least <> most or (least is not null and bare > 0)").select("doc_id", "least"), "several")
    same_id = facts.join(sized(several), "doc_id").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    final = written(components(edges.unionByName(same_id)), "components")
    # the least id of each component; nodes on no link and without copies need no row
    rooted = nodes.join(final, "node", "left").select("node", "doc_id", "copies", "component", F.coalesce("component", "node").alias("root"))
    rooted = rooted.where("copies > 1 or component is not null")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id", F.col("doc_id").alias("set_id"), (F.col("copies") - 1).alias("n_equal"))
    if links:
        counted = links_inside(final, nodes, usable, width, percent).groupBy("node").agg(F.sum("links").alias("links"))
        named = named.join(counted, "node", "left").select(*named.columns, (F.coalesce("links", F.lit(0)) + F.col("n_equal")).alias("n_links"))
    names = written(named, "names")
    rows = facts.join(sized(several), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("own"), F.coalesce("node", "least").alias("node"))
    real = F.col("doc_id").isNotNull()
    counts = [F.when(real & F.col("own").isNotNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c) for c in ("n_equal", *["n_links"] * links)]
    set_id = F.when(real, F.coalesce(F.when(F.col("own").isNotNull(), F.col("set_id")), "doc_id"))
    return rows.join(names, "node", "left").select("doc_id", "n_shingles", F.when(real, F.coalesce("component_id", "doc_id")).alias("component_id"), set_id.alias("set_id"), *counts)


def jaccard_links(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(u_id, v_id) of every linked pair of unlike sets, each pair once; a set is named by
    the least id that has it."""
    usable, _, nodes, edges = linked_nodes(documents, width, percent)
    found = links_inside(written(components(edges), "components"), nodes, usable, width, percent, pairs=True)
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("doc_id").alias(f"{name}_id"))
    return found.join(side("u"), "u").join(side("v"), "v").select(F.least("u_id", "v_id").alias("u_id"), F.greatest("u_id", "v_id").alias("v_id"))


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group of linked texts, that of the least id; documents with a null
    id all stay, and so does one row of each id and text that links with nothing. An id
    with unlike texts is in several groups and may stay with some of them. Columns are
    carried untouched."""
    _, facts, nodes, edges = linked_nodes(documents, width, percent)
    rooted = nodes.join(components(edges), "node", "left").where("copies > 1 or component is not null")
    rooted = rooted.select("node", "doc_id", "th", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("stays"))
    names = written(rooted.select("node", "root").join(least, "root").select("node", "stays"), "names")
    given = facts.where("doc_id is not null").select("doc_id", "th", "node")
    named = given.join(names, "node").where(F.struct("doc_id", "th") != F.col("stays"))
    pair = lambda rows: rows.select(F.col("doc_id").alias("its_id"), F.col("th").alias("its_th"))
    gone = sized(written(pair(named).distinct(), "gone"))
    again = sized(written(pair(given.groupBy("doc_id", "th").count().where("count > 1")), "again"))

    def met(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        return rows.join(others, (rows["doc_id"] == others["its_id"]) & (F.xxhash64(rows["text"]) == others["its_th"]), how)

    stay = met(documents, gone, "left_anti")
    # few rows repeat, so only these are shuffled whole
    return met(stay, again, "left_anti").unionByName(met(stay, again, "left_semi").dropDuplicates(["doc_id", "text"]))

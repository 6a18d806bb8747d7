"""Merkle manifest of a dataset by concatenated-level strings; built-in functions only.

Each row is a leaf: the hash of its columns, each ``-`` if null, else its length in bytes, a
colon and its value. The leaves of a group (a language) stand in order, and every ``run``
consecutive nodes of a level become their parent, the hash of their digests; the last run
may hold fewer, even one. What remains is the group's subroot, and the groups' subroots, in
order, become the root in the same way.

* A node's digest has 64 characters, so a level of a tree is one string: parents are hashes
  of its substrings of ``run`` digests, and a node's siblings are the substrings that flank
  it within its run.
* Leaves are placed by a range sort and prefix sums over the partitions' counts. A block
  holds ``run ** depth`` consecutive places of a group, so its levels are those of the whole
  tree, and its top is a node of the level ``depth``. The tops are leaves of the next
  round, until every group has one block.
* Proofs go the other way: a block's own path, then that of its top in the round above.
  A block has a bounded number of leaves, and the rows of a hot group lie in many blocks.

A round leaves a 256th of the rows, so four rounds hold 4 * 10**9 leaves. Texts are hashed
in the first scan and never shuffled. The sort, the blocks and the proofs carry digests.

Null values count as such: a null group is a group of its own and comes first, as do null
ids; an empty text is ``0:``. Very long texts are hashed whole. Rows of one group and id
are ordered by their leaf; rows that agree in all of it have equal leaves at places of
their own. An empty table gives an empty result. A lone row is its subroot and the root, and
its proof is empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import sized, source_partitions, written

#: Characters of a digest, nodes of a run, and the columns of a leaf in order.
DIGEST, RUN, COLUMNS = 64, 2, ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block.
DEPTH = 8
#: What is tampered with: rows whose id's crc32 this divides.
TAMPERED = 7
PATH = "array<struct<before:string,after:string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: list[Column]) -> Column:
    """The hash of a row's values."""
    text = [v.cast("string") for v in values]
    return hashed(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def group_key(group: Column) -> Column:
    """A string that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``at``, their place within their ``key``, from 0 without gaps.

    Sorted by range, so the rows of one key may lie in many partitions; each partition's
    rows are numbered as they are written, and start where the key's rows of the partitions
    before it end. The window holds a row for each partition of a key. Rows that agree in all
    of ``order`` are spread as well, by where they come from: their places may be exchanged.
    """
    by = ["key", *order, "salt"]
    spread = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(source_partitions(rows), *by).sortWithinPartitions(*by)
    held = written(spread.drop("salt").withColumn("row", F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned("row", 33).alias("part")
    counts = held.groupBy("key", part).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")
    starts = written(counts.select("key", "part", (before - F.col("first")).alias("shift")), "starts")
    return held.withColumn("part", part).join(sized(starts), ["key", "part"]).withColumn("at", F.col("shift") + F.col("row")).drop("part", "row", "shift")


def parents(level: str, run: int) -> str:
    """SQL: the string of the level above the string ``level``."""
    width = DIGEST * run
    return f"array_join(transform(sequence(0, (length({level}) - 1) div {width}), j -> sha2(substring({level}, int(j) * {width} + 1, {width}), 256)), '')"


def blocks(nodes: DataFrame, carry: tuple[str, ...] = (), run: int = RUN, depth: int = DEPTH) -> DataFrame:
    """(key, block, levels, items): the level strings of each block of nodes (key, at, node),
    leaves first, and what they carry, in order.

    A key's only block stops at one node; of several, all go up ``depth`` levels.
    """
    block = F.expr(f"at div {run**depth}").alias("block")
    grouped = nodes.groupBy("key", block).agg(F.array_sort(F.collect_list(F.struct("at", "node", *carry))).alias("held"))
    few = sum((F.size("held") > run**level).cast("int") for level in range(depth))
    height = F.when(F.col("block") == 0, few).otherwise(depth)
    rows = grouped.withColumn("height", height).withColumn("leaves", F.array_join(F.transform("held", lambda x: x["node"]), ""))
    levels = F.expr(f"aggregate(slice(sequence(0, height), 2, height), array(leaves), (done, level) -> concat(done, array({parents('element_at(done, -1)', run)})))")
    items = F.transform("held", lambda x: F.struct(*(x[c].alias(c) for c in ("at", *carry))))
    return rows.select("key", "block", levels.alias("levels"), items.alias("items"))


def rounds_of(nodes: DataFrame, carry: tuple[str, ...] = (), run: int = RUN, depth: int = DEPTH) -> list[DataFrame]:
    """The blocks of each round, until every key has one."""
    rounds = [written(blocks(nodes, carry, run, depth), "blocks")]
    while not rounds[-1].where("block > 0").isEmpty():
        tops = rounds[-1].select("key", F.col("block").alias("at"), F.element_at("levels", -1).alias("node"))
        rounds.append(written(blocks(tops, (), run, depth), "blocks"))
    return rounds


def own_path(run: int, depth: int) -> Column:
    """What flanks the node ``i`` of a block within its run, level by level."""
    scale = "element_at(array(" + ", ".join(str(run**level) for level in range(depth)) + "), level + 1)"
    place, first = f"(i div {scale})", f"(i div ({scale} * {run}) * {run})"
    part = lambda start, n: f"substring(s, int({start}) * {DIGEST} + 1, int({n}) * {DIGEST})"
    before, after = part(first, f"{place} - {first}"), part(f"{place} + 1", f"{first} + {run} - 1 - {place}")
    return F.expr(f"transform(slice(levels, 1, size(levels) - 1), (s, level) -> struct({before} as before, {after} as after))")


def with_paths(rounds: list[DataFrame], run: int = RUN, depth: int = DEPTH) -> DataFrame:
    """(key, node, path, top, item) of every leaf of the rounds: the siblings from leaf to top. A round's blocks meet the one above by key and block, each once."""
    above = rounds[-1].select("key", "block", F.lit(None).cast(PATH).alias("rest"), F.element_at("levels", -1).alias("top"))
    for held in reversed(rounds):
        # above the first round, a row of some hundred bytes stands for run ** depth leaves
        nodes = held.join(sized(above), ["key", "block"]).select("key", "levels", "rest", "top", F.posexplode("items").alias("i", "item"))
        node = F.expr(f"substring(levels[0], i * {DIGEST} + 1, {DIGEST})").alias("node")
        path = F.concat(own_path(run, depth).cast(PATH), F.coalesce("rest", F.array().cast(PATH))).alias("path")
        found = nodes.select("key", node, path, "top", "item")
        if held is not rounds[0]:
            above = written(found.select("key", F.col("item.at").alias("block"), F.col("path").alias("rest"), "top"), "paths")
    return found


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: hashed(s["before"], node, s["after"]))


def proof(path: Column) -> Column:
    """The hash of all siblings, from the leaves up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, identity: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS, carry: dict[str, Column] | None = None, run: int = RUN, depth: int = DEPTH) -> DataFrame:
    """(identity, leaf, path, subroot, root) of every row, with the columns ``carry``; ``path``
    has the siblings from the leaf to the root."""
    more = carry or {}
    own = {"key": group_key(F.col(f"`{group}`")), "id": F.col(f"`{identity}`"), "node": leaf([F.col(f"`{c}`") for c in columns])}
    leaves = rows.select(*(c.alias(k) for k, c in (own | more).items()))
    within = with_paths(rounds_of(placed(leaves, "id", "node"), ("id", *more), run, depth), run, depth)
    trees = written(within, "within")
    # groups are leaves of a tree of one key
    groups = trees.groupBy("key").agg(F.first("top").alias("node"))
    tops = placed(groups.select(F.lit("").alias("key"), F.col("key").alias("name"), "node"), "name")
    named = with_paths(rounds_of(tops, ("name",), run, depth), run, depth)
    named = written(named.select(F.col("item.name").alias("key"), F.col("node").alias("subroot"), F.col("path").alias("rest"), F.col("top").alias("root")), "groups")
    joined = trees.join(sized(named), "key")
    return joined.select(F.col("item.id").alias(identity), F.col("node").alias("leaf"), F.concat("path", "rest").alias("path"), "subroot", "root", *(F.col(f"item.{c}").alias(c) for c in more))


def root_of(rows: DataFrame, **given) -> str | None:
    """The root of a table, to be kept with it; None for an empty table."""
    found = manifest(rows, **given).select("root").first()
    return found and found["root"]


def failing(rows: DataFrame, proofs: DataFrame, root: str, identity: str = "doc_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(identity, reason) of what of ``rows`` isn't what the root stands for, by the proofs
    (identity, leaf and path) that ``manifest`` gave.

    A row is good if its own leaf, worked out anew, folds to the root by a proof. An id is
    ``changed`` if a row of it isn't and there are proofs of the id, ``added`` if there are none,
    and ``missing`` if a proof has no row. Rows meet proofs by id and leaf, so ids that
    repeat make no pairs. ``rows`` may be read long after the manifest was made, and no
    other row is needed to check one: a part of a table can be held against its proofs.
    """
    leaves = rows.select(F.col(f"`{identity}`").alias("id"), leaf([F.col(f"`{c}`") for c in columns]).alias("own")).distinct()
    known = proofs.select(F.col(f"`{identity}`").alias("proven"), "leaf", "path")
    met = leaves.join(known, F.col("id").eqNullSafe(F.col("proven")) & (F.col("own") == F.col("leaf")), "full")
    good = F.max(F.coalesce(fold(F.col("own"), F.col("path")) == root, F.lit(False))).alias("good")
    each = met.groupBy(F.coalesce("id", "proven").alias(identity), "own", "leaf").agg(good)
    some = lambda what: F.max(F.coalesce(what, F.lit(False)))
    here, there = F.col("own").isNotNull(), F.col("leaf").isNotNull()
    judged = each.groupBy(identity).agg(some(here & ~F.col("good")).alias("bad"), some(there).alias("known"), some(there & ~here).alias("lost"))
    reason = F.when(F.col("bad"), F.when(F.col("known"), "changed").otherwise("added")).when(F.col("lost"), "missing")
    return judged.select(identity, reason.alias("reason")).where("reason is not null")


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns: every row's proof held against its leaf, or a forged one."""
    forged = leaf([F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in COLUMNS])
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    found = manifest(documents.select(*COLUMNS), carry={"forged": F.when(chosen, forged)})
    folded = found.withColumn("folded_root", fold(F.coalesce("forged", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    """The same rows in DuckDB, a tree as a row for each level."""
    part = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    values = lambda n: " || ".join(part(f"cast({n if c == 'n_chars' else c} as varchar)") for c in COLUMNS)
    # crc32, bit by bit
    byte = "list_reduce(list_prepend(xor(c, b), [0::ubigint for i in range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::ubigint, [ascii(substring(doc_id::varchar, k::bigint, 1))::ubigint for k in range(1, length(doc_id::varchar) + 1)]), lambda c, b: {byte}), 4294967295)"
    above = "list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], '')))"
    step = lambda pos, t: f"{{'s': coalesce({t}.l[xor({pos} >> {t}.lvl, 1) + 1], ''), 'r': ({pos} >> {t}.lvl) % 2 = 0}}"
    return f"""with recursive d as materialized (select row_number() over () as k, doc_id, lang, sha256({values('n_chars')}) as leaf, doc_id is not null and {crc} % {TAMPERED} = 0 as bad, sha256({values('(n_chars::hugeint + 1)')}) as forged from documents),
leaves as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from d),
tree as (select lang, 0 as lvl, list(leaf order by pos) as l from leaves group by lang union all select lang, lvl + 1, {above} from tree where len(l) > 1),
groups as materialized (select lang, l[1] as subroot, row_number() over (order by lang nulls first) - 1 as pos from tree where len(l) = 1),
tops as (select 0 as lvl, list(subroot order by pos) as l from groups union all select lvl + 1, {above} from tops where len(l) > 1),
steps as (select k, tree.lvl, {step('leaves.pos', 'tree')} as s from leaves join tree on leaves.lang is not distinct from tree.lang where len(tree.l) > 1
  union all select k, 1000 + tops.lvl, {step('groups.pos', 'tops')} from leaves join groups on leaves.lang is not distinct from groups.lang cross join tops where len(tops.l) > 1),
paths as (select k, list(s order by lvl) as path from steps group by k),
found as (select doc_id, leaf, subroot, (select l[1] from tops where len(l) = 1) as root, coalesce(path, []) as path, if(bad, forged, leaf) as used
  from leaves join groups on leaves.lang is not distinct from groups.lang left join paths using (k)),
folded as (select *, list_reduce(list_prepend({{'s': used, 'r': false}}, path), lambda a, x: {{'s': sha256(if(x.r, a.s || x.s, x.s || a.s)), 'r': false}}).s as folded_root from found)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.s), ''), '')) as proof_sha256, folded_root, folded_root = root as verified from folded"""


ORACLE_SQL = _sql()

"""Mixing sources to target weights by Pareto order sampling.

Sources in code point order, null last, get the weights in turn and share ``share`` percent
of all words; a target stops at MOST times its source's words, and the excess goes to the
others by weight (the closed form of doing so until none is above).

A source whose target is r times its words takes every document floor(r) times; these
whole copies are certain. The words still missing come from one more copy of some: the
source's documents are sampled in classes of like size (CLASSES to a doubling), from the
largest class down. A class is due its share of the missing words and what the classes
before it left or overdrew; in documents of its mean size that gives the class's sample
size, rounded up or down at random so that it is right in the mean, or to the nearest
where the smaller documents couldn't even that out. Within a class, a
document's inclusion probability p is in proportion to its size and sums up to the sample
size; where that gives 1 or more the document is certain, and the others share the rest.
Documents are ranked by the odds of a uniform number over the odds of p, certain ones
first, and those of the least rank are taken, as many as the sample size says. So each
sample has a fixed size, and the smallest class evens out what the larger ones left.

The uniform number is a hash of doc_id, text and seed, so reruns agree. Rows that agree in
source, doc_id and text tie in everything; where a sample ends within such a group of n, k
of them are taken: the group's rows are numbered by partition, prefix sums over the
partitions' counts give each its quota, and the first of each partition fill it. Which k
these are makes no difference but in columns that are read by nothing here.

No source passes through one task: a plan is made of the source's sizes and their counts,
the rankings are integers, and histograms of them narrow the boundary of each class down
until at most LIMIT rows are left to order. The windows over sources hold a row a source
in one task. Words are counted once, and a second time only where whole documents are
asked for. Null and empty texts have size 0 and are taken with 0 words; a source with no
words has target 0 and keeps none. Very long texts are counted whole. An empty table gives
an empty result. Extra columns are carried untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import n_words, sized, written

#: The weights in turn, the share in percent, and the most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 150, 2
#: Size classes to a doubling; histogram bins of a level, and rows of a class that are ordered.
CLASSES, BINS, LIMIT = 32, 1024, 10_000
TOP = 1 << 52


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(skey, source_size, target) of (skey, source, source_size): one row a source.

    A source is capped if all sources, filled to its ratio of cap to weight, stay within
    the total; the rest share what the capped leave. The window holds one row a source.
    """
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    known = totals.withColumns({"weight": turn, "cap": F.col("source_size") * most}).withColumn("ratio", F.col("cap") / F.col("weight"))
    every, upto = Window.partitionBy(), Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, 0)
    goal = F.sum("source_size").over(every) * share / 100
    filled = F.sum("cap").over(upto) + F.col("ratio") * (F.sum("weight").over(every) - F.sum("weight").over(upto))
    marked = known.withColumns({"goal": goal, "capped": filled <= goal})
    left = F.col("goal") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * left / free))
    return marked.withColumn("target", target.cast("double")).select("skey", "source_size", "target")


def _keys(seed: int) -> dict[str, Column]:
    """Columns of a document: its source as a key, its words, and two hashes."""
    return {
        "skey": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
        "size": n_words("text"),
        "draw": F.xxhash64("doc_id", "text", F.lit(seed)),
        "tie": F.xxhash64(F.lit("tie"), "text", "doc_id"),
    }


def with_class(rows: DataFrame) -> DataFrame:
    return rows.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double")) * CLASSES).cast("int"))


def inclusion(sizes: np.ndarray, counts: np.ndarray, n: int) -> tuple[float, int]:
    """(words, certain): a document of ``size`` is included with probability 1 if its size is
    ``certain`` or more, else size / words; over all documents these sum up to ``n``."""
    order = np.argsort(-sizes, kind="stable")
    sizes, counts = sizes[order], counts[order]
    certain = np.iinfo(np.int64).max
    words, left = int((sizes * counts).sum()), n
    for size, count in zip(sizes.tolist(), counts.tolist()):
        if left * size < words:
            break
        certain, words, left = size, words - size * count, left - count
    return (words / left if left > 0 else np.inf), certain


def sample_sizes(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The plan of one source, of its sizes and their counts: a row (skey, class, n, words,
    certain) for each size class."""
    skey, missing = str(rows["skey"].iloc[0]), int(rows["missing"].iloc[0])
    smaller = int((rows["size"] * rows["count"]).sum())
    share, owed, out = missing / smaller, 0.0, []
    for cls, part in sorted(rows.groupby("class"), key=lambda x: -x[0]):
        sizes, counts = part["size"].to_numpy(np.int64), part["count"].to_numpy(np.int64)
        words, documents = int((sizes * counts).sum()), int(counts.sum())
        owed += share * words
        smaller -= words
        evened = words / documents <= min(share, 1 - share) * smaller
        u = int.from_bytes(hashlib.blake2b(f"{seed} {cls} {skey}".encode(), digest_size=7).digest(), "big") / (1 << 56)
        n = int(min(documents, max(0, np.floor(owed / (words / documents) + (u if evened else 0.5)))))
        per, certain = inclusion(sizes, counts, n)
        p = np.where(sizes >= certain, 1.0, sizes / per)
        owed -= float((p * sizes * counts).sum())
        out.append((skey, cls, n, per, certain))
    return pd.DataFrame(out, columns=["skey", "class", "n", "words", "certain"])


def ranking(draw: Column, size: Column, words: Column, certain: Column) -> Column:
    """odds(u) / odds(p), mapped from (0, oo) to integers in [1, TOP); certain documents have 0."""
    u = (F.shiftrightunsigned(draw, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    p = size / words
    q = u * (1 - p) / ((1 - u) * p)
    inner = F.floor(q / (1 + q) * F.lit(float(TOP))).cast("bigint")
    return F.when(size >= certain, F.lit(0)).otherwise(F.least(F.greatest(inner, F.lit(1)), F.lit(TOP - 1))).cast("bigint")


def open_classes() -> Column:
    """Whether a class's boundary is still too wide to be ordered."""
    return (F.col("held") > LIMIT) & (F.col("high") - F.col("low") > 1)


def narrowed(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """State (skey, class, n, low, high, base, held) after one level: where a class has more
    than LIMIT rows in [low, high), the bin that its sample ends in. ``base`` counts the
    rows below ``low``."""
    wide = state.where(open_classes())
    width = F.expr(f"greatest((high - low) div {BINS}, 1)")
    inside = ranked.join(wide, ["skey", "class"]).where("rank >= low and rank < high").withColumn("width", width)
    bins = inside.groupBy("skey", "class", "n", "low", "base", "width", F.expr("(rank - low) div width").alias("bin")).agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("skey", "class").orderBy("bin")) - F.col("held") + F.col("base")
    bins = bins.withColumn("before", before).where("before < n and before + held >= n")
    low = F.col("low") + F.col("bin") * F.col("width")
    found = bins.select("skey", "class", "n", low.alias("low"), (low + F.col("width")).alias("high"), F.col("before").alias("base"), "held")
    return state.where(~open_classes()).unionByName(found)


def last_taken(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """(skey, class, cut, quota, part_of): the struct (rank, tie) of the last rows that each
    class's sample takes, how many of these it takes, and whether that is some of them only;
    classes that take none have no row."""
    some = plan.where("n > 0")
    every = some.where("n >= documents").select("skey", "class", F.struct(F.lit(TOP).alias("rank"), F.lit(0).cast("bigint").alias("tie")).alias("cut"), F.lit(0).cast("bigint").alias("quota"), F.lit(False).alias("part_of"))
    held = some.where("n < documents").select("skey", "class", "n", F.lit(0).cast("bigint").alias("low"), F.lit(TOP).alias("high"), F.lit(0).cast("bigint").alias("base"), F.col("documents").alias("held"))
    state = written(held, "state")
    while state.where(open_classes()).count():
        state = written(narrowed(ranked, state), "state")
    edge = ranked.join(state, ["skey", "class"]).where("rank >= low and rank < high")
    edge = edge.groupBy("skey", "class", "rank", "tie", "n", "base").agg(F.count("*").alias("copies"))
    before = F.sum("copies").over(Window.partitionBy("skey", "class").orderBy("rank", "tie")) - F.col("copies") + F.col("base")
    last = edge.withColumn("quota", F.col("n") - before).where("quota > 0 and quota <= copies")
    return every.unionByName(last.select("skey", "class", F.struct("rank", "tie").alias("cut"), "quota", (F.col("quota") < F.col("copies")).alias("part_of")))


def with_quotas(tied: DataFrame) -> DataFrame:
    """Rows (skey, class, quota, ...) with ``chosen``: as many rows of each class as its quota
    says. Partitions get quotas by prefix sums of their counts; in each, rows are numbered."""
    held = written(tied.withColumn("row", F.monotonically_increasing_id()), "tied")
    keys = ["skey", "class", "part"]
    rows = held.select("skey", "class", F.shiftrightunsigned("row", 33).alias("part"), "quota", "row")
    counts = rows.groupBy(*keys, "quota").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("skey", "class").orderBy("part")) - F.col("n")
    quotas = written(counts.select(*keys, (F.col("quota") - before).alias("left")).where("left > 0"), "quotas")
    numbered = rows.join(sized(quotas), keys).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("row")))
    upto = written(numbered.where(F.col("nth") <= F.col("left")).groupBy(*keys).agg(F.max("row").alias("upto")), "upto")
    met = held.withColumn("part", F.shiftrightunsigned("row", 33)).join(sized(upto), keys, "left")
    return met.withColumn("chosen", F.coalesce(F.col("row") <= F.col("upto"), F.lit(False))).drop("row", "part", "upto")


def mix(documents: DataFrame, carry: list[str] | None = None, seed: int = 20240101, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """A struct column ``doc`` of each document's columns (or of those in ``carry``), with
    size, source_size, target and copies, the times that the mix takes it, and p, the
    inclusion probability of the copy that is not certain."""
    carry = documents.columns if carry is None else carry
    doc = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("doc")
    keys = [c.alias(k) for k, c in _keys(seed).items()]
    light = "text" not in carry
    sizes = written(with_class(documents.select("source", *keys, *[doc] * light)), "sizes")
    keyed = sizes if light else with_class(documents.select(doc, *keys))
    totals = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("bigint")
    missing = F.greatest(F.round("target").cast("bigint") - F.col("whole") * F.col("source_size"), F.lit(0))
    goals = written(targets(totals, weights, share, most).withColumn("whole", whole).withColumn("missing", missing), "goals")
    counts = sizes.where("size > 0").groupBy("skey", "class", "size").agg(F.count("*").alias("count"))
    counts = counts.join(goals.where("missing > 0").select("skey", "missing"), "skey")
    plan = counts.groupBy("skey").applyInPandas(lambda rows: sample_sizes(rows, seed), "skey string, class int, n long, words double, certain long")
    plan = written(plan.join(counts.groupBy("skey", "class").agg(F.sum("count").alias("documents")), ["skey", "class"]), "plan")
    rank = ranking(F.col("draw"), F.col("size"), F.col("words"), F.col("certain"))
    ranked = sizes.where("size > 0").join(sized(plan.where("n > 0").select("skey", "class", "words", "certain")), ["skey", "class"])
    cuts = last_taken(ranked.select("skey", "class", "tie", rank.alias("rank")), plan)
    # written, so that Spark knows how small they are and need not shuffle the texts to meet them
    cuts = written(plan.where("n > 0").select("skey", "class", "words", "certain").join(cuts, ["skey", "class"]), "cuts")
    joined = keyed.join(sized(goals.select("skey", "source_size", "target", "whole")), "skey").join(sized(cuts), ["skey", "class"], "left")
    here = F.struct(rank.alias("rank"), "tie")
    upto = lambda within: F.coalesce((F.col("size") > 0) & within, F.lit(False))
    at_edge = upto(F.col("part_of") & (here == F.col("cut")))
    out = joined.withColumn("chosen", upto(here <= F.col("cut")))
    if not cuts.where("part_of").isEmpty():
        # rows that tie where a sample ends are few, unless one row repeats without end
        out = out.where(~at_edge).unionByName(with_quotas(joined.where(at_edge)))
    p = F.when(F.col("size") == 0, 0.0).otherwise(F.coalesce(F.when(F.col("size") >= F.col("certain"), 1.0).otherwise(F.col("size") / F.col("words")), F.lit(0.0)))
    copies = F.col("whole") + F.col("chosen").cast("int")
    return out.select("doc", "size", "source_size", "target", copies.alias("copies"), p.alias("p"))


def taken_words(documents: DataFrame, seed: int = 20240101) -> DataFrame:
    """The contract's columns, with source, copies and p."""
    out = mix(documents.select("doc_id", "text", "source"), ["doc_id", "source"], seed)
    return out.select("doc.doc_id", "doc.source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "p")


def repeated(documents: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    out = mix(documents).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select(*(F.col(f"doc.`{c}`") for c in documents.columns))

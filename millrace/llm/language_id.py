"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's words are its runs of letters, in lower case. A word's features are its grams of
1 to 4 characters, with a mark at either end, and the word itself, each hashed to one of
BUCKETS rows of a table of embeddings. The mean of a text's rows, counted as often as they
occur, goes through a linear layer to a softmax over the languages.

Both tables are learned by stochastic gradient descent in numpy, on the driver, from a
sample: MOST documents in all, as many of each language as there are of the rarest or its
share of MOST, of at most LANGUAGES languages (those with the most documents). Each of them
is cut into pieces of 1 to 64 words, and PIECES of these, drawn from the whole text, are
examples, so that short texts are learned as well as long ones. This bounded sample is the
only thing that the driver sees.

A fifth of the sampled documents is kept for calibration: a scale of the softmax's input is
fitted to them, so that scores are probabilities, and the limit of rejection is the
least score above which at most ERROR of them are wrong. ``rejected`` marks the predictions
below it; the prediction stays, for the caller to use or not.

Scoring reads every whole text once and shuffles nothing. Each task gets the tables, whose
size doesn't depend on the data. Each distinct word of a batch is looked up once.

Null texts and those without a letter are ``und``, with score 0, and are rejected. Documents
of a null id or language, and those held out (the id's crc32 leaves 2 by 4), are never
learned from; of rows that share id and language, the least text is. Of equal scores the first
language by name is predicted. Where nothing can be learned all texts are ``und``. Very long
texts and words are read whole. Rows keep their number; an empty table gives an empty
result. Only doc_id and text, and lang for learning, are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches, sized, written
from millrace.llm.tokens import batched
from millrace.llm.words import mixed

#: Rows and numbers of the embeddings, and the lengths of grams.
BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (1, 2, 3, 4)
#: The sample: documents, languages, pieces of a document, words of a piece.
MOST, LANGUAGES, PIECES, PIECE = 6000, 1000, 6, 64
#: Descent: passes, pieces of a step, and the rate at its start.
PASSES, STEP, RATE = 6, 64, 0.2
#: The share of the sample that calibrates, and of wrong predictions above the limit.
CALIBRATES, ERROR = 5, 0.01
FOLDS, HELD_OUT, NONE = 4, 2, "und"
#: Windows that are looked up at a time, and pieces whose features are.
CUT, SOME = 200_000, 1000


def letters(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of letters, lower-cased, one after another, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    parts = pc.split_pattern(plain, " ")
    flat = parts.flatten()
    real = pc.match_substring_regex(flat, r"\p{L}")
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy().astype(np.int64))])
    return flat.filter(real), np.diff(upto[edges])


def subwords(found: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of all features of some words at a time, ``word`` being its place."""
    length = pc.utf8_length(found).to_numpy().astype(np.int64) + 2
    ends = np.cumsum(length)
    start = 0
    while start < len(found):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CUT, "right")))
        part, size = found.slice(start, stop - start), length[start:stop]
        chars = np.frombuffer(("<" + "><".join(part.to_pylist()) + ">").encode("utf-32-le"), np.uint32)
        spread = mixed(chars.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        word = np.repeat(np.arange(start, stop), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))
        total, place = np.zeros(len(chars), np.uint64), len(chars) - left
        for n in range(1, max(GRAMS) + 1):
            total = total[: len(chars) - n + 1] + spread[n - 1 :] * (mixed(np.array([n], np.uint64)) | np.uint64(1))
            if n in GRAMS:
                whole = left[: len(total)] >= n
                yield (mixed(total[whole] + np.uint64(n)) >> np.uint64(48)).astype(np.int64) % BUCKETS, word[: len(total)][whole]
        # the word itself: each character with its place
        heads = np.cumsum(size) - size
        nth = (np.arange(len(chars)) - np.repeat(heads, size)).astype(np.uint64)
        sums = np.add.reduceat(mixed(spread + nth), heads)
        yield (mixed(sums) >> np.uint64(48)).astype(np.int64) % BUCKETS, np.arange(start, stop)
        start = stop


def add_by(out: np.ndarray, group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``out`` with the rows of ``values`` added to the row of their group; groups are in order."""
    if len(group):
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out[group[heads]] += np.add.reduceat(values, heads, axis=0)
    return out


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, WIDTH), np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH), np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    scale: float = 1.0
    limit: float = 0.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row of the softmax's input for each text, and which have a letter."""
        flat, counts = letters(texts)
        coded = flat.dictionary_encode()
        n = len(coded.dictionary)
        vectors, features = np.zeros((n, WIDTH), np.float32), np.zeros(n, np.int64)
        for bucket, word in subwords(coded.dictionary):
            add_by(vectors, word, self.table[bucket])
            features += np.bincount(word, minlength=n)
        of, at = np.repeat(np.arange(len(counts)), counts), coded.indices.to_numpy()
        total = np.bincount(of, features[at], len(counts))
        mean = add_by(np.zeros((len(counts), WIDTH)), of, vectors[at]) / np.maximum(total, 1)[:, None]
        return mean @ self.weights.T.astype(np.float64) + self.shift, counts > 0

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of each text's language, -1 for none, and its score."""
        if not self.names:
            return np.full(len(texts), -1), np.zeros(len(texts))
        logits, has = self.logits(texts)
        p = softmax(logits * self.scale)
        best = p.argmax(axis=1)
        return np.where(has, best, -1), np.where(has, p[np.arange(len(p)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if x.size else x
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def sample(documents: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, lang, text) of at most ``most`` documents, as many of each language as can be.

    Languages are counted first; a document is drawn by its id's hash at about twice the rate
    that its language needs, and the least hashes of these stay, so no language is gathered
    in one task."""
    known = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = written(counts, "languages")
    n = counts.count()
    each = max(1, most // max(1, n))
    hashed = known.select("doc_id", "lang", (F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("hash"))
    drawn = hashed.join(F.broadcast(counts), "lang").where(F.col("hash") * F.col("count") <= 2.0 * each + 20).select("lang", "doc_id", "hash").distinct()
    ranked = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))).where(F.col("nth") <= each)
    chosen = written(ranked.select("lang", "doc_id"), "drawn")
    return known.join(sized(chosen), ["lang", "doc_id"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def pieces(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, nth, piece) of sampled documents, pieces being words joined by spaces."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            flat, counts = letters(table.column("text").combine_chunks())
            of, nth, text = [], [], []
            for k, (doc_id, n, end) in enumerate(zip(table.column("doc_id").to_pylist(), counts.tolist(), np.cumsum(counts).tolist())):
                rng = np.random.default_rng(zlib.crc32(str(doc_id).encode()))
                cuts = np.cumsum(np.exp(rng.uniform(0, np.log(PIECE + 1), n)).astype(np.int64))
                cuts = np.unique(np.concatenate([[0], cuts[cuts < n], [n]]))
                chosen = np.sort(rng.permutation(len(cuts) - 1)[:PIECES])
                for c in chosen.tolist():
                    of.append(k)
                    nth.append(c)
                    text.append(" ".join(flat.slice(end - n + cuts[c], cuts[c + 1] - cuts[c]).to_pylist()))
            take = lambda c: table.column(c).combine_chunks().take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([take("doc_id"), take("lang"), pa.array(nth, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "lang", "nth", "piece"])

    schema = T.StructType([documents.schema["doc_id"], documents.schema["lang"], T.StructField("nth", T.LongType()), T.StructField("piece", T.StringType())])
    return documents.mapInArrow(read, schema)


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each text one after another, and how many each has."""
    flat, counts = letters(texts)
    coded = flat.dictionary_encode()
    found = [*zip(*subwords(coded.dictionary))] or [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    bucket, word = (np.concatenate(x) for x in found)
    order = np.argsort(word, kind="stable")
    bucket, per = bucket[order], np.bincount(word, minlength=len(coded.dictionary))
    at = coded.indices.to_numpy()
    step = np.arange(int(per[at].sum())) - np.repeat(np.cumsum(per[at]) - per[at], per[at])
    of = np.repeat(np.arange(len(counts)), counts)
    return bucket[np.repeat((np.cumsum(per) - per)[at], per[at]) + step].astype(np.int32), np.bincount(of, per[at], len(counts)).astype(np.int64)


def descend(texts: pa.Array, y: np.ndarray, names: list[str], seed: int = 5) -> Model:
    """The tables after PASSES over the pieces, the rate falling to 0."""
    rng = np.random.default_rng(seed)
    # some at a time, so that the driver holds little but the buckets
    parts = [features_of(texts.slice(k, SOME)) for k in range(0, len(texts), SOME)]
    bucket, counts = (np.concatenate(x) for x in zip(*parts))
    heads = np.cumsum(counts) - counts
    model = Model(names, rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32), np.zeros((len(names), WIDTH), np.float32), np.zeros(len(names), np.float32))
    steps = PASSES * -(-len(y) // STEP)
    for k in range(steps):
        if k % -(-len(y) // STEP) == 0:
            order = rng.permutation(len(y))
        mine = order[(k % -(-len(y) // STEP)) * STEP :][:STEP]
        used = [bucket[heads[i] : heads[i] + counts[i]] for i in mine.tolist()]
        rows, at = np.unique(np.concatenate(used), return_inverse=True)
        share = np.bincount(np.repeat(np.arange(len(mine)), counts[mine]) * len(rows) + at, np.repeat(1 / np.maximum(counts[mine], 1), counts[mine]), len(mine) * len(rows)).reshape(len(mine), -1).astype(np.float32)
        x = share @ model.table[rows]
        off = softmax(x @ model.weights.T + model.shift)
        off[np.arange(len(mine)), y[mine]] -= 1
        rate = np.float32(RATE * (1 - k / steps))
        back = share.T @ (off @ model.weights)
        model.weights -= rate * off.T @ x
        model.shift -= rate * off.sum(axis=0) / len(mine)
        model.table[rows] -= rate * back
    return model


def calibrate(model: Model, texts: pa.Array, y: np.ndarray) -> Model:
    """The model with its scale and limit from pieces that it hasn't seen."""
    if not len(y):
        return model
    logits, _ = model.logits(texts)

    def loss(scale: float) -> float:
        return -float(np.log(np.maximum(softmax(logits * scale)[np.arange(len(y)), y], 1e-12)).mean())

    model.scale = float(min(np.geomspace(0.05, 20, 120), key=loss))
    p = softmax(logits * model.scale)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(wrong <= ERROR)
    model.limit = float(score[order][good[-1]]) if len(good) else 1.0
    return model


def train(documents: DataFrame, most: int = MOST) -> Model:
    """The model of the bounded sample, which comes to the driver as pieces of text."""
    bounded_batches(documents.sparkSession)
    rows = written(pieces(sample(documents, most)), "pieces").toPandas()
    rows = rows[rows["piece"].str.len() > 0].sort_values(["lang", "doc_id", "nth"], kind="stable")
    if rows.empty:
        return Model()
    names = sorted(rows["lang"].unique())
    y = pd.Categorical(rows["lang"], categories=names).codes.astype(np.int64)
    texts = pa.array(rows["piece"].to_list(), pa.large_string())
    # whole documents calibrate, every fifth of a language
    nth = rows.groupby("lang")["doc_id"].transform(lambda x: pd.factorize(x)[0]).to_numpy()
    aside = nth % CALIBRATES == CALIBRATES - 1
    return calibrate(descend(texts.filter(pa.array(~aside)), y[~aside], names), texts.filter(pa.array(aside)), y[aside])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    held = documents.select("doc_id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.names, NONE], pa.string())
        for table in batched(batches):
            best, score = shared.value.predict(table.column("text").combine_chunks())
            at = pa.array(np.where(best < 0, len(names) - 1, best))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), names.take(at), pa.array(score), pa.array((best < 0) | (score < shared.value.limit))], names=["doc_id", "lang_pred", "score", "rejected"])

    out = held.mapInArrow(read, T.StructType([held.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def languages(documents: DataFrame) -> DataFrame:
    """Train on the documents' own languages and predict those of all."""
    return scored(documents, train(documents))

"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of its own characters and words (and
how much of it the document repeats), with those of the lines before and after; the chain
adds how labels follow each other. Forward-backward gives every line's probability of
good, the document's mean of these, weighted by line length, is its raw score, and a
logistic curve, fitted on the same sample, turns that into a probability.

Only documents have labels, so the lines' are latent. In turns, the lines of the sample are
labelled by the model itself, tilted just as far as a document's label demands (of a
document with label 1 at least GOOD_SHARE of the length is good, of one with label 0 at
most BAD_SHARE; posterior regularisation), and the model is fitted to these labels. Real
documents seldom change from good to bad, so that alone would teach the chain that labels
never change: as many chains again are spliced from stretches of a good and a bad one,
with the labels that the lines have in their own documents.

The model learns from labelled documents outside the held-out fold, TRAIN_DOCUMENTS rows
with TRAIN_LINES lines at most (those of the least hash; a document with more lines than
are left is passed over). Nothing but the text is an input. Scoring reads every whole
text once, however long, and shuffles nothing.

A null or empty text has no lines and gets the sample's share of label 1. Labels that are
neither 0 nor 1 and null ids are passed over; repeated labels, also unlike ones, and rows
of one doc_id are samples of their own. Without any usable label all scores are 0.5. A
score of exactly GOOD is good. Rows of documents keep their number; an empty table gives
an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches, written
from millrace.llm.quality_rules import covered_words, per_text
from millrace.llm.tokens import batched
from millrace.llm.words import word_hashes, words

#: The bound of the training sample, the folds, and the score from which a document is good.
TRAIN_DOCUMENTS, TRAIN_LINES, FOLDS, GOOD = 6000, 150_000, 5, 0.3
#: Training cuts longer documents into chains of this many lines; steps and rate of Adam.
CHAIN, STEPS, RATE, DECAY = 64, 200, 0.1, 1e-3
#: Steps between two labellings of the lines, and what the documents' labels demand of them.
RELABEL, GOOD_SHARE, BAD_SHARE = 40, 0.9, 0.5


def _table(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in chars]] = True
    return found


UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER | _table("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
CLASSES = (_table("#*$%&|<>"), UPPER, LETTER, _table("0123456789"), _table("!?.,;:"))
#: Features of a line's own, and those that its neighbours lend it.
OWN, NEIGHBOURS = 8, slice(1, 5)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, lines): a row a line, its length in bytes, and lines per text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    ends = np.cumsum(lengths)
    # a line ends at a line feed or at the end of its text; an empty text has none
    feeds = np.flatnonzero(raw == 10)
    stops = np.concatenate([feeds, ends[lengths > 0]])
    of = np.concatenate([np.searchsorted(ends, feeds, "right"), np.flatnonzero(lengths > 0)])
    order = np.lexsort((stops, of))
    stops, of = stops[order], of[order]
    first = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
    starts = np.where(first, (ends - lengths)[of], np.append(0, stops[:-1] + 1)[: len(stops)])
    size = np.maximum(stops - starts, 0)

    def within(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return upto[np.maximum(stops, starts)] - upto[starts]

    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    opens = ~blank
    opens[1:] &= blank[:-1]
    begins = (ends - lengths)[lengths > 0]
    opens[begins] = ~blank[begins]
    n_words = within(opens)
    flat, counts = words(texts)
    hashed = word_hashes(flat)
    line_of = np.repeat(np.arange(len(n_words)), n_words)
    again = np.zeros(len(flat), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (line_of[1:] == line_of[:-1])
    n = np.maximum(n_words, 1)
    symbols, upper, letter, digits, marks = (within(c[raw]) for c in CLASSES)
    share = lambda x, y: np.minimum(x / np.maximum(y, 1), 3.0)
    own = np.stack(
        [
            np.log1p(n_words),
            share(symbols, n),
            share(upper, letter),
            share(per_text(again, n_words), n),
            share(per_text(covered_words(hashed, counts), n_words), n),
            share(digits, size),
            share(marks, n),
            np.minimum(within(~blank) / n, 40.0),
        ],
        axis=1,
    )
    near = own[:, NEIGHBOURS]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:] = np.where(first[1:, None], 0, near[:-1])
    after[:-1] = np.where(first[1:, None], 0, near[1:])
    lines = np.bincount(of, minlength=len(texts))
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1), size.astype(np.float64), lines


def forward_backward(scores: np.ndarray, lines: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, pairs): each line's probability of good, and the expected number of each pair of
    labels. All chains advance together, the shorter ones dropping out."""
    e = np.stack([1 / (1 + np.exp(np.clip(scores, -30, 30))), 1 / (1 + np.exp(-np.clip(scores, -30, 30)))], axis=1)
    heads = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    heads, lines = heads[order], lines[order]
    longest = int(lines[0]) if len(lines) else 0
    active = np.searchsorted(-lines, -np.arange(longest), "left")
    move = np.exp(steps)
    forward, backward = e.copy(), np.ones_like(e)
    for t in range(longest):
        at = heads[: active[t]] + t
        if t:
            forward[at] *= forward[at - 1] @ move
        forward[at] /= forward[at].sum(axis=1, keepdims=True)
    for t in range(longest - 1, 0, -1):
        at = heads[: active[t]] + t
        back = (backward[at] * e[at]) @ move.T
        backward[at - 1] = back / back.sum(axis=1, keepdims=True)
    both = forward * backward
    p = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
    inner = np.ones(len(scores), bool)
    inner[heads[lines > 0]] = False
    at = np.flatnonzero(inner)
    joint = forward[at - 1][:, :, None] * move[None] * (e[at] * backward[at])[:, None, :]
    joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
    return p, joint.sum(axis=0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    #: The logistic curve over the raw score's logit, and the score without lines.
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Each line's probability of good."""
        return forward_backward(self.scaled(x) @ self.weights, lines, self.steps)[0]

    def raw(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities, by document; nan without lines."""
        return weighted_mean(self.marginals(x, lines), size + 1.0, lines)

    def score(self, texts: pa.Array) -> np.ndarray:
        raw = self.raw(*line_features(texts))
        found = 1 / (1 + np.exp(-(self.slope * logit(raw) + self.shift)))
        return np.where(np.isnan(raw), self.prior, found)


def weighted_mean(p: np.ndarray, heft: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Means of consecutive runs of ``lines`` values; nan where there are none."""
    upto = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    edges = np.concatenate([[0], np.cumsum(lines)])
    total = np.diff(upto(heft)[edges])
    return np.where(lines > 0, np.diff(upto(heft * p)[edges]) / np.maximum(total, 1e-9), np.nan)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _chains(lines: np.ndarray) -> np.ndarray:
    """Lengths of the training chains: each document's lines cut into CHAIN at most."""
    pieces = -(-lines // CHAIN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.minimum(CHAIN, np.repeat(lines, pieces) - nth * CHAIN)


def tilted(scores: np.ndarray, heft: np.ndarray, chains: np.ndarray, good: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The lines' probabilities of good, once each chain's scores are shifted alike, by as
    little as its document's label ``good`` demands."""
    p = forward_backward(scores, chains, steps)[0]
    off = lambda p, which: np.where(good[which], weighted_mean(p, heft_of(which), chains[which]) < GOOD_SHARE, weighted_mean(p, heft_of(which), chains[which]) > BAD_SHARE)
    line_of = np.repeat(np.arange(len(chains)), chains)
    every = np.arange(len(chains))

    def heft_of(which: np.ndarray) -> np.ndarray:
        return heft[np.isin(line_of, which)] if len(which) < len(chains) else heft

    bad = every[off(p, every)]
    if not len(bad):
        return p
    inside = np.isin(line_of, bad)
    sign = np.where(good[bad], 1.0, -1.0)
    low, high = np.zeros(len(bad)), np.full(len(bad), 30.0)
    for _ in range(12):
        middle = (low + high) / 2
        moved = forward_backward(scores[inside] + np.repeat(sign * middle, chains[bad]), chains[bad], steps)[0]
        short = off(moved, bad)
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    p[inside] = forward_backward(scores[inside] + np.repeat(sign * high, chains[bad]), chains[bad], steps)[0]
    return p


def spliced(chains: np.ndarray, good: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(lines, chains): as many chains as there are of the rarer label, each of two stretches
    of a good chain in turn with two of a bad one, by the positions of their lines."""
    rng = np.random.default_rng(seed)
    heads = np.cumsum(chains) - chains
    sides = [rng.permutation(np.flatnonzero((good == g) & (chains > 0))) for g in (True, False)]
    at, lengths = [], []
    for pair in zip(*sides):
        pair = pair if rng.random() < 0.5 else pair[::-1]
        cuts = [int(rng.integers(0, chains[c] + 1)) for c in pair]
        whole = [np.arange(heads[c], heads[c] + chains[c]) for c in pair]
        at += [whole[0][: cuts[0]], whole[1][: cuts[1]], whole[0][cuts[0] :], whole[1][cuts[1] :]]
        lengths.append(int(chains[pair[0]] + chains[pair[1]]))
    return np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64), np.array(lengths, np.int64)


def neighboured(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The features with those of the lines before and after as they are in these ``lines``."""
    out, near = x.copy(), x[:, NEIGHBOURS]
    k, width = OWN, near.shape[1]
    first = np.zeros(len(x), bool)
    first[(np.cumsum(lines) - lines)[lines > 0]] = True
    out[:, k : k + 2 * width] = 0
    inner = np.flatnonzero(~first)
    out[inner, k : k + width] = near[inner - 1]
    out[inner - 1, k + width : k + 2 * width] = near[inner]
    return out


def fit(x: np.ndarray, size: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> Model:
    """The model of most likely document labels, the lines' being latent."""
    scale = x.std(axis=0)
    model = Model(np.where(scale > 0, x.mean(axis=0), 0), np.where(scale > 0, scale, 1), np.zeros(x.shape[1]), np.zeros((2, 2)))
    model.prior = float(np.clip(labels.mean(), 0.01, 0.99))
    if not len(x):
        return model
    chains = _chains(lines)
    good = np.repeat(labels > 0, -(-lines // CHAIN))
    at, more = spliced(chains, good)
    source = np.concatenate([np.arange(len(x)), at])
    own, y = model.scaled(x), np.repeat(labels, lines).astype(float)
    z = np.concatenate([own, model.scaled(neighboured(x[at], more))])
    every = np.concatenate([chains, more])
    inner = np.ones(len(z), bool)
    inner[(np.cumsum(every) - every)[every > 0]] = False
    inner = np.flatnonzero(inner)

    def seen_pairs(y: np.ndarray) -> np.ndarray:
        both = np.stack([1 - y, y], axis=1)
        return both[inner - 1].T @ both[inner]

    target = y[source]
    seen = seen_pairs(target)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        weights, steps = theta[:-4], theta[-4:].reshape(2, 2)
        if k % RELABEL == 0:
            target = tilted(own @ weights, size + 1.0, chains, good, steps)[source]
            seen = seen_pairs(target)
        p, pairs = forward_backward(z @ weights, every, steps)
        up = np.concatenate([(target - p) @ z, (seen - pairs).ravel()]) / len(target) - DECAY * theta
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up * up
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model.weights, model.steps = theta[:-4], theta[-4:].reshape(2, 2)
    raw = model.raw(x, size, lines)
    has = ~np.isnan(raw)
    a, t = np.stack([logit(raw[has]), np.ones(has.sum())], axis=1), labels[has]
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (t - p) - 1e-3 * w)
    model.slope, model.shift = float(w[0]), float(w[1])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS, most_lines: int = TRAIN_LINES) -> Model:
    """Fit on ``most`` labelled rows with ``most_lines`` lines at most, whose features come to the driver."""
    bounded_batches(documents.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = written(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most), "drawn")
    # bounded by ``most`` rows
    sample = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.xxhash64("doc_id", "text", "quality").alias("h"), "text", "quality")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            x, size, lines = line_features(table.column("text").combine_chunks())
            cuts = np.cumsum(lines)
            of = lambda a: [a[e - k : e].astype("<f4").tobytes() for e, k in zip(cuts.tolist(), lines.tolist())]
            yield pa.RecordBatch.from_arrays([table.column("h").combine_chunks(), table.column("quality").combine_chunks(), pa.array(lines), pa.array(of(x), pa.binary()), pa.array(of(size), pa.binary())], names=["h", "quality", "lines", "x", "size"])

    rows = written(sample.mapInArrow(read, "h long, quality int, lines long, x binary, size binary"), "features")
    # repeated rows tie in h: all of them or none
    sizes = rows.groupBy("h").agg(F.sum("lines").alias("lines"), F.count("*").alias("rows")).orderBy("h").limit(most).collect()
    taken, held, left = [], 0, most_lines
    for r in sizes:
        if r["lines"] <= left and held + r["rows"] <= most:
            taken, held, left = [*taken, (r["h"],)], held + r["rows"], left - r["lines"]
    if not taken:
        return Model(np.zeros(17), np.ones(17), np.zeros(17), np.zeros((2, 2)), slope=0.0)
    wanted = F.broadcast(rows.sparkSession.createDataFrame(taken, "h long"))
    rows = rows.join(wanted, "h").orderBy("h").select("quality", "x", "size").toArrow()
    sizes = [np.frombuffer(b, "<f4") for b in rows["size"].to_pylist()]
    lines = np.array([len(s) for s in sizes], np.int64)
    size = np.concatenate([np.zeros(0), *sizes]).astype(np.float64)
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<f4").astype(np.float64)
    x = x.reshape(len(size), -1) if len(size) else np.zeros((0, 17))
    return fit(x, size, lines, rows["quality"].to_numpy().astype(float))


def labelled_lines(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``good``, the probability of good of each of its lines, in order."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    held = documents.select("doc_id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            x, _, lines = line_features(table.column("text").combine_chunks())
            ends = np.concatenate([[0], np.cumsum(lines)]).astype(np.int32)
            good = pa.ListArray.from_arrays(pa.array(ends), pa.array(shared.value.marginals(x, lines)))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), good], names=["doc_id", "good"])

    return held.mapInArrow(read, T.StructType([held.schema["doc_id"], T.StructField("good", T.ArrayType(T.DoubleType()))]))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    held = documents.select("doc_id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            score = shared.value.score(table.column("text").combine_chunks())
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(score)], names=["doc_id", "score"])

    out = held.mapInArrow(read, T.StructType([held.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels and score all documents."""
    return scored(documents, train(documents, labels))

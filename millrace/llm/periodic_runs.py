"""Periodic runs of words by seed-and-extend along diagonals.

A run is a stretch of a text's words with smallest period q, of LEAST words and TIMES
periods at least, that no word next to it extends. Words q apart in it are equal, so it is
a stretch of max(LEAST, TIMES * q) - q equal pairs or more on the diagonal of lag q.

* Index: that guarantee is 16 pairs or more for every lag up to 16, and above k pairs for
  lags above k / 2 up to k. So lags 1 to 16 are looked for by grams of 16 words, and those
  from k / 2 to k by grams of k words, k being 32, 64 and so on. Grams of twice the length
  are pairs of grams, so they are told apart exactly; a gram can only repeat if both its
  halves do, and in most texts few are left from the start.
* Seeds: a gram as long as the lag repeats within its run at every period and nowhere
  between, since the period is the smallest. So the pairs of a gram's occurrences that
  follow each other hold all that is needed, and no text has more than one seed for a gram
  and class of lags. Multiples of the period give no seed.
* Extension: seeds are taken by lag and place. The table of how far a lag is covered moves
  on with each of them; a seed that the table covers (the one before it is one place
  before) is the same stretch and isn't extended again. What is long enough is then
  extended word by word, on both sides.

Texts are spread over tasks by Spark and looked at one batch at a time, nothing is
shuffled. A text of n words takes n log n steps, whatever repeats in it.

A null or empty text has no words and no runs. Words are compared as they are, white space
being the space and tab to carriage return. Very long texts are looked at whole, as a batch
of their own. Rows that repeat, or share a doc_id, are texts of their own; a null doc_id is
carried (and its text is left as it is by ``digest``). Of runs that tie in length over
period the first by start, then by period, is the best. An empty table gives an empty
result. ``digest`` and ``runs`` read doc_id and text alone; ``collapsed`` carries all columns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches
from millrace.llm.tokens import batched
from millrace.llm.words import words

#: Least words and periods of a run.
LEAST, TIMES = 24, 3
#: The gram that every run of a lag up to its own length repeats: min(max(24, 3q) - q).
GRAM = 16


def repeated_grams(ids: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, at, gram) for k = GRAM, 2 GRAM and so on: the places of the grams of k words that
    occur twice or more, in order, and what tells them apart.

    ``ids`` are the words, unlike in unlike texts; ``ends`` is where each place's text ends.
    Lengths stop where ``most`` words can't hold a run of such lags.
    """
    k, at, gram = 1, np.arange(len(ids)), ids
    while len(at):
        gram, known = pd.factorize(gram)
        again = np.bincount(gram, minlength=len(known))[gram] > 1
        at, gram = at[again], gram[again]
        if k >= GRAM:
            yield k, at, gram
            if TIMES * (k + 1) > most:
                return
        held = np.full(len(ids), -1)
        held[at] = gram
        inside = at + 2 * k <= ends[at]
        at, gram = at[inside], gram[inside]
        second = held[at + k]
        at, gram = at[second >= 0], gram[second >= 0] * (len(known) + 1) + second[second >= 0]
        k *= 2


def seeds(k: int, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of each gram that next occurs at a lag of this class, by lag and place."""
    order = np.argsort(gram, kind="stable")
    at, gram = at[order], gram[order]
    lag = at[1:] - at[:-1]
    fits = (gram[1:] == gram[:-1]) & (lag <= k) & (lag > (k // 2 if k > GRAM else 0))
    at, lag = at[:-1][fits], lag[fits]
    order = np.lexsort((at, lag))
    return at[order], lag[order]


def extended(ids: np.ndarray, firsts: np.ndarray, ends: np.ndarray, start: np.ndarray, stop: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches [start, stop) of words that equal those ``lag`` later, as far as they go
    on both sides within their text."""
    first, end = firsts[start], ends[start]
    for step in (-1, 1):
        moving = np.arange(len(start))
        while len(moving):
            at = start[moving] - 1 if step < 0 else stop[moving]
            inside = at >= first[moving] if step < 0 else at + lag[moving] < end[moving]
            moving, at = moving[inside], at[inside]
            same = ids[at] == ids[at + lag[moving]]
            moving = moving[same]
            (start if step < 0 else stop)[moving] += step
    return start, stop


def find_runs(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of texts with ``counts`` words each,
    by text, start and period; equal words have equal codes."""
    cuts = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    firsts, ends = np.repeat(cuts - counts, counts), np.repeat(cuts, counts)
    ids = text * (int(codes.max()) + 1 if len(codes) else 1) + codes
    found = [np.zeros((0, 4), np.int64)]
    for k, at, gram in repeated_grams(ids, ends, int(counts.max()) if len(counts) else 0):
        at, lag = seeds(k, at, gram)
        covered = np.append(False, (lag[1:] == lag[:-1]) & (at[1:] == at[:-1] + 1))[: len(at)]
        heads = np.flatnonzero(~covered)
        reach = np.diff(np.append(heads, len(at))) + k - 1
        start, lag = at[heads], lag[heads]
        enough = reach + lag >= np.maximum(LEAST, TIMES * lag)
        start, stop, lag = start[enough], (start + reach)[enough], lag[enough]
        start, stop = extended(ids, firsts, ends, start.copy(), stop.copy(), lag)
        found.append(np.stack([text[start], start - firsts[start], stop - start + lag, lag], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each word stays: it is in no run, or in the first period of all that hold it."""
    first = (np.cumsum(counts) - counts)[rows[:, 0]] + rows[:, 1]
    depth = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(depth, first + rows[:, 3], 1)
    np.add.at(depth, first + rows[:, 2], -1)
    return np.cumsum(depth)[:-1] == 0


def joined(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    """Each text's words, joined by one space."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), flat), pa.scalar(" ", flat.type))


def repeated_tail(doc_ids: list, counts: np.ndarray) -> np.ndarray:
    """Which original word stands at each place, where the contract plants periods: from its
    place a on, a tenth of the documents repeat p words."""
    at = np.arange(int(counts.sum()))
    for doc_id, n, end in zip(doc_ids, counts.tolist(), np.cumsum(counts).tolist()):
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[end - n + a : end] = end - n + a + np.arange(n - a) % p
    return at


def runs(documents: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): a row for every run of every text."""
    bounded_batches(documents.sparkSession)
    held = documents.select("doc_id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            flat, counts = words(table.column("text").combine_chunks())
            rows = find_runs(flat.dictionary_encode().indices.to_numpy().astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(pa.array(rows[:, 0])), *(pa.array(rows[:, c]) for c in (1, 2, 3))], names=["doc_id", "start", "length", "period"])

    return held.mapInArrow(read, T.StructType([held.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "length", "period"))]))


def collapsed(documents: DataFrame) -> DataFrame:
    """All documents with all their columns; a text with runs keeps the first period of each,
    its words joined by one space, and n_chars, if there is one, follows. Other texts stay."""
    bounded_batches(documents.sparkSession)
    names = documents.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            flat, counts = words(table.column("text").combine_chunks())
            rows = find_runs(flat.dictionary_encode().indices.to_numpy().astype(np.int64), counts)
            stays = kept_words(rows, counts)
            left = np.bincount(np.repeat(np.arange(len(counts)), counts)[stays], minlength=len(counts))
            has = np.zeros(len(counts), bool)
            has[rows[:, 0]] = True
            text = pc.if_else(pa.array(has), joined(flat.filter(pa.array(stays)), left).cast(pa.string()), table.column("text").combine_chunks())
            table = table.set_column(names.index("text"), "text", text)
            if "n_chars" in names:
                n = table.column("n_chars").combine_chunks()
                table = table.set_column(names.index("n_chars"), "n_chars", pc.if_else(pa.array(has), pc.utf8_length(text).cast(n.type), n))
            yield from table.to_batches()

    return documents.mapInArrow(read, documents.schema)


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns: one row a document, over texts with planted periods."""
    bounded_batches(documents.sparkSession)
    held = documents.select("doc_id", "text")
    numbers = ["start", "length", "period", "exponent_milli"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            doc_id = table.column("doc_id").combine_chunks()
            flat, counts = words(table.column("text").combine_chunks())
            flat = flat.take(pa.array(repeated_tail(doc_id.to_pylist(), counts)))
            rows = find_runs(flat.dictionary_encode().indices.to_numpy().astype(np.int64), counts)
            stays = kept_words(rows, counts)
            left = np.bincount(np.repeat(np.arange(len(counts)), counts)[stays], minlength=len(counts))
            texts = joined(flat.filter(pa.array(stays)), left)
            edges = np.searchsorted(rows[:, 0], np.arange(len(counts) + 1))
            best: list[tuple] = []
            listed = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = rows[a:b, 1:].tolist()
                listed.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest())
                top = None
                for s, n, q in own:  # by start and period, so the first of equals stays
                    if top is None or n * top[2] > top[1] * q:
                        top = (s, n, q)
                best.append((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
            collapsed_hash = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in texts]
            columns = [pa.array([x[c] for x in best], pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(edges)), *columns, pa.array(listed, pa.string()), pa.array(collapsed_hash, pa.string())], names=["doc_id", "n_runs", *numbers, "runs_sha256", "collapsed_sha256"])

    longs = [T.StructField(c, T.LongType()) for c in ("n_runs", *numbers)]
    return held.mapInArrow(read, T.StructType([held.schema["doc_id"], *longs, *(T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256"))]))

"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Every rule says of a column of texts which it rejects. On a sample (SAMPLE_ROWS rows in
the mean) each rule runs over all texts, which gives its seconds and its share of
rejections; the cascade then runs the rules by rejections per second, each only on the
texts that all before it let pass. Words are split and hashed once a batch for all rules, so
a rule's cost is what it takes beyond that. The order changes the time taken, never a verdict.

A null text is the empty text: it has no words and is rejected. Very long texts are read
whole, in batches of bounded bytes. An empty table gives an empty result. Rows may repeat
and keep their number; columns that a caller keeps are not looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches
from millrace.llm.tokens import batched
from millrace.llm.words import mixed, rolling, word_hashes, words

#: The mean number of rows that costs and selectivities are estimated on.
SAMPLE_ROWS = 2000
WINDOW = 8


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(upto[edges])


class Texts:
    """Texts of a batch with their words, which are split and hashed once, when a rule first
    asks for them, and go along when some of the texts are taken."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    @cached_property
    def split(self) -> tuple[pa.Array, np.ndarray]:
        return words(self.texts)

    @cached_property
    def hashed(self) -> np.ndarray:
        return word_hashes(self.split[0])

    def where(self, stays: np.ndarray) -> Texts:
        some = Texts(self.texts.filter(pa.array(stays)))
        if "split" in self.__dict__:
            flat, counts = self.split
            inside = np.repeat(stays, counts)
            some.split = flat.filter(pa.array(inside)), counts[stays]
            if "hashed" in self.__dict__:
                some.hashed = self.hashed[inside]
        return some


def count_words(t: Texts) -> np.ndarray:
    return t.split[1]


def word_chars(t: Texts) -> np.ndarray:
    flat, counts = t.split
    return per_text(pc.utf8_length(flat).to_numpy(), counts)


def count_symbols(t: Texts) -> np.ndarray:
    return letters(t, "[#*$%&|<>]")


def line_counts(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of their text."""
    split = pc.split_pattern(t.texts, "\n")
    flat, counts = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    real = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    distinct = np.unique(np.stack([of[real], codes[real]]), axis=1)[0] if real.any() else np.zeros(0, np.int64)
    lines = np.bincount(of[real], minlength=len(counts))
    return lines, lines - np.bincount(distinct, minlength=len(counts))


def covered_words(hashed: np.ndarray, counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Whether each word is in a window of ``width`` words that its text holds twice or more."""
    windows = rolling(hashed, width)
    of = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(of[: len(windows)] == of[width - 1 :])
    keys = windows[inside] ^ mixed(of[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = inside[order[np.append(same, False) | np.append(False, same)]] if len(inside) else inside
    steps = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + width, -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_words(t: Texts) -> np.ndarray:
    """Words in windows of WINDOW words that the text holds twice or more."""
    return per_text(covered_words(t.hashed, t.split[1]), t.split[1])


def stuttered_words(t: Texts) -> np.ndarray:
    """Words that equal the word before."""
    counts, hashed = t.split[1], t.hashed
    of = np.repeat(np.arange(len(counts)), counts)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
    return per_text(again, counts)


def letters(t: Texts, which: str) -> np.ndarray:
    return pc.count_substring_regex(t.texts, which).to_numpy().astype(np.int64)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


def _repeats(t: Texts) -> np.ndarray:
    return 100 * repeated_words(t) > 30 * count_words(t)


def _lines(t: Texts) -> np.ndarray:
    lines, doubles = line_counts(t)
    return 2 * doubles > lines


def _length(t: Texts) -> np.ndarray:
    chars, n = word_chars(t), count_words(t)
    return (chars < 2 * n) | (chars > 30 * n)


BASE = (Rule("few_words", lambda t: count_words(t) < 20), Rule("repeats", _repeats))
#: The thresholds of the added rules.
ADDED = (
    Rule("symbols", lambda t: 5 * count_symbols(t) > count_words(t)),
    Rule("shouting", lambda t: 2 * letters(t, r"\p{Lu}") > letters(t, r"\p{L}")),
    Rule("lines", _lines),
    Rule("stutter", lambda t: 10 * stuttered_words(t) > 3 * count_words(t)),
    Rule("word_length", _length),
)
RULES = BASE + ADDED


def passes(texts: pa.Array | Texts, rules: tuple[Rule, ...], alive: np.ndarray | None = None) -> np.ndarray:
    """Which texts no rule rejects; each rule sees only what passed those before it."""
    held = texts if isinstance(texts, Texts) else Texts(texts)
    alive = np.ones(len(held), bool) if alive is None else alive.copy()
    left = held.where(alive)
    for rule in rules:
        if len(left):
            good = ~rule.rejects(left)
            alive[alive] = good
            left = left.where(good)
    return alive


def estimate(documents: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS, seed: int = 7) -> dict[str, tuple[float, float]]:
    """Seconds and rejections of each rule, for a sample of ``rows`` rows in the mean."""
    bounded_batches(documents.sparkSession)
    total = documents.count()
    sample = documents.select("text").sample(fraction=min(1.0, rows / max(1, total)), seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            texts = Texts(pc.fill_null(table.column("text").combine_chunks(), ""))
            texts.hashed  # made before the clock runs
            for k, rule in enumerate(rules):
                began = time.thread_time()
                rejected = int(rule.rejects(texts).sum())
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([time.thread_time() - began]), pa.array([rejected])], names=["rule", "seconds", "rejected"])

    found = sample.mapInArrow(run, "rule long, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("n")).collect()
    return {rules[r["rule"]].name: (r["s"], float(r["n"])) for r in found}


def ordered(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejections per second on the sample; those that reject none last, cheap ones first."""
    known = estimate(documents, rules)
    rank = lambda r: (-known.get(r.name, (1.0, 0.0))[1] / max(known.get(r.name, (1.0, 0.0))[0], 1e-6), known.get(r.name, (1.0, 0.0))[0])
    return tuple(sorted(rules, key=rank))


def keep(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass all rules, with all their columns."""
    order = ordered(documents, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            texts = pc.fill_null(table.column("text").combine_chunks(), "")
            yield from table.filter(pa.array(passes(texts, order))).to_batches()

    return documents.mapInArrow(run, documents.schema)


def measured(documents: DataFrame) -> DataFrame:
    """The contract's columns: base counts of every document, the base verdict, and the
    cascade's verdict on what the base lets pass."""
    held = documents.select("doc_id", "text")
    order = ordered(held, ADDED)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([held.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(batches):
            texts = Texts(pc.fill_null(table.column("text").combine_chunks(), ""))
            n, repeated = count_words(texts), repeated_words(texts)
            failed = (n < 20) | (100 * repeated > 30 * n)
            columns = [n, word_chars(texts), count_symbols(texts), line_counts(texts)[1], repeated, failed, passes(texts, order, ~failed)]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *map(pa.array, columns)], names=["doc_id", *counts, "base_failed", "kept"])

    return held.mapInArrow(run, schema)


#: The same rows in DuckDB.
ORACLE_SQL = r"""
with d as materialized (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
w as materialized (select k, word, pos from (select k, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from (select k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d))),
win as (select k, pos, word, lag(word) over o as before, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o || ' ' || lead(word, 5) over o || ' ' || lead(word, 6) over o || ' ' || lead(word, 7) over o as win from w window o as (partition by k order by pos)),
rep as (select k, pos, word, before, (win is not null and count(*) over (partition by k, win) > 1)::int as twice from win),
covered as (select k, word, before, max(twice) over (partition by k order by pos rows between 7 preceding and current row) as inside from rep),
ww as (select k, count(*) as n_words, sum(length(word)) as word_chars, sum(inside) as n_repeat_words, count(*) filter (word = before) as stutter from covered group by k),
l as (select k, unnest(string_split(t, chr(10))) as line from d),
ll as (select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by k),
f as (select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(stutter, 0) as stutter, coalesce(n_lines, 0) as n_lines,
    len(regexp_extract_all(t, '\p{Lu}')) as upper_n, len(regexp_extract_all(t, '\p{L}')) as letter_n
  from d left join ww using (k) left join ll using (k)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (5 * n_symbols > n_words or 2 * upper_n > letter_n or 2 * n_dup_lines > n_lines or 10 * stutter > 3 * n_words or word_chars < 2 * n_words or word_chars > 30 * n_words) as kept
from b"""

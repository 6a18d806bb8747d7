"""Byte-level BPE of whole Arrow columns with the tokenizers library.

A space that follows a character other than white space always starts a new pre-token,
and a line feed between two such characters is one of its own, so a text's ids are the ids
of its space-led chunks, line feeds and first words of lines, one after another. These repeat
far more often than texts: each distinct chunk of a batch is encoded once and the ids
are gathered by numpy. A mark that ends a chunk after a letter is a pre-token too, so a word
is encoded once with and without it. Texts with white space before a space, or with a special string of
the tokenizer, are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space before a space; there the cut at spaces would not be exact.
_UNSAFE = r"[\x09-\x0d\x1c-\x1f\x{85}\p{Z}] "
#: A line feed that is a pre-token, and what is put before pieces that no space leads.
_FEED, _BARE = r"([^\x09-\x0d\x1c-\x1f\x{85}\p{Z}])\n([^\x09-\x0d\x1c-\x1f\x{85}\p{Z}])", "\ue000"
#: Marks that are cut off a chunk's end, and where: after a letter (of those that every version
#: of Unicode has as one).
MARKS = ".,;:!?"
_MARKED = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}][.,;:!?]$"
#: Texts are gathered to this many bytes for arrays over their words.
BATCH_BYTES = 1 << 20
#: Texts that go to the tokenizer in one call: it makes an object of some hundred bytes a token.
CALL_BYTES, CALL_WORDS = 1 << 19, 16_384
#: Chunks that are joined to one text for it.
JOINED = 64
#: Bytes of chunks, and as many of their ids, that a worker keeps for its next batches.
KNOWN_BYTES = 8 << 20


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, with its own settings, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _flat_ids(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after another, and how many each has."""
    found = [np.array(e.ids, np.int32) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    return np.concatenate([np.zeros(0, np.int32), *found]), np.fromiter(map(len, found), np.int64, len(found))


def _calls(sizes: np.ndarray) -> Iterator[slice]:
    """Cuts of consecutive texts of about CALL_BYTES; a longer text is one of its own."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        upto = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CALL_BYTES, "right"))
        stop = max(start + 1, min(upto, start + CALL_WORDS))
        yield slice(start, stop)
        start = stop


def _encode(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the texts, and where each text's ids start and how many they are.

    Texts without inner white space are joined by line feeds, a pre-token of its own
    there, and encoded many at a time; the line feeds' id then marks their ends.
    """
    newline = tokenizer(path).encode("\n", add_special_tokens=False).ids
    single = pc.match_substring_regex(texts, r"^ ?[^\x09-\x0d\x1c-\x1f\x{85}\p{Z}]+$").to_numpy(zero_copy_only=False).astype(bool)
    single &= ~_special(path, texts)
    if len(newline) != 1:
        single[:] = False
    ids, starts, counts, base = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
    word_at, other_at = np.flatnonzero(single), np.flatnonzero(~single)
    for k in range(0, len(word_at), CALL_WORDS):
        at = word_at[k : k + CALL_WORDS]
        edges = np.append(np.arange(0, len(at), JOINED), len(at))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges), texts.take(pa.array(at))), pa.scalar("\n", pa.large_string()))
        flat, _ = _flat_ids(path, [x + "\n" for x in joined.to_pylist()])
        ends = np.flatnonzero(flat == newline[0])
        begins = np.concatenate([[0], ends[:-1] + 1])
        starts[at], counts[at] = base + begins, ends - begins
        ids.append(flat)
        base += len(flat)
    others = texts.take(pa.array(other_at))
    for cut in _calls(pc.binary_length(others).to_numpy()):
        flat, n = _flat_ids(path, others[cut].to_pylist())
        starts[other_at[cut]], counts[other_at[cut]] = base + np.cumsum(n) - n, n
        ids.append(flat)
        base += len(flat)
    return np.concatenate(ids), starts, counts


def _special(path: str, texts: pa.Array) -> np.ndarray:
    """Which texts hold a special string, which the tokenizer takes out before all else."""
    found = np.zeros(len(texts), bool)
    for token in tokenizer(path).get_added_tokens_decoder().values():
        found |= pc.match_substring(texts, token.content).to_numpy(zero_copy_only=False).astype(bool)
    return found


def _marks(path: str, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Which chunks end with a letter and a mark, which is then a pre-token of its own and one
    id, and those ids."""
    ids = [tokenizer(path).encode(m, add_special_tokens=False).ids for m in MARKS]
    if any(len(x) != 1 for x in ids):
        return pa.array(np.zeros(len(words), bool)), np.zeros(0, np.int32)
    ends = np.zeros(len(words), bool)
    for m in MARKS:
        ends |= pc.ends_with(words, m).to_numpy(zero_copy_only=False)
    ends[ends] = pc.match_substring_regex(words.filter(pa.array(ends)), _MARKED).to_numpy(zero_copy_only=False)
    ends = pa.array(ends)
    at = pc.index_in(pc.utf8_slice_codeunits(words.filter(ends), -1), value_set=pa.array(list(MARKS), pa.large_string()))
    return ends, np.array(ids, np.int32).ravel()[at.to_numpy()]


class _Known:
    """Chunks that this process has encoded, with their ids, up to ``most`` bytes of each; then
    no more are added, the commonest being there by then."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, path: str, words: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and count of each word in them."""
        ends, marks = _marks(path, words)
        bare = pc.replace_with_mask(words, ends, pc.utf8_slice_codeunits(words.filter(ends), 0, -1))
        at = pc.fill_null(pc.index_in(bare, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = at < 0
        coded = bare.filter(pa.array(new)).dictionary_encode()
        fresh = coded.dictionary
        ids, starts, counts = _encode(path, fresh)
        held, base = len(self.words), len(self.ids)
        at[new] = held + coded.indices.to_numpy()
        all_ids, all_starts, all_counts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, base + starts]), np.concatenate([self.counts, counts])
        if max(self.words.nbytes + fresh.nbytes, all_ids.nbytes) <= most:
            self.words = pa.concat_arrays([self.words, fresh])
            self.ids, self.starts, self.counts = all_ids, all_starts, all_counts
        # the words' ids next to each other, with those of the marks
        marked = ends.to_numpy(zero_copy_only=False)
        counts = all_counts[at] + marked
        stops = np.cumsum(counts)
        out, of_word = np.empty(int(counts.sum()), np.int32), np.ones(int(counts.sum()), bool)
        of_word[stops[marked] - 1] = False
        out[~of_word] = marks
        out[of_word] = gather(all_ids, all_starts[at], all_counts[at])
        return out, stops - counts, counts


@lru_cache(maxsize=2)
def _known(path: str) -> _Known:
    return _Known()


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start : start + count] of each pair, one after another."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return values[:0]
    kind = np.int32 if max(int(ends[-1]), len(values)) < 1 << 31 else np.int64  # half the memory
    at = np.repeat((starts - (ends - counts)).astype(kind), counts)
    at += np.arange(ends[-1], dtype=kind)
    return values[at]


def encode(texts: pa.Array, path: str, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each text; null: empty.
    ``known`` bounds the bytes of chunks that are kept for the next call (KNOWN_BYTES)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    unsafe = pc.or_(pc.match_substring_regex(texts, f"{_UNSAFE}|{_BARE}"), pa.array(_special(path, texts)))
    safe = pc.replace_substring_regex(pc.if_else(unsafe, "", texts), _FEED, f"\\1 {_BARE}\n {_BARE}\\2")
    chunks = pc.split_pattern(safe, " ")
    coded = chunks.flatten().dictionary_encode()
    led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
    spaced, slots = pc.if_else(pc.starts_with(coded.dictionary, _BARE), pc.replace_substring(coded.dictionary, _BARE, ""), led), coded.indices.to_numpy().astype(np.int64)
    per_text = pc.list_value_length(chunks).to_numpy().astype(np.int64)
    firsts = np.cumsum(per_text) - per_text
    # a text's first chunk has no space before it; such chunks, and whole texts, get slots of their own
    is_whole = unsafe.to_numpy(zero_copy_only=False).astype(bool)
    whole, at_first = texts.filter(unsafe), firsts[~is_whole]
    lead, lead_slots = np.unique(slots[at_first], return_inverse=True)
    slots[at_first] = len(spaced) + lead_slots
    slots[firsts[is_whole]] = len(spaced) + len(lead) + np.arange(len(whole))
    ids, starts, counts = _known(path).look_up(path, spaced, KNOWN_BYTES if known is None else known)
    more, more_starts, more_counts = _encode(path, pa.concat_arrays([coded.dictionary.take(pa.array(lead)), whole]))
    starts, counts = np.concatenate([starts, len(ids) + more_starts]), np.concatenate([counts, more_counts])
    ids = np.concatenate([ids, more])
    per_slot = counts[slots]
    out = gather(ids, starts[slots], per_slot)
    sums = np.concatenate([[0], np.cumsum(per_slot)])
    edges = np.concatenate([firsts, [len(slots)]])
    return out, np.diff(sums[edges])


def batched(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """The batches of a task joined, or cut by rows, to about ``most`` bytes of text each."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = -(-batch.column(text).nbytes // most) or 1
        step = -(-batch.num_rows // parts)
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            held.append(part)
            size += part.column(text).nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    # idle workers would keep what Arrow has freed
    held.clear()
    pa.default_memory_pool().release_unused()


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))

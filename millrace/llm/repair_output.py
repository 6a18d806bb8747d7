"""Token output, compressed by Re-Pair: frequent pairs of ids become nonterminals, shard by shard.

Documents are dealt by ranges of doc_id (null first) and encoded in order. A task closes a
shard when it holds SHARD_TOKENS ids, at the end of a document, so a shard is one document
or bounded. In every round the shard's most frequent pairs are replaced, from left to
right and not across the end of a document, until no pair is frequent. Many pairs a round,
rather than one, is what makes this linear passes over arrays. A rule costs about three
symbols (its pair and its length), and pairs that overlap lose some of the uses that were
counted; a pair is frequent from LEAST_USES on, where bytes were least as measured.

A shard's file holds the rules, how many ids each nonterminal stands for, the sequence,
and for each document its id, its ids and its symbols. Symbols are packed in as many bits
as the largest needs, so their number has no bound. No symbol spans two documents: with
the prefix sums of the symbols a document, and with those of the lengths any stretch of
ids, is decoded without what stands before it (``document``, ``stretch``). Spark writes the
shards as rows of a Parquet table, so that any store it knows will do; each row also has
the number of the partition's ids before the shard.

A null text is the empty text: its end id alone. A very long text is one shard. Repeated
rows, and rows of one doc_id, are documents of their own, next to each other in the order
of a hash of their text. An empty table gives empty output. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, source_partitions, written
from millrace.llm.packing import with_end
from millrace.llm.tokens import batched, crc, encode, gather, tokenizer, vocabulary

SHARD_TOKENS = 1 << 20
#: Pairs replaced in one round, and the least uses of a frequent pair.
PAIRS, LEAST_USES = 5000, 8
#: Bits of the hash by which pairs were once told apart; a test picks its pairs by it.
COUNTED = 18
#: Documents that are read back at a time.
AT_A_TIME = 512
#: Texts that are encoded at a time, and chunks that are kept for the next, in bytes.
TEXT_BYTES, CHUNK_BYTES = 4 << 20, 16 << 20
END = 0
MAGIC, HEAD = b"RPT2", struct.Struct("<4sqqqqq")


def sorted_pairs(first: np.ndarray, second: np.ndarray, at: np.ndarray, most: int, size: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """(codes, places, bits): the pairs of symbols up to ``most`` at ascending places below
    ``size``, in the order of their codes, first << bits | second, and then of their places."""
    bits, shift = np.uint64(most.bit_length()), np.uint64(size.bit_length())
    codes = first.astype(np.uint64)
    if 2 * int(bits) + int(shift) <= 64:  # pair and place in one number
        for by, part in ((bits, second), (shift, at.view(np.uint64))):
            codes <<= by
            codes |= part
        codes.sort()
        places = codes & ((np.uint64(1) << shift) - np.uint64(1))
        codes >>= shift
        return codes, places.view(np.int64), bits
    codes <<= np.uint64(32)
    codes |= second
    order = np.argsort(codes, kind="stable")
    return codes[order], at[order], np.uint64(32)


def compress(ids: np.ndarray, last: np.ndarray, base: int, pairs: int = PAIRS, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, sequence, last): rules[k] is the pair that symbol base + k stands for; ``last``
    marks the symbols that end a document."""
    rules, none = [], -1
    seq, last, used = ids.astype(np.uint32), last.copy(), base
    # where a pair starts that may be frequent; a rare one gets no further uses by later rounds
    live = ~last
    live[-1:] = False
    while True:
        at = np.flatnonzero(live)
        codes, places, bits = sorted_pairs(seq[at], seq[at + 1], at, used, len(seq))
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
        uses = np.diff(np.append(starts, len(codes)))
        frequent = np.flatnonzero(uses >= least)
        if not len(frequent):
            break
        chosen = np.sort(frequent[np.argsort(-uses[frequent], kind="stable")[:pairs]])
        # each place's rule, by its pair; frequent pairs that wait for a later round have the number after
        named = np.full(len(uses), none, np.int32)
        named[frequent] = len(chosen)
        named[chosen] = np.arange(len(chosen))
        rule = np.full(len(seq), none, np.int32)
        rule[places] = np.repeat(named, uses)
        live = rule != none
        at = np.flatnonzero(live & (rule < len(chosen)))
        # of places that overlap in a row, every second one is replaced
        place = np.arange(len(at), dtype=np.int32)
        heads = np.where(np.append(True, np.diff(at) != 1), place, np.int32(0))
        at = at[(place - np.maximum.accumulate(heads)) % 2 == 0]
        found = codes[starts[chosen]]
        rules.append(np.stack([found >> bits, found & ((np.uint64(1) << bits) - np.uint64(1))], axis=1).astype(np.int64))
        seq[at] = np.uint32(used) + rule[at].view(np.uint32)
        last[at] = last[at + 1]
        # the pairs on both sides of a new symbol are new
        live[at], live[at[at > 0] - 1] = True, True
        live &= ~last
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq, last, live, used = seq[stays], last[stays], live[stays], used + len(chosen)
        live[-1] = False
    return np.concatenate([np.zeros((0, 2), np.int64), *rules]), seq.astype(np.int64), last


def _wide(bits: int) -> int:
    return 32 if bits <= 32 else 64


def packed(values: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits each, one after another, least bit first."""
    wide, parts = _wide(bits), []
    for k in range(0, len(values), 1 << 16):  # a multiple of eight numbers ends with a byte
        part = values[k : k + (1 << 16)].astype(f"<u{wide // 8}").view(np.uint8)
        parts.append(np.packbits(np.unpackbits(part, bitorder="little").reshape(-1, wide)[:, :bits], bitorder="little").tobytes())
    return b"".join(parts)


def unpacked(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    """``n`` numbers that ``packed`` wrote."""
    wide, out, step = _wide(bits), np.zeros(n, np.int64), 1 << 16
    for k in range(0, n, step):
        part = np.zeros((min(step, n - k), wide), np.uint8)
        part[:, :bits] = np.unpackbits(data[k * bits // 8 : (k + step) * bits // 8], bitorder="little")[: len(part) * bits].reshape(-1, bits)
        out[k : k + step] = np.packbits(part, bitorder="little").view(f"<u{wide // 8}")
    return out


def spans(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for; a rule uses earlier ones only."""
    out = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    while (seq >= base).any():
        is_rule = seq >= base
        starts = np.cumsum(1 + is_rule) - 1 - is_rule
        out = np.empty(int(starts[-1]) + 1 + int(is_rule[-1]), np.int64)
        pairs = rules[seq[is_rule] - base]
        out[starts[~is_rule]] = seq[~is_rule]
        out[starts[is_rule]], out[starts[is_rule] + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


def to_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """A shard in the file format."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    rules, seq, last = compress(ids, last, base)
    symbols = np.diff(np.append(-1, np.flatnonzero(last)))
    bits = int(base + len(rules)).bit_length()
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [HEAD.pack(MAGIC, base, len(rules), len(seq), len(doc_ids), bits), packed(rules.ravel(), bits), spans(rules, base).astype("<u4").tobytes()]
    return b"".join([*parts, packed(seq, bits), named.tobytes(), known.tobytes(), counts.astype("<i8").tobytes(), symbols.astype("<i8").tobytes()])


class Shard:
    """A shard that was read."""

    def __init__(self, data: bytes) -> None:
        magic, self.base, n_rules, n_seq, n_docs, bits = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no shard of this format")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        symbols = lambda n: unpacked(take("<u1", -(-n * bits // 8)), bits, n)
        self.rules = symbols(2 * n_rules).reshape(-1, 2)
        self.spans = take("<u4", n_rules).astype(np.int64)
        self.seq = symbols(n_seq)
        named, known = take("<i8", n_docs), take("<u1", n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(named, known)]
        self.counts, self.symbols = take("<i8", n_docs), take("<i8", n_docs)
        self.starts = np.concatenate([[0], np.cumsum(self.symbols)])

    @cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of every symbol, one symbol after another, and each one's start and number.
        A round's rules are together at most 2 / LEAST_USES as long as the shard."""
        counts = np.concatenate([np.ones(self.base, np.int64), self.spans])
        ids = expand(np.arange(len(counts)), self.rules, self.base)
        return ids, np.cumsum(counts) - counts, counts

    def decoded(self, first: int, stop: int) -> np.ndarray:
        """The ids of the symbols from ``first`` to ``stop``."""
        ids, starts, counts = self.expansions
        seq = self.seq[first:stop]
        return gather(ids, starts[seq], counts[seq])

    def ids(self) -> np.ndarray:
        return self.decoded(0, len(self.seq))

    def documents(self, first: int, stop: int) -> np.ndarray:
        """The ids of the documents from ``first`` to ``stop``, by their symbols alone."""
        return self.decoded(self.starts[first], self.starts[stop])

    @cached_property
    def ends(self) -> np.ndarray:
        """Where each symbol's ids end."""
        lengths = np.ones(len(self.seq), np.int64)
        is_rule = self.seq >= self.base
        lengths[is_rule] = self.spans[self.seq[is_rule] - self.base]
        return np.cumsum(lengths)

    def stretch(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, by decoding only the symbols that cover them."""
        if stop <= start or not len(self.ends):
            return self.seq[:0]
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left")
        first = int(self.ends[a - 1]) if a else 0
        return self.decoded(a, b + 1)[start - first : stop - first]


def write_shards(documents: DataFrame, path: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(part, shard, before, n, data): the shards in the shared folder; parts ascend in
    doc_id, shards within them, and ``before`` counts the part's ids before the shard."""
    path = path or vocabulary()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        base = tokenizer(path).get_vocab_size()
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = to_bytes(names, np.concatenate(counts), np.concatenate(ids), base)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int64()), (shard, pa.int64()), (before, pa.int64()), (size, pa.int64()), (data, pa.binary()))], names=["part", "shard", "before", "n", "data"])

        for table in batched(batches, most=TEXT_BYTES):
            found, n = encode(table.column("text").combine_chunks(), path, CHUNK_BYTES)
            found, n = with_end(found, n, end), n + 1
            ends, docs, done = np.cumsum(n), table.column("doc_id").to_pylist(), 0
            while done < len(n):
                start = int(ends[done - 1]) if done else 0
                stop = min(len(n), int(np.searchsorted(ends, start + shard_tokens - size)) + 1)
                names += docs[done:stop]
                counts.append(n[done:stop])
                ids.append(found[start : int(ends[stop - 1])])
                size += int(ends[stop - 1]) - start
                done = stop
                if size >= shard_tokens:
                    yield close()
                    shard, before, size = shard + 1, before + size, 0
                    names, counts, ids = [], [], []
        if names:
            yield close()

    bounded_batches(documents.sparkSession)
    held = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = held.repartitionByRange(source_partitions(held), F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    return written(dealt.mapInArrow(read, "part long, shard long, before long, n long, data binary"), "shards")


def digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards."""
    totals = shards.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).astype(np.int64)
    bases = shards.sparkSession.sparkContext.broadcast({r["part"]: int(s) for r, s in zip(totals, starts)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(batch.column(c) for c in ("part", "before", "data"))):
                shard = Shard(data.as_py())
                n, ends = shard.counts, np.cumsum(shard.counts)
                sums = []
                # documents in turn by their symbols and as a stretch of ids, both without what stands before
                for k in range(0, len(n), AT_A_TIME):
                    stop = min(len(n), k + AT_A_TIME)
                    first = int(ends[k - 1]) if k else 0
                    ids = (shard.documents(k, stop) if k // AT_A_TIME % 2 else shard.stretch(first, int(ends[stop - 1]))).astype("<u4")
                    sums += [crc(ids[e - c - first : e - first]) for e, c in zip(ends[k:stop].tolist(), n[k:stop].tolist())]
                start = bases.value[part.as_py()] + before.as_py() + ends - n
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(start), pa.array(n), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Packing: concatenate and cut.

All documents' ids, an end id after each, form one sequence in the order of the table's
partitions. The first pass encodes the documents once and writes the ids with each
document's place in its partition. Prefix sums over the partitions' totals (one number a
partition) then give every document its place in the whole, and the second pass cuts at
multiples of the sequence length. A document that crosses a cut gives a piece on either
side: these are the boundary records, and no id is moved for them. Every sequence but the
last is full.

A null text is the empty text and gives its end id alone. A very long text is encoded
whole and gives as many pieces as it crosses cuts. Repeated rows, and rows of one doc_id,
are documents of their own; a null doc_id is carried. Nothing is ordered by value, so
there are no ties. An empty table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches, written
from millrace.llm.tokens import batched, crc, encode, gather, tokenizer, vocabulary

LENGTH, END = 2048, 1
#: Packed ids that are cut at a time.
PIECE_BYTES = 1 << 20
#: Chunks that a worker keeps for its next batches: less than the encoder's own bound, since an
#: executor's heap is full by the last stage of a pipeline.
KNOWN_BYTES = 2 << 20


def encoded(documents: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, part, before, n, ids): ids packed little-endian in 2 or 4 bytes, and the ids
    of the partition before the document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        kind = "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
        for table in batched(batches):
            ids, n = encode(table.column("text").combine_chunks(), path, KNOWN_BYTES)
            packed = with_end(ids, n, end).astype(kind).tobytes()
            n = n + 1
            ends = np.cumsum(n)
            step = np.dtype(kind).itemsize
            offsets = np.concatenate([[0], ends]) * step
            rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(np.full(len(n), part)), pa.array(before + ends - n), pa.array(n), rows.cast(pa.binary())], names=["doc_id", "part", "before", "n", "ids"])
            before += int(ends[-1])

    held = documents.select("doc_id", "text")
    numbers = [T.StructField(c, T.LongType()) for c in ("part", "before", "n")]
    return held.mapInArrow(read, T.StructType([held.schema["doc_id"], *numbers, T.StructField("ids", T.BinaryType())]))


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """The ids with ``end`` after each document's."""
    out = np.full(len(ids) + len(n), end, ids.dtype)
    is_id = np.ones(len(out), bool)
    is_id[np.cumsum(n + 1) - 1] = False
    out[is_id] = ids
    return out


def bases(rows: DataFrame) -> dict[int, int]:
    """Where each partition starts in the whole: one number a partition."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).astype(np.int64)
    return {r["part"]: int(s) for r, s in zip(totals, starts)}


def cut(first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents at ``first`` with ``n`` ids: document, start in it, length,
    sequence and offset in it."""
    pieces = (first + n - 1) // length - first // length + 1
    of = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sequence = (first // length)[of] + nth
    begin = np.maximum(first[of], sequence * length)
    stop = np.minimum((first + n)[of], (sequence + 1) * length)
    return of, begin - first[of], stop - begin, sequence, begin - sequence * length


def pack(documents: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and the ids themselves if asked for."""
    path = path or vocabulary()
    bounded_batches(documents.sparkSession)
    rows = written(encoded(documents, path, end), "encoded")
    starts = rows.sparkSession.sparkContext.broadcast(bases(rows.select("part", "n")))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = starts.value
        kind = "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for table in batched(iter([batch]), "ids", PIECE_BYTES):
                n = table.column("n").to_numpy()
                first = table.column("before").to_numpy() + np.array([base[p] for p in table.column("part").to_pylist()], np.int64)
                ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), kind).astype("<u4")
                of, start, size, sequence, offset = cut(first, n, length)
                at = (np.cumsum(n) - n)[of] + start
                sums = np.fromiter((crc(ids[a : a + s]) for a, s in zip(at.tolist(), size.tolist())), np.int64, len(at))
                columns = [table.column("doc_id").combine_chunks().take(pa.array(of)), *map(pa.array, (start, size, sums, n[of], sequence, offset))]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(gather(ids, at, size).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, *["ids"] * with_ids])

    schema = [rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names)]
    if with_ids:
        schema.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return rows.mapInArrow(read, T.StructType(schema))

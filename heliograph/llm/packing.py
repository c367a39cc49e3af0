"""Cost-balanced packing of tokenized documents into fixed-length training sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``: the work that grows with the tokens and the
attention inside the piece. Documents longer than a sequence first give full sequences. The rest is taken in descending
cost and goes to the sequence with the lowest cost so far among those with room for it. If none has room, the one with
the most room is filled and what is left goes on. A block of ``block_sequences`` sequences is packed at a time, within
the task that tokenized it, so that nothing is shuffled and memory is bounded; what doesn't fill a sequence is carried to
the next block. What is left at a partition's end goes to sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text has no ids but its end id, and is packed like any other; a null doc_id is kept;
repeated rows are packed each; an empty table gives no rows. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common
from .tokens import WordCodec, binary_of

#: Sequence ids of a partition begin at its number times this.
PARTITION_STRIDE = 1 << 40
#: Bytes of ids that are sent at a time, about.
ROW_BYTES = 2_000_000


def powers_of_two(n: int) -> list[int]:
    """Distinct powers of two with the sum n, descending."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def assign(pieces: list[tuple[int, int, int]], room: list[int], linear: float, quadratic: float):
    """Place pieces (document, start, length) into sequences with the given room.

    Returns placements (sequence, offset, document, start, length) and the pieces for which there was no room.
    """
    left = np.array(room, np.int64)
    size = left.copy()
    cost = np.zeros(len(room))
    out, over = [], []
    for doc, start, n in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while n:
            fits = left >= n
            if fits.any():
                k, take = int(np.argmin(np.where(fits, cost, np.inf))), n
            elif len(left) and (k := int(np.argmax(left))) >= 0 and left[k] > 0:
                take = int(left[k])
            else:
                over.append((doc, start, n))
                break
            out.append((k, int(size[k] - left[k]), doc, start, take))
            left[k] -= take
            cost[k] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return out, over


class Packer:
    """Packs the documents of one partition."""

    def __init__(self, first_id: int, length: int, block_sequences: int, linear: float, quadratic: float):
        self.next_id, self.length, self.block = first_id, length, length * block_sequences
        self.linear, self.quadratic = linear, quadratic
        self.docs: dict[int, tuple] = {}  # number -> (doc_id, ids)
        self.number, self.pieces, self.held = 0, [], 0

    def row(self, doc: int, start: int, n: int, sequence: int, offset: int) -> tuple:
        doc_id, ids = self.docs[doc]
        return doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, sequence, offset

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        n, k = len(ids) // 4, self.number
        self.docs[k] = (doc_id, ids)
        self.number += 1
        full = n // self.length
        for i in range(full):
            yield self.row(k, i * self.length, self.length, self.next_id, 0)
            self.next_id += 1
        if rest := n - full * self.length:
            self.pieces.append((k, full * self.length, rest))
            self.held += rest
        else:
            del self.docs[k]
        if self.held >= self.block:
            yield from self.flush([self.length] * (self.held // self.length))

    def flush(self, room: list[int]) -> Iterator[tuple]:
        placed, over = assign(self.pieces, room, self.linear, self.quadratic)
        for k, offset, doc, start, n in placed:
            yield self.row(doc, start, n, self.next_id + k, offset)
        self.next_id += len(room)
        self.pieces, self.held = over, sum(n for _, _, n in over)
        live = {doc for doc, _, _ in over}
        self.docs = {k: v for k, v in self.docs.items() if k in live}

    def end(self) -> Iterator[tuple]:
        yield from self.flush([self.length] * (self.held // self.length) + powers_of_two(self.held % self.length))


def pack(df: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, block_sequences: int = 256, linear: float = 1.0, quadratic: float = 1 / 24576) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The default costs are those of a transformer with a hidden size of 4096.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = common.loaded(WordCodec, tokenizer), array("I", [end_id]).tobytes()
        packer = Packer(TaskContext.get().partitionId() * PARTITION_STRIDE, length, block_sequences, linear, quadratic)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows, held = [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), binary_of(*codec.encode(batch.column("text"))).to_pylist(), strict=True):
                for row in packer.add(doc_id, ids + end):
                    rows.append(row)
                    held += len(row[3])
                    if held >= ROW_BYTES:
                        yield made(rows)
                        rows, held = [], 0
        rows += packer.end()
        if rows:
            yield made(rows)

    return common.map_arrow(common.texts(df), run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

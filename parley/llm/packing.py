"""Operator 7: bounded-space online best-fit packing.

Documents become token ids plus an end id.  Pieces stream in order through a
fixed number of open sequences, kept in a bitset keyed by free space: the
lowest set bit at or above a piece's length is the best fit.  When nothing
fits, a new sequence opens; if the limit is reached, the fullest closes first.
Documents longer than a sequence are cut into full pieces, which fill their
sequences alone; the remainder comes first and is packed like a short document.

Every task packs its own rows with bounded memory (open sequences are counters
in a bitset) and nothing is shuffled.  Sequence ids are unique: the task's
partition number and a counter in it.  A task that is run again gives the same
result, since a Parquet split is always read in the same order.

Tokens are those of the public byte-level BPE vocabulary; its file is a
parameter.  Rank file and JSON file describe one vocabulary, and the tests
hold the ids of both libraries equal; the rank file's library is used, which
is five times as fast.

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed each on its own; an empty table gives an empty
result.  Extra columns pass through ``pack(..., keep=...)`` only.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

SEQUENCE = 1024
END_ID = 2
OPEN_SEQUENCES = 1024


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


# Fixed value: the one token that the vocabulary's JSON file adds to the ranks.
ADDED = {"<|endoftext|>": 50256}


def encoder(path: str):
    """The ids of a text, as a function; added tokens in it have their own ids."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {t: i for t, i in ADDED.items() if i not in ranks.values()}
    made = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return made.encode(text, allowed_special="all")
        return made.encode_ordinary(text)
    return encode


class BestFit:
    """Online best fit with at most ``limit`` open sequences."""

    def __init__(self, capacity: int = SEQUENCE, limit: int = OPEN_SEQUENCES):
        self.capacity, self.limit = capacity, limit
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = self.open = self.made = 0

    def _take(self, free: int) -> int:
        own = self.free[free].pop()
        if not self.free[free]:
            self.mask &= ~(1 << free)
        return own

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
            self.open -= 1
        else:
            free, sequence = self.capacity, self.made
            self.made += 1
            if length < free and self.open == self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
                self.open -= 1
        left = free - length
        if left:
            self.free[left].append(sequence)
            self.mask |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


def pieces(n: int, capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE,
         limit: int = OPEN_SEQUENCES, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id,
    offset and, if asked for, the token ids."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(id_col, text_col)
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encode, bins = encoder(path), BestFit(capacity, limit)
        base = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, 1):
            source, out, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = encode(text or "")
                tokens.append(END_ID)
                data = np.array(tokens, dtype="<u4")
                for k, (start, length) in enumerate(pieces(len(data), capacity)):
                    own = data[start:start + length]
                    sequence, offset = bins.place(length)
                    source.append(i)
                    out.append((k, start, length, zlib.crc32(own.tobytes()), base + sequence, offset))
                    if with_ids:
                        ids.append(own)
            column = list(zip(*out)) or [()] * 6
            arrays = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(column[0], pa.int32())]
            arrays += [pa.array(c, pa.int64()) for c in column[1:]]
            names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids: at most ``capacity`` tokens a row."""
    from pyspark.sql import functions as F
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))

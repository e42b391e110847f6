"""Packing documents into token windows: best fit, longest piece first.

A document's ids are cut into full windows first, each a sequence of its own;
what remains is one shorter piece. Pieces go, longest first, into the open
window whose remaining room is the tightest that still holds them. A segment
tree over the amounts of room (0 to the window) finds that room in a few steps.

Tokens never leave the task that makes them: only lengths and checksums are
dealt, by a hash of the document and its row, to shards of about ``shard_docs`` documents
that are packed alone. A shard leaves at most a few windows less than full.

Cases: a null or empty text is its end id alone; null ids stay null and other ids
exact; repeated rows are packed as
often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.tables import groups_for, q
from tidelog.llm.tokens import encoder

PIECES = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in (
            "doc_id",
            "start",
            "length",
            "ids_crc32",
            "doc_tokens",
            "sequence_id",
            "offset",
            "sequence_tokens",
            "sequence_padding",
        )
    ]
)


class Rooms:
    """Open windows by their remaining room, in a segment tree."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``length``, taken out."""
        node = length + self.leaves
        if not self.count[node]:
            # up to the first right-hand neighbour that holds a window, then down
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For pieces longest first: each one's window and its offset there."""
    rooms, windows, offsets, opened = Rooms(window), [], [], 0
    for length in lengths:
        found = rooms.take(length)
        if found is None:
            room, at, opened = window, opened, opened + 1
        else:
            room, at = found
        windows.append(at)
        offsets.append(window - room)
        if room > length:
            rooms.put(room - length, at)
    return windows, offsets


def document_pieces(
    df: DataFrame, id_column: str, text_column: str, vocabulary: str, end_id: int, window: int
) -> DataFrame:
    """Per document its number of ids and the checksum of each piece."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            counts, sums = [], []
            for text in batch.column(1):
                ids = memoryview(encode(text.as_py()) + end)
                counts.append(len(ids) // 4)
                step = 4 * window
                sums.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(sums, pa.list_(pa.int64())),
                ],
                names=["doc_id", "doc_tokens", "sums"],
            )

    return df.select(
        q(id_column).cast("long").alias("doc_id"), q(text_column).cast("string").alias("text")
    ).mapInArrow(cut, "doc_id long, doc_tokens long, sums array<long>")


def pack_shard(shard: int, docs: pa.Table, window: int) -> pa.Table:
    """The pieces of one shard's documents with their places in its sequences.

    Ids stay Arrow integers: beside a null one they would become floats in pandas.
    """
    keys = [("doc_id", "ascending"), ("doc_tokens", "ascending")]
    docs = docs.combine_chunks().take(pc.sort_indices(docs, sort_keys=keys, null_placement="at_start"))
    tokens = docs.column("doc_tokens").to_numpy()
    n = -(-tokens // window)
    doc = np.repeat(np.arange(len(tokens)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * window
    length = np.minimum(tokens[doc] - start, window)
    order = np.argsort(-length, kind="stable")
    windows, offsets = best_fit(length[order].tolist(), window)
    sequence, offset = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    sequence[order], offset[order] = windows, offsets
    used = np.bincount(sequence, weights=length).astype(np.int64)
    padding = np.where(used & (used - 1) == 0, 0, window - used)
    sums = docs.column("sums").combine_chunks().flatten()
    columns = [
        docs.column("doc_id").take(pa.array(doc)).combine_chunks(),
        *(pa.array(x, pa.int64()) for x in (start, length)),
        sums,
        *(
            pa.array(x, pa.int64())
            for x in (tokens[doc], (shard << 32) + sequence, offset, used[sequence], padding[sequence])
        ),
    ]
    return pa.table(columns, names=PIECES.names)


def pack(
    df: DataFrame,
    *,
    vocabulary: str,
    end_id: int = 1,
    window: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_docs: int = 20_000,
) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence."""
    shards = groups_for(df.count(), shard_docs)
    pieces = document_pieces(df, id_column, text_column, vocabulary, end_id, window)

    def packed(key: tuple, docs: pa.Table) -> pa.Table:
        return pack_shard(key[0].as_py(), docs, window)

    # the row's number spreads rows that repeat all else
    number = F.monotonically_increasing_id()
    shard = F.pmod(F.xxhash64("doc_id", "doc_tokens", "sums", number), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(packed, PIECES)

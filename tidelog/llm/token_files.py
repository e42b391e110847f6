"""Token ids in word-aligned binary blocks.

A 64-bit word holds a 4-bit selector and as many ids of equal width as fit into
60 bits; the selector that takes most ids is used. An id of more than 60 bits is
an escape: its word holds the selector alone, its value lies behind the words.

A block holds at most ``BLOCK`` ids of consecutive documents:

    magic, ids, words, escapes, checksum of the rest (4 bytes each)
    first word of every ``RUN`` ids (4 bytes each)
    words, then escaped values (8 bytes each), all little-endian

Runs begin at a word, so their first words let a reader decode all runs of a
block at once, or any one alone. Blocks are rows of a Parquet table, which any
store can hold and whose commit survives lost executors; a row also says which
documents lie in its block. Documents are range partitioned and sorted by id, so
blocks in (part, block) order hold all ids in ascending document order.

Cases: a null or empty text is its end id alone, null ids come first, rows of
the same id are ordered by a hash of their text, an empty table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.tables import q
from tidelog.llm.token_columns import column_encoder

# Ids in a word and bits of each, by selector; 15 is an escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 0])
PACKED = 14
ESCAPE = 15
# The first id too wide for each selector; the narrowest selector of short ids.
LIMITS = np.uint64(1) << WIDTHS[:PACKED].astype(np.uint64)
NARROW = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.int8)
MAGIC = b"TL8B"
HEAD = struct.Struct("<4s4I")
RUN = 1024
BLOCK = 65_536

FILES = (
    "part int, block int, first_id long, n_ids long, first_doc long, "
    "doc_ids array<long>, lengths array<long>, begins boolean, ids binary"
)


def selectors(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the selector of a word that begins there, and its ids.

    No word goes beyond its run.
    """
    n = len(ids)
    at = np.arange(n, dtype=np.int32)
    left = np.minimum(RUN - at % RUN, n - at)
    width = np.searchsorted(LIMITS, ids, side="right") if n and ids.max() >> 16 else NARROW[ids]
    # runs one below the other, each with room behind it that any selector holds
    widest = np.zeros((-(-n // RUN), RUN + COUNTS[0]), np.int8)
    full = n // RUN
    widest[:full, :RUN] = width[: full * RUN].reshape(full, RUN)
    widest[full:, : n - full * RUN] = width[full * RUN :]
    best = np.full((len(widest), RUN), ESCAPE, np.int8)
    held = 1
    for s in range(PACKED - 1, -1, -1):
        # the widest of the next ids, from that of fewer, of which two overlap
        while held < COUNTS[s]:
            step = min(held, int(COUNTS[s]) - held)
            np.maximum(widest[:, :-step], widest[:, step:], out=widest[:, :-step])
            held += step
        best[widest[:, :RUN] <= s] = s
    best = best.reshape(-1)[:n]
    return best, np.minimum(COUNTS[best], left)


def word_starts(taken: np.ndarray) -> np.ndarray:
    """Where words begin, from the ids that a word takes at each place: all runs
    step side by side, and stay at their end."""
    n = len(taken)
    step = np.append(taken, 0).astype(np.int64)
    at = np.arange(0, n, RUN)
    ends = np.minimum(at + RUN, n)
    begins = np.zeros(n + 1, bool)
    while len(at):
        begins[at] = True
        at = at + step[at]
        if (at == ends).any():
            at, ends = at[at < ends], ends[at < ends]
    return np.flatnonzero(begins[:n])


def encode_block(ids: np.ndarray) -> bytes:
    """``ids`` (unsigned 64-bit) as one block."""
    best, taken = selectors(ids)
    n, starts = len(ids), word_starts(taken)
    chosen, held = best[starts].astype(np.int64), taken[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(chosen):
        if s < PACKED:
            rows = np.flatnonzero(chosen == s)
            at, here, word = starts[rows], held[rows], words[rows]
            for lane in range(COUNTS[s]):
                value = padded[at + lane] << np.uint64(lane * WIDTHS[s])
                value[here <= lane] = 0  # of the next run
                word |= value
            words[rows] = word
    escaped = ids[starts[chosen == ESCAPE]]
    firsts = np.searchsorted(starts, np.arange(0, n, RUN)).astype("<u4")
    body = firsts.tobytes() + words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()
    return HEAD.pack(MAGIC, n, len(words), len(escaped), zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; all its runs are decoded at once."""
    magic, n, n_words, n_escaped, check = HEAD.unpack_from(block)
    body = memoryview(block)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != check:
        raise ValueError("damaged block of token ids")
    n_runs = -(-n // RUN)
    firsts = np.frombuffer(body, "<u4", n_runs).astype(np.int64)
    words = np.frombuffer(body, "<u8", n_words, 4 * n_runs)
    escaped = np.frombuffer(body, "<u8", n_escaped, 4 * n_runs + 8 * n_words)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    before = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    stride = RUN + 60
    run = np.repeat(np.arange(n_runs), np.diff(np.append(firsts, n_words)))
    place = before - before[firsts][run] + run * stride if n else before
    out = np.zeros(n_runs * stride, np.uint64)
    for s in range(PACKED):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            lanes = np.arange(COUNTS[s])
            shift = (lanes * WIDTHS[s]).astype(np.uint64)
            mask = (np.uint64(1) << np.uint64(WIDTHS[s])) - np.uint64(1)
            out[place[rows, None] + lanes] = words[rows, None] >> shift & mask
    out[place[chosen == ESCAPE]] = escaped
    return out.reshape(n_runs, stride)[:, :RUN].ravel()[:n]


class Blocks:
    """Cuts a part's documents into blocks of at most ``BLOCK`` ids."""

    def __init__(self, part: int):
        self.part, self.block, self.first_id, self.first_doc = part, 0, 0, 0
        self._empty(True)

    def _empty(self, begins: bool) -> None:
        self.ids: list[bytes] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.room, self.begins = BLOCK, begins

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        view = memoryview(ids)
        while view:
            taken = view[: 4 * self.room]
            view = view[len(taken) :]
            self.ids.append(taken)
            self.doc_ids.append(doc_id)
            self.lengths.append(len(taken) // 4)
            self.room -= len(taken) // 4
            if not self.room:
                yield self.row(begins_next=not view)

    def row(self, begins_next: bool = True) -> tuple:
        ids = np.frombuffer(b"".join(self.ids), "<u4").astype(np.uint64)
        out = (
            self.part,
            self.block,
            self.first_id,
            len(ids),
            self.first_doc,
            self.doc_ids,
            self.lengths,
            self.begins,
            encode_block(ids),
        )
        self.first_doc += len(self.doc_ids) - (not begins_next)
        self.first_id += len(ids)
        self.block += 1
        self._empty(begins_next)
        return out


def write_token_files(
    df: DataFrame,
    path: str,
    *,
    vocabulary: str,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every text with its end id into blocks under ``path``."""
    end = end_id.to_bytes(4, "little")
    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("block", pa.int32()),
            ("first_id", pa.int64()),
            ("n_ids", pa.int64()),
            ("first_doc", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())),
            ("begins", pa.bool_()),
            ("ids", pa.binary()),
        ]
    )

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, field.type) for c, field in zip(columns, schema, strict=True)],
            schema=schema,
        )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = column_encoder(vocabulary).ids
        blocks = Blocks(TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                for row in blocks.add(doc_id, b"".join((ids, end))):
                    yield rows([row])
        if blocks.ids:
            yield rows([blocks.row()])

    docs = df.select(
        q(id_column).cast("long").alias("doc_id"), q(text_column).cast("string").alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    docs = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    docs.select("doc_id", "text").mapInArrow(encoded, FILES).write.option(
        "compression", "uncompressed"
    ).parquet(path)


def joined_crc(pieces: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Start, ids and checksum of a document from those of its pieces.

    Appending bytes changes a checksum by its own plus a linear map of the
    earlier one, which as many zero bytes show.
    """
    (start, total, crc), *more = sorted(pieces)
    for _, n, after in more:
        zeros = bytes(4 * n)
        crc = after ^ zlib.crc32(zeros, crc) ^ zlib.crc32(zeros)
        total += n
    return start, total, crc


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids_crc32 of its decoded ids."""
    files = spark.read.schema(FILES).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("ids_in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "part", F.coalesce(F.sum("ids_in_part").over(earlier), F.lit(0)).alias("part_start")
    )

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = memoryview(decode_block(row["ids"]).astype("<u4").tobytes())
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [
                    zlib.crc32(ids[4 * (e - n) : 4 * e])
                    for e, n in zip(ends.tolist(), row["lengths"], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(crcs), pa.int32()),
                        pa.array(np.arange(len(crcs)) + row["first_doc"]),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["first_id"] + ends - lengths),
                        pa.array(lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "doc", "doc_id", "start", "n", "crc"],
                )

    pieces = files.select("part", "first_id", "first_doc", "doc_ids", "lengths", "ids").mapInArrow(
        decoded, "part int, doc long, doc_id long, start long, n long, crc long"
    )
    docs = pieces.groupBy("part", "doc").agg(
        F.min("doc_id").alias("doc_id"),
        F.collect_list(F.struct("start", "n", "crc")).alias("pieces"),
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                joined_crc([(p["start"], p["n"], p["crc"]) for p in pieces])
                for pieces in batch.column(2).to_pylist()
            ]
            start, n, crc = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *(pa.array(x, pa.int64()) for x in (start, n, crc)),
                ],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return (
        docs.select("part", "doc_id", "pieces")
        .mapInArrow(whole, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
        .join(offsets, "part")
        .select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
    )

"""Token-id output: best-fit-decreasing packing into fixed-width id matrices.

Overlong documents are split losslessly into chunks of ``seq_len``; chunks
of a block are packed by best fit, longest first. The open sequences are
held by their free room in a segment tree over room values, so the tightest
sequence that takes a chunk is one descent. Blocks are bounded by a token
budget, never by a task's or a source's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import END_ID, SEQ_LEN
from .tokenizing import RANKS, VOCABULARY, encoder

#: Tokens packed together: 2048 sequences at the default width, 16 MB of ids.
BLOCK_TOKENS = 1 << 22
_OUT = pa.schema([("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])
SCHEMA = "n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, doc_starts array<bigint>"


class RoomTree:
    """Open sequences by free room 0..width; best(size) is the least room that is enough."""

    def __init__(self, width: int):
        self.leaves = 1 << (width + 1 - 1).bit_length() if width else 1
        while self.leaves < width + 1:
            self.leaves <<= 1
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, seq: int) -> None:
        self.open[room].append(seq)
        self._add(room, 1)

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()

    def best(self, size: int) -> int:
        """The least room >= size that an open sequence has, or -1."""
        at = size + self.leaves
        if self.count[at]:
            return size
        while at > 1:  # up to the first right sibling with an open sequence, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Sequences as lists of indices into sizes (each 1..width); ties keep the input's order."""
    tree, out = RoomTree(width), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.best(sizes[i])
        if room < 0:
            seq, room = len(out), width
            out.append([])
        else:
            seq = tree.take(room)
        out[seq].append(i)
        tree.put(room - sizes[i], seq)
    return out


def pack_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID, pad_id: int = 0, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """One row for each packed sequence.

    input_ids is seq_len little-endian uint32 ids, padded with pad_id at the
    end; cu_seqlens runs 0 .. n_tokens over the segments (padding is no
    segment); position_ids restart at 0 in each segment (int32, 0 in the
    padding); doc_ids and doc_starts name each segment's document and the
    number of its ids before the segment.

    A null or empty text is the end id alone; a text longer than seq_len is
    several segments, in one sequence or several. Chunks of equal size keep
    the input's order. Repeated rows and null ids are segments of their own.
    An empty table gives no rows; other columns are not read.
    """

    def run(batches):
        enc = encoder(vocabulary, ranks)
        chunks: list[tuple] = []
        held = 0

        def flush():
            cols: list[list] = [[] for _ in _OUT]
            for seq in best_fit_decreasing([len(c[2]) for c in chunks], seq_len):
                ids, pos = np.full(seq_len, pad_id, "<u4"), np.zeros(seq_len, "<i4")
                cu = [0]
                for i in seq:
                    part = chunks[i][2]
                    at = cu[-1]
                    ids[at : at + len(part)] = part
                    pos[at : at + len(part)] = np.arange(len(part))
                    cu.append(at + len(part))
                for c, v in zip(cols, (cu[-1], len(seq), ids.tobytes(), cu, pos.tobytes(), [chunks[i][0] for i in seq], [chunks[i][1] for i in seq]), strict=True):
                    c.append(v)
                if len(cols[0]) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
                    cols = [[] for _ in _OUT]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.array(text.as_py(), end_id)
                for start in range(0, len(ids), seq_len):
                    part = ids[start : start + seq_len]
                    chunks.append((doc, start, part))
                    held += len(part)
                    if held >= block_tokens:
                        yield from flush()
                        chunks, held = [], 0
        if chunks:
            yield from flush()

    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
    return rows.withColumn("sequence_id", F.monotonically_increasing_id())


def write_matrix(packed: DataFrame, path: str) -> None:
    """Parquet of id matrices, segment bounds and positions."""
    packed.write.option("compression", "zstd").parquet(path)


def op6_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed matrices themselves, with a checksum of ids and positions."""
    p = pack_matrix(common.table(spark, sf_dir, "documents"))
    return p.select("sequence_id", "n_tokens", "n_segments", "cu_seqlens", "doc_ids", "doc_starts", "input_ids", "position_ids", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


QUERIES = {"op6_token_matrix": op6_token_matrix}
ORACLE: dict[str, str] = {}

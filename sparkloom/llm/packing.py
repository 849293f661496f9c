"""Packing by power-of-two decomposition.

Each document's ids (with an end id) are cut into pieces whose lengths are
powers of two: full pieces of ``seq_len`` first, then the binary digits of
the rest from the largest to 1. A piece is a sequence of its own, and
sequences of one length form a bucket, so batches are drawn from one bucket,
no sequence crosses documents and nothing is padded.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenizing import RANKS, VOCABULARY, encoder

SEQ_LEN = 2048
END_ID = 1
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])


def cuts(n: int, seq_len: int = SEQ_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; lengths are powers of two up to seq_len."""
    out, at = [], 0
    while n - at >= seq_len:
        out.append((at, seq_len))
        at += seq_len
    bit = seq_len >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def decompose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """The pieces of each document, one row each; a narrow stage without a shuffle.

    Returns doc_id, start, length, bucket (log2 of length), ids (unsigned
    little-endian 32-bit), doc_tokens, sequence_id, offset (always 0: a
    piece fills its sequence).

    A null or empty text is the end id alone: one piece of length 1; a long
    text has as many full pieces as it fills. Repeated
    rows and null ids give pieces of their own (sequence_id tells them
    apart). An empty table gives no rows. Other columns are not read.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")

    def run(batches):
        enc = encoder(vocabulary, ranks)
        for batch in batches:
            cols: list[list] = [[] for _ in _OUT]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.array(text.as_py(), end_id)
                raw, n = ids.tobytes(), len(ids)
                for start, length in cuts(n, seq_len):
                    for c, v in zip(cols, (doc, start, length, length.bit_length() - 1, raw[4 * start : 4 * (start + length)], n), strict=True):
                        c.append(v)
                held += len(raw)
                if held > common.SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
                    cols, held = [[] for _ in _OUT], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    common.bounded_batches(docs.sparkSession)
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One Parquet folder for each length; a trainer reads whole batches from one bucket."""
    pieces.write.partitionBy("bucket").parquet(path)


def op2_pack_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = decompose(common.table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


QUERIES = {"op2_pack_pow2": op2_pack_pow2}
ORACLE: dict[str, str] = {}

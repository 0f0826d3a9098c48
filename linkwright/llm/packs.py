"""Blocks of documents as compressed rows: what has to meet its words' answers again is shuffled at a third of its size."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = "block bigint, ids array<bigint>, sizes array<int>, texts binary"
_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]


def _made(block: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    row = [[block], [ids], [list(map(len, texts))], [zstandard.ZstdCompressor(3).compress(b"".join(texts))]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _TYPES)], names=["block", "ids", "sizes", "texts"])


def packed(docs: DataFrame, per_block: int, parts: int) -> DataFrame:
    """One row for each block of about per_block bytes of text (more only for a longer text), dealt over parts tasks.

    A block is numbered by its task and its place there, which a task that runs again repeats. Null texts count as empty.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        task = TaskContext.get()
        block, ids, texts, size = (task.partitionId() if task else 0) << 32, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode()
                if ids and size + len(raw) > per_block:
                    yield _made(block, ids, texts)
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield _made(block, ids, texts)

    return own.mapInArrow(run, SHAPE).repartition(parts, "block")


def unpacked(row: dict) -> tuple[list, list[bytes]]:
    """Ids and texts (UTF-8) of a block."""
    raw, out, at = zstandard.ZstdDecompressor().decompress(row["texts"]), [], 0
    for n in row["sizes"]:
        out.append(raw[at : at + n])
        at += n
    return row["ids"], out

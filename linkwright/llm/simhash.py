"""SimHash near-duplicates: fingerprints linked through a grid of segment popcounts.

A 64-bit fingerprint is embedded as its 16 segment bit counts (segments of four bits). Two fingerprints at Hamming
distance d lie at Manhattan distance d or less there, so the Manhattan distance is a lower bound and the range join with
radius 2 over that integer grid loses no pair. The join meets half way: each fingerprint goes to the cells within one
step, and two fingerprints within two steps share such a cell. Exact verification inside a shared cell meets half way
too: fingerprints differ in two bits or fewer exactly if they share a word within one flipped bit of both, and that word
lies in a shared cell. Grouping by that word yields links to the group's smallest member; no group enumerates its pairs,
so the work is linear in the number of distinct fingerprints whatever the size of a group of copies.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.staging import staged
from ._shared import components, fresh, table

SHINGLE, SEED = 3, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text; 0 without words. A bit is set if over half the shingle hashes have it."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    h = np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(SEED))), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        ones += np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for b in batches:
        fps = [fingerprint(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; null and empty texts have fingerprint 0."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def popcounts(x: Column) -> Column:
    """The 16 four-bit segments' bit counts, one in each hexadecimal digit of the result."""
    even, odd = x.bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x5555555555555555))
    pairs = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))  # a sum whose carry can't overflow
    return pairs.bitwiseAND(F.lit(0x3333333333333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x3333333333333333))


def _cells() -> Column:
    """The cells within one step of a fingerprint's own (column c), each with the step that leads there: 0, or 2 s + 1 where
    segment s gains a bit, or 2 s + 2 where it loses one."""
    one = [F.lit(1 << (4 * s)).cast("bigint") for s in range(16)]
    digit = [F.shiftrightunsigned("c", 4 * s).bitwiseAND(F.lit(15)) for s in range(16)]
    at = lambda cell, step: F.struct(cell.alias("cell"), F.lit(step).alias("step"))
    steps = [at(F.col("c"), 0)]
    for s in range(16):
        steps += [F.when(digit[s] < 4, at(F.col("c") + one[s], 2 * s + 1)), F.when(digit[s] > 0, at(F.col("c") - one[s], 2 * s + 2))]
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def links(fps: DataFrame) -> DataFrame:
    """Edges (src, dst) among the distinct values of fps(fp) that connect all pairs at distance 2 or less.

    A fingerprint goes to the cells within one step. In a cell that another one reaches too, it shows the words within one
    flipped bit of itself that lie in that cell: itself in its own, one for each flip of a segment's bit in a neighbour.
    """
    distinct = fps.select("fp").distinct().withColumn("c", popcounts(F.col("fp")))
    placed = distinct.select("fp", F.inline(_cells()))
    shared = placed.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("cell")
    close = placed.join(shared, "cell", "left_semi")
    lost = F.expr("step % 2 = 0")  # a segment that loses a bit flips one that is set
    bits = F.expr("transform(array(0, 1, 2, 3), b -> 4 * div(step - 1, 2) + b)".replace("div(step - 1, 2)", "cast((step - 1) div 2 as int)"))
    flips = F.transform(F.filter(bits, lambda b: F.call_function("shiftrightunsigned", F.col("fp"), b).bitwiseAND(F.lit(1)) == lost.cast("int")),
                        lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))
    middle = close.select("fp", F.explode(F.when(F.col("step") == 0, F.array("fp")).otherwise(flips)).alias("mid"))
    lowest = middle.groupBy("mid").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("mid", "lo")
    return middle.join(lowest, "mid").where("fp <> lo").select(F.col("fp").alias("src"), F.col("lo").alias("dst")).distinct()


def _rooted(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) for each row, and (fp, least, root): the smallest doc_id of a fingerprint and its component's root."""
    fps = staged(with_fingerprints(docs, doc_id, text), "simhash-fp")
    edges = staged(links(fps), "simhash-links")  # components reads them more than once
    roots = components(edges, "simhash-cc")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return fps, root


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    Null and empty texts have fingerprint zero and link like any other. A null doc_id keeps its row; the component's id
    is the smallest that is not null, null if there is none. Repeated rows stay. Other columns are not read.
    """
    fps, root = _rooted(docs, doc_id, text)
    ids = root.join(root.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("fp").alias("f"), "component_id")
    return fps.join(ids, fps.fp == ids.f).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with the smallest doc_id (null last), then fingerprint, then
    text hash and text. Columns stay as they are.

    Rows that share a doc_id, or have none, are told apart by their fingerprints and stay where their components differ. Null,
    empty and wordless texts are one component (and those near the zero fingerprint). Repeated rows are copies. An empty table
    gives an empty one; extra columns may have any name.
    """
    fps, root = _rooted(docs, "doc_id", "text")
    names, schema = docs.columns, docs.schema
    fp_, id_, none, place = fresh(names, "fp_", "id_", "none_", "place_")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), fps.fp.alias("fp")))
    kept = fps.join(root.select(F.col("fp").alias("f"), "root"), F.col("fp") == F.col("f")).groupBy("root").agg(first.alias("k")).select(
        F.coalesce("k.id", F.lit(0)).alias(id_), F.col("k.no_id").alias(none), F.col("k.fp").alias(fp_))

    def run(batches):
        for b in batches:
            fp = pa.array([fingerprint(t) for t in b.column(names.index("text")).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fp], names=[*names, fp_])

    own = docs.mapInArrow(run, StructType([*schema.fields, StructField(fp_, LongType())]))
    own = own.withColumn(id_, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).withColumn(none, F.col("doc_id").isNull())
    left = own.join(kept, [id_, none, fp_], "left_semi")
    rank = F.row_number().over(Window.partitionBy(id_, none, fp_).orderBy(F.xxhash64("text"), "text"))
    return left.withColumn(place, rank).where(F.col(place) == 1).select(*names)

"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document is a weighted set: its words and how often each occurs. Sample j of term k has r and c from Gamma(2, 1) and b
uniform, all drawn by hashing (k, j): the hash's bits choose among equally likely cells of the distribution. With weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the term of
the least a, with its t, is the document's sample j. Two documents agree on a sample with a probability equal to the
generalised Jaccard similarity of their weights, so the share of equal samples estimates it.

The texts are dealt by document once. Splitting, counting and sampling then stay in the partition that holds the document:
its terms are counted and its samples' least values taken without another shuffle.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from ._shared import blocks_for, table, text_bytes

SAMPLES = 64
_PART = 8 << 20
_SPACES = "\t\n\x0b\x0c\r"


def _quantile(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), by halving."""
    lo, hi = np.zeros(len(u)), np.full(len(u), 60.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        less = -np.expm1(-mid) - mid * np.exp(-mid) < u
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return (lo + hi) / 2


_R, _CELLS = 4096, 65536  # entries of the tables below


@cache
def _tables() -> tuple[list[float], list[float], list[float]]:
    """r, ln c and, for the lowest cell of c, ln c again, each at the middle of equally likely cells."""
    middle = lambda n: (np.arange(n) + 0.5) / n
    # below the first cell Gamma(2, 1) has the distribution function c^2 / 2
    return _quantile(middle(_R)).tolist(), np.log(_quantile(middle(_CELLS))).tolist(), (0.5 * np.log(2 * middle(_CELLS) / _CELLS)).tolist()


def draws(h: str) -> dict[str, str]:
    """r, ln c and b from the 64 bits of h, as SQL over the tables' columns: 12 bits, 16 (and 16 for the lowest cell), 20."""
    cell = f"cast(shiftrightunsigned({h}, 12) & 65535L as int)"
    return {"r": f"gamma_r[cast({h} & 4095L as int)]", "c": f"if({cell} = 0, gamma_low[cast(shiftrightunsigned({h}, 28) & 65535L as int)], gamma_c[{cell}])",
            "b": f"((shiftrightunsigned({h}, 44) + 0.5D) * {2.0**-20!r}D)"}


_LOW = 65535  # a sample's value is told by 16 bits: unequal ones agree by chance once in 65536
_EACH = 16  # samples of one aggregation: more make functions that are too long to be compiled


def _least(h: str, ln_w: str) -> str:
    """The sample's value for one term: the high bits order by a, the low 32 tell term and t."""
    d = draws(h)
    t = f"floor({ln_w} / {d['r']} + {d['b']})"
    a = f"({d['c']} - {d['r']} * ({t} - {d['b']} + 1D))"
    return f"min(shiftleft(cast(({a} + 200D) * 4194304D as bigint), 32) | (xxhash64(term, {t}) & 4294967295L))"


def signatures(terms: DataFrame, keys: list[str], weights: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """Per group of keys, for each output column its samples: binary, two bytes a sample, empty without terms.

    terms has the keys, term (bigint) and the weight columns; a term of weight 0 takes no part in that column. samples is a
    multiple of 16. The tables of draws are a broadcast row of 1.1 MB whatever the input. If terms are dealt by one of the
    keys, nothing is shuffled.
    """
    known = terms.sparkSession.createDataFrame([(1, *_tables())], "one int, gamma_r array<double>, gamma_c array<double>, gamma_low array<double>")
    sets = range(samples // _EACH)
    logs = terms.select(*keys, "term", F.lit(1).alias("one"), *(F.when(F.col(w) > 0, F.ln(F.col(w).cast("double"))).alias(f"ln_{w}") for w in weights.values()))
    each = logs.join(F.broadcast(known), "one").withColumn("part", F.explode(F.array(*map(F.lit, sets))))
    least = [F.expr(_least(f"xxhash64(term, part, {j})", f"ln_{w}")).alias(f"{out}_{j}") for j in range(_EACH) for out, w in weights.items()]
    found = each.groupBy(*keys, "part").agg(*least)
    code = lambda c: F.lpad(F.lower(F.hex(F.col(c).bitwiseAND(F.lit(_LOW)))), 4, "0")
    some = found.select(*keys, "part", *(F.concat(*(code(f"{out}_{j}") for j in range(_EACH))).alias(out) for out in weights))
    whole = some.groupBy(*keys).agg(*(F.max(F.when(F.col("part") == k, F.col(out))).alias(f"{out}_{k}") for k in sets for out in weights))
    return whole.select(*keys, *(F.unhex(F.coalesce(F.concat(*(F.col(f"{out}_{k}") for k in sets)), F.lit(""))).alias(out) for out in weights))


def likeness(a: str, b: str, samples: int = SAMPLES):
    """Share of equal samples; 1 if neither side has terms, 0 if one has none."""
    same = sum((F.substring(a, 2 * j + 1, 2) == F.substring(b, 2 * j + 1, 2)).cast("int") for j in range(samples)) / F.lit(float(samples))
    return F.when((F.octet_length(a) == 0) & (F.octet_length(b) == 0), F.lit(1.0)).when((F.octet_length(a) == 0) | (F.octet_length(b) == 0), F.lit(0.0)).otherwise(same)


def following(ids: DataFrame) -> DataFrame:
    """(k, nk): each distinct k and the next one, after the last the first. Ranges are ordered apart, then linked."""
    n = blocks_for(ids.count(), 200_000)
    placed = staged(ids.select("k").distinct().repartitionByRange(max(8, n), "k").withColumn("part", F.spark_partition_id()), "cws-ids")
    own = placed.withColumn("nk", F.lead("k").over(Window.partitionBy("part").orderBy("k")))
    firsts = placed.groupBy("part").agg(F.min("k").alias("least"))
    order = Window.orderBy("part")  # one row for each range
    linked = firsts.select("part", F.coalesce(F.lead("least").over(order), F.first("least").over(order)).alias("then"))
    return own.join(F.broadcast(linked), "part").select("k", F.coalesce("nk", "then").alias("nk"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (rounded down) replaced by as many first code points of the next document, or all
    it has. Null counts as empty; a null doc_id sorts first. Of rows that repeat a doc_id the one whose text hashes lowest
    is what the one before meets. A text without words has an empty fingerprint, and likeness 1 to another such, else 0.
    A single row is its own next. An empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("k"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = blocks_for(text_bytes(own), _PART)
    # nothing but key and text goes through the exchange, so all its readers share it
    dealt = own.select("k", "text").repartition(parts, "k").withColumns({"th": F.xxhash64("text"), "n": F.length("text").cast("bigint")})
    by = Window.partitionBy("k").orderBy("th")
    single = dealt.withColumns({"nth": F.row_number().over(by), "before": F.lag("th").over(by)}).where("before is null or before <> th").drop("before")
    then = following(own)
    need = own.select("k", F.xxhash64("text").alias("th"), F.floor(F.length("text") / 4).cast("int").alias("m")).distinct().join(then, "k").select(F.col("k").alias("to"), F.col("th").alias("to_th"), "m", "nk")
    lent = single.where("nth = 1").join(need, F.col("k") == F.col("nk")).select("to", "to_th", F.expr("left(text, m)").alias("lent"))
    both = single.join(lent, (F.col("k") == F.col("to")) & (F.col("th").bitwiseXOR(F.col("to_th")) == 0)).select("k", "th", "n", "nth", "text", "lent")
    cut = both.withColumn("kept", F.expr("left(text, cast(n - floor(n / 4) as int))")).withColumn("tail", F.expr("substring(text, cast(n - floor(n / 4) + 1 as int))"))
    plain = lambda c: F.translate(c, _SPACES, " " * len(_SPACES))
    split = cut.select("k", "th", plain("kept").alias("kept"), plain("tail").alias("tail"), plain("lent").alias("lent")).withColumn("last", F.substring_index("kept", " ", -1))
    piece = lambda s, a, b: F.struct(s.alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    pieces = split.select("k", "th", F.explode(F.array(
        piece(F.expr("left(kept, length(kept) - length(last))"), 1, 1), piece(F.concat("last", "tail"), 1, 0), piece(F.concat("last", "lent"), 0, 1))).alias("p"))
    words = pieces.select("k", "th", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.explode(F.split("p.s", " ")).alias("w")).where("w <> ''")
    terms = words.select("k", "th", F.xxhash64("w").alias("term"), "a", "b").groupBy("k", "th", "term").agg(F.sum("a").alias("wa"), F.sum("b").alias("wb"))
    sig = signatures(terms, ["k", "th"], {"sa": "wa", "sb": "wb"}, samples)
    facts = cut.select("k", "th", "n", "nth", F.unhex(F.sha2(F.concat("kept", "lent"), 256)).alias("edited_sha256"))
    known = staged(facts.join(sig.select(F.col("k").alias("sk"), F.col("th").alias("sth"), "sa", "sb"), (F.col("k") == F.col("sk")) & (F.col("th") == F.col("sth")), "left").drop("sk", "sth").withColumns({c: F.coalesce(c, F.unhex(F.lit(""))) for c in ("sa", "sb")}), "cws-known")
    after = known.where("nth = 1").select(F.col("k").alias("nk"), F.col("sa").alias("sn"))
    text = lambda c: F.lower(F.hex(c))
    full = known.join(then, "k").join(after, "nk").select(
        F.col("k").alias("fk"), F.col("th").alias("fth"), F.col("n").alias("n_chars"), text("edited_sha256").alias("edited_sha256"), text("sa").alias("fingerprint"), text("sb").alias("edited_fingerprint"),
        likeness("sa", "sb", samples).alias("near_edited"), likeness("sa", "sn", samples).alias("near_next"))
    rows = own.select("k", "unnamed", F.xxhash64("text").alias("th"))
    return rows.join(full, (F.col("k") == F.col("fk")) & (F.col("th") == F.col("fth"))).select(
        F.when(~F.col("unnamed"), F.col("k")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

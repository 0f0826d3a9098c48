"""Two models over one pool: the pruned union, features as each model saw them, and the votes of models kept from before."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decide, features, models

# The passes that the earlier models knew, and the columns that the later one goes without.
EARLIER_PASSES = ["comb", "addr", "name_ch", "rev", "nameaddr", "rev_na", "k_name_num", "k_name"]
LEFT_OUT = ["cvc_name", "cvc_addr", "g_same_addr", "g_same_name", "n_freq_q", "n_freq_c", "g_size", "s0_q_n", "s0_p_n", "s0_q_sum",
            "in_first", "in_second", "forced"]
LEFT_OUT_STAGE2 = ["p1_q_n", "p1_p_n", "p1_q_sum"]
FALSE_WEIGHT = 2.0

_EARLIER = "L_"


def earlier_view(df: DataFrame) -> DataFrame:
    """The earlier pool as its models saw it: their own scores and competition columns under the plain names, and n_passes
    as the number of passes they knew that scored the pair above 0."""
    own = df.where("in_second = 1")
    plain = {c: c[len(_EARLIER):] for c in own.columns if c.startswith(_EARLIER)}
    own = own.drop(*plain.values()).withColumnsRenamed(plain)
    known = [F.coalesce((F.col(f"{n}_score") > 0).cast("int"), F.lit(0)) for n in EARLIER_PASSES if f"{n}_score" in own.columns]
    return own.withColumn("n_passes", sum(known, F.lit(0)))


def union_features(pool: DataFrame, records: DataFrame) -> DataFrame:
    """Features of a pruned union (qi, pi, s0, L_s0, in_first, in_second, ...): pair features once, competition of s0 over all
    of it, competition of the earlier score and the group features over the earlier pool alone (null elsewhere)."""
    earlier = decide.group_stats(pool.where("in_second = 1").select("qi", "pi", F.col("L_s0").alias("s0")), "s0", "s0").drop("s0")
    earlier = earlier.withColumnsRenamed({c: _EARLIER + c for c in earlier.columns if c.startswith("s0_")})
    d = features.pair_features(features.pair_view(decide.group_stats(pool, "s0", "s0"), records))
    d = features.corpus_features(d, records).join(earlier, ["qi", "pi"], "left")
    group = features.group_features(d.where("in_second = 1"), "L_s0").select("qi", "pi", "cvc_name", "cvc_addr", "g_same_addr", "g_same_name")
    return d.join(group, ["qi", "pi"], "left")


def inputs(df: DataFrame, stage2: bool = False) -> list[str]:
    """The later model's input columns: every number but the keys, the label, what it goes without and the earlier model's."""
    number = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    out = set(LEFT_OUT) | (set(LEFT_OUT_STAGE2) if stage2 else set()) | {"qi", "pi", "label", "fold"}
    return [c for c in df.columns if c in number and c not in out and not c.startswith(_EARLIER)]


def weighted(df: DataFrame) -> DataFrame:
    """Adds weight: a false pair counts FALSE_WEIGHT times as much as a true one."""
    return df.withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(FALSE_WEIGHT))


def score_earlier(df: DataFrame, stage1: list[Model], columns: list[str], stage2: list[Model] | None = None, columns2: list[str] | None = None) -> DataFrame:
    """(qi, pi, p) of the earlier pool by kept models; with a second stage, competition of the first one's scores goes in."""
    own = models.fold_mean(earlier_view(df), columns, "stage1", stage1)
    if not stage2:
        return own.select("qi", "pi", F.col("stage1").alias("p"))
    return models.fold_mean(decide.group_stats(own, "stage1", "p1"), columns2, "p", stage2).select("qi", "pi", "p")


def earlier_votes(scores: DataFrame, rule: dict) -> DataFrame:
    """The pairs that a kept decision rule takes; a pair outside the earlier pool is no vote."""
    return decide.by_rule(scores, "p", rule).select("qi", "pi")

"""Decisions over scored pairs (qi, pi, score): ranks, owners, subsets, votes, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _best(by: str, col: str, tie: str):
    return Window.partitionBy(by).orderBy(F.desc(col), tie)


def prune(df: DataFrame, col: str, top: int = 20) -> DataFrame:
    """The top pairs of each query; Catalyst limits each group before the shuffle."""
    return df.withColumn("rn", F.row_number().over(_best("qi", col, "pi"))).where(F.col("rn") <= top)


def with_forced(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Candidates and those extra pairs that aren't among them, told apart by forced; what an extra pair lacks is null."""
    more = extra.select("qi", "pi").distinct().join(df.select("qi", "pi"), ["qi", "pi"], "left_anti")
    return df.withColumn("forced", F.lit(0)).unionByName(more.withColumn("forced", F.lit(1)), allowMissingColumns=True)


def union_pool(df: DataFrame, first: str, second: str, top: int = 20) -> DataFrame:
    """Pairs among a query's top by either score, forced ones always; both ranks share one partitioning by query."""
    rank = lambda c: F.row_number().over(_best("qi", c, "pi"))
    d = df.withColumns({"in_first": (rank(first) <= top).cast("int"), "in_second": ((rank(second) <= top) | (F.col("forced") == 1)).cast("int")})
    return d.where("in_first = 1 or in_second = 1")


def candidate_source(df: DataFrame, col: str) -> DataFrame:
    """What each pool alone and both together bring: pairs, share of true ones, score quantiles and share of unsure scores.

    Quantiles are of scores rounded to six places, so the values that a group counts are bounded.
    """
    source = F.when((F.col("in_first") == 1) & (F.col("in_second") == 0), "first only").when((F.col("in_first") == 0) & (F.col("in_second") == 1), "second only").otherwise("both")
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY round({col}, 6))")
    unsure = ((F.col(col) > 0.1) & (F.col(col) < 0.9)).cast("double")
    return df.groupBy(source.alias("src")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("pos_rate"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.round(F.avg(unsure), 6).alias("uncertain"))


def group_stats(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Competition of each pair within its query and its pool record: two window specifications, two shuffles.

    Gaps are the pair's own score less the group's best and less its second best (null in a group of one).
    """
    for side, other in (("q", "pi"), ("p", "qi")):
        key = f"{side}i"
        whole, ranked = Window.partitionBy(key), _best(key, col, other)
        second = F.nth_value(col, 2).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        df = df.withColumns({
            f"{prefix}_{side}_rank": F.row_number().over(ranked), f"{prefix}_{side}_gap_max": F.col(col) - F.max(col).over(whole),
            f"{prefix}_{side}_n": F.count("*").over(whole), f"{prefix}_{side}_gap_2nd": F.col(col) - second})
        if side == "q":
            df = df.withColumn(f"{prefix}_q_sum", F.sum(col).over(whole))
    return df


def exclusive(df: DataFrame, col: str) -> DataFrame:
    """Each pool record stays with the query that scores it highest; ties go to the smaller query."""
    return df.withColumn("rn", F.row_number().over(_best("pi", col, "qi"))).where("rn = 1").drop("rn")


def threshold(df: DataFrame, col: str, t: float, rel: float = 0.0) -> DataFrame:
    return df.withColumn("top", F.max(col).over(Window.partitionBy("qi"))).where((F.col(col) >= t) & (F.col(col) >= rel * F.col("top"))).drop("top")


def _chances(df: DataFrame, col: str) -> DataFrame:
    """Adds k (place by probability), hits and all (sums of probabilities up to k and overall), none (chance of no match).

    All windows share the partitioning by query: one shuffle. A certain pair makes the chance of no match 0.
    """
    order, whole, p = Window.partitionBy("qi").orderBy(F.desc(col), "pi"), Window.partitionBy("qi"), F.col(col)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    none = F.when(F.max(p).over(whole) >= 1, 0.0).otherwise(F.exp(F.sum(F.when(p < 1, F.ln(1 - p))).over(whole)))
    return df.withColumns({"k": F.row_number().over(order), "hits": F.sum(p).over(upto), "all": F.sum(p).over(whole), "none": none})


def expected_f(df: DataFrame, col: str, miss: float = 0.0, empty_bias: float = 1.0, least: float = 0.01) -> DataFrame:
    """Of each query the first k pairs that maximise the expected F0.5, unless answering nothing is likelier to be right."""
    whole = Window.partitionBy("qi")
    e = _chances(df.where(F.col(col) > least), col)
    e = e.withColumn("ef", F.round(1.25 * F.col("hits") / (F.col("k") + 0.25 * (F.col("all") + miss)), 12))
    e = e.withColumn("best", F.max("ef").over(whole))
    e = e.withColumn("kstar", F.min(F.when(F.col("ef") == F.col("best"), F.col("k"))).over(whole))
    return e.where((F.col("k") <= F.col("kstar")) & (F.col("best") > empty_bias * F.col("none"))).select(*df.columns)


def f05(tp: Column, found: Column, true: Column) -> Column:
    """F0.5 of one query; without true matches 1 for an empty answer and 0 for any other."""
    return F.when(true == 0, (found == 0).cast("double")).when((found == 0) | (tp == 0), 0.0).otherwise(1.25 * tp / (found + 0.25 * true))


def per_query(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, np and ntrue of every query in truth(qi, ntrue); pred has qi and label."""
    found = pred.groupBy("qi").agg(F.sum("label").alias("tp"), F.count("*").alias("np"))
    return truth.join(found, "qi", "left").na.fill(0, ["tp", "np"])


def macro_f05(pred: DataFrame, truth: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row: mean F0.5 over all queries, pair precision and recall, accuracy on queries without matches, FP and FN; with
    candidates(qi, label) also how many true pairs they hold and how many there are for a query (mean, p95, most)."""
    q, extra = per_query(pred, truth), []
    if candidates is not None:
        each = candidates.groupBy("qi").agg(F.sum("label").alias("hit"), F.count("*").alias("cands"))
        q = q.join(each, "qi", "left").na.fill(0, ["hit", "cands"])
        # a buffer of counts for each query's number of candidates, which the passes' caps bound
        extra = [F.round(F.try_divide(F.sum("hit").cast("double"), F.sum("ntrue").cast("double")), 6).alias("blocking_recall"),
                 F.round(F.avg("cands"), 6).alias("avg_cands"), F.round(F.expr("percentile(cands, 0.95)"), 6).alias("p95_cands"),
                 F.max("cands").alias("max_cands")]
    lone = F.col("ntrue") == 0
    return q.agg(
        F.round(F.avg(f05(F.col("tp"), F.col("np"), F.col("ntrue"))), 6).alias("macro_f05"),
        F.round(F.try_divide(F.sum("tp").cast("double"), F.sum("np").cast("double")), 6).alias("pair_precision"),
        F.round(F.try_divide(F.sum("tp").cast("double"), F.sum("ntrue").cast("double")), 6).alias("pair_recall"),
        F.round(F.avg(F.when(lone, (F.col("np") == 0).cast("double"))), 6).alias("singleton_acc"),
        F.sum(F.col("np") - F.col("tp")).cast("bigint").alias("fp"),
        F.sum(F.col("ntrue") - F.col("tp")).cast("bigint").alias("fn"), F.count("*").alias("n_q"), *extra)


# What the search of a decision rule tries.
SWEEP_T = tuple(round(0.05 * k, 2) for k in range(1, 20))
SWEEP_REL = (0.0, 0.3, 0.5, 0.7)
SWEEP_MISS, SWEEP_BIAS = (0.0, 0.2, 0.5), (0.6, 0.8, 1.0, 1.2)


def _of_configs(kept: DataFrame, configs: DataFrame, truth: DataFrame) -> DataFrame:
    """configs(cfg, ...) with the macro F0.5 of the pairs (cfg, qi, label) that each of them keeps."""
    q = kept.groupBy("cfg", "qi").agg(F.sum("label").alias("tp"), F.count("*").alias("np")).join(truth, "qi")
    lone = F.col("ntrue") == 0
    sums = q.groupBy("cfg").agg(F.sum(f05(F.col("tp"), F.col("np"), F.col("ntrue"))).alias("s"), F.sum(lone.cast("int")).alias("answered"))
    # a query without an answer scores 1 if it has no match; these are counted once, not once for each configuration
    whole = truth.agg(F.count("*").alias("n"), F.sum(lone.cast("int")).alias("empty"))
    joined = configs.join(F.broadcast(sums), "cfg", "left").na.fill(0, ["s", "answered"]).crossJoin(F.broadcast(whole))
    return joined.withColumn("macro_f05", F.round((F.col("s") + F.col("empty") - F.col("answered")) / F.col("n"), 6)).drop("s", "answered", "n", "empty")


def sweep(df: DataFrame, truth: DataFrame, col: str) -> DataFrame:
    """Every decision rule tried, in order (cfg), with its macro F0.5; best is 1 for the first of those that score most.

    First 19 thresholds with and without exclusive owners; then, on the better of the two bases, steps of 0.01 round the best
    threshold with a share of the query's top score, and the expected-F rules. Each phase is one job over a grid; only the
    best configuration of the first phase, one row, comes to the driver.
    """
    spark, p = df.sparkSession, F.col(col)
    shape = "cfg int, rule string, excl int, t double, rel double, miss double, bias double"
    base = df.withColumn("excl", F.lit(0)).unionByName(exclusive(df, col).withColumn("excl", F.lit(1))).select("qi", "pi", "label", "excl", col)
    first = spark.createDataFrame([(i, "threshold", e, t, 0.0, None, None) for i, (e, t) in enumerate((e, t) for e in (0, 1) for t in SWEEP_T)], shape)
    kept = base.join(F.broadcast(first.select("cfg", "excl", "t")), "excl").where(p >= F.col("t")).select("cfg", "qi", "label")
    done = _of_configs(kept, first, truth)
    best = done.orderBy(F.desc("macro_f05"), "cfg").first()
    n = len(SWEEP_T) * 2
    finer = [(best.t + k / 100, rel) for k in range(-5, 6) for rel in SWEEP_REL]
    grid = [(n + i, "threshold", best.excl, round(t, 2), rel, None, None) for i, (t, rel) in enumerate(finer)]
    n += len(grid)
    expected = [(n + i, "expected_f", best.excl, None, None, m, b) for i, (m, b) in enumerate((m, b) for m in SWEEP_MISS for b in SWEEP_BIAS)]
    second = spark.createDataFrame(grid + expected, shape)
    own = base.where(F.col("excl") == best.excl)
    top = own.withColumn("top", F.max(p).over(Window.partitionBy("qi")))
    near = top.join(F.broadcast(second.where("rule = 'threshold'").select("cfg", "t", "rel")), (p >= F.col("t")) & (p >= F.col("rel") * F.col("top")))
    # the three guesses of missed matches share one partitioning by query
    e = _chances(own.where(p > 0.01), col)
    whole = Window.partitionBy("qi")
    for i, m in enumerate(SWEEP_MISS):
        e = e.withColumn(f"ef{i}", F.round(1.25 * F.col("hits") / (F.col("k") + 0.25 * (F.col("all") + m)), 12)).withColumn(f"best{i}", F.max(f"ef{i}").over(whole))
        e = e.withColumn(f"kstar{i}", F.min(F.when(F.col(f"ef{i}") == F.col(f"best{i}"), F.col("k"))).over(whole))
    keeps = [F.when((F.col("k") <= F.col(f"kstar{SWEEP_MISS.index(m)}")) & (F.col(f"best{SWEEP_MISS.index(m)}") > b * F.col("none")), F.lit(c))
             for c, _, _, _, _, m, b in expected]
    chosen = e.select("qi", "label", F.explode(F.array_compact(F.array(*keeps))).alias("cfg")).select("cfg", "qi", "label")
    every = done.unionByName(_of_configs(near.select("cfg", "qi", "label").unionByName(chosen), second, truth))
    return every.withColumn("best", (F.row_number().over(Window.orderBy(F.desc("macro_f05"), "cfg")) == 1).cast("int"))  # 94 rows


def rule_grid(df: DataFrame, truth: DataFrame, col: str, thresholds: list[float]) -> DataFrame:
    """Macro F0.5 of each threshold, with and without exclusive owners, in one pass: pairs meet the grid, not a loop of jobs."""
    both = df.withColumn("excl", F.lit(0)).unionByName(exclusive(df, col).withColumn("excl", F.lit(1)))
    grid = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("t")
    kept = both.select("qi", "excl", "label", col, grid).where(F.col(col) >= F.col("t"))
    q = kept.groupBy("excl", "t", "qi").agg(F.sum("label").alias("tp"), F.count("*").alias("np")).join(truth, "qi")
    # queries without an answer score 1 if they have no match; counted once, not once for each rule
    empty = truth.where("ntrue = 0").agg(F.count("*").alias("empty")).crossJoin(truth.agg(F.count("*").alias("n")))
    sums = q.groupBy("excl", "t").agg(F.sum(f05(F.col("tp"), F.col("np"), F.col("ntrue"))).alias("s"), F.sum((F.col("ntrue") == 0).cast("int")).alias("answered"))
    return sums.crossJoin(F.broadcast(empty)).select("excl", "t", F.round((F.col("s") + F.col("empty") - F.col("answered")) / F.col("n"), 6).alias("macro_f05"))


RULES = ("e04", "majority", "e04_and_any", "e02_and_s3", "e02_and_e04", "all_three")


def ensemble(e04: DataFrame, e02: DataFrame, s3: DataFrame, rule: str) -> DataFrame:
    """Pairs that the rule accepts of three vote sets (qi, pi): one shuffle whatever the rule."""
    tag = lambda d, k: d.select("qi", "pi", *(F.lit(int(x == k)).alias(f"v{x}") for x in range(3)))
    v = reduce(DataFrame.unionByName, (tag(d, k) for k, d in enumerate((e04, e02, s3)))).groupBy("qi", "pi").agg(*(F.max(f"v{k}").alias(f"v{k}") for k in range(3)))
    a, b, c = (F.col(f"v{k}") == 1 for k in range(3))
    total = F.col("v0") + F.col("v1") + F.col("v2")
    accept = {"e04": a, "majority": total >= 2, "e04_and_any": a & (b | c), "e02_and_s3": b & c, "e02_and_e04": a & b, "all_three": total == 3}[rule]
    return v.where(accept).select("qi", "pi")


ENTITY_FEATURES = ["n_cand", "top1", "top2", "top3", "top4", "top5", "sum_p", "sum_p_ex", "n_ex", "n_05", "n_08", "n_095",
                   "n_05_ex", "log_p0", "log_p0_ex", "top1_survives_ex"]


def aggregates(df: DataFrame, col: str, all_q: DataFrame) -> DataFrame:
    """Sixteen numbers for each query: leading probabilities, counts, sums and log chances of no match, before and after
    exclusive owners; all 0 for a query without candidates."""
    p, owned = F.col(col), F.col("ex") == 1
    d = df.withColumns({"ex": (F.row_number().over(_best("pi", col, "qi")) == 1).cast("int")})
    d = d.withColumn("r", F.row_number().over(_best("qi", col, "pi")))
    at = lambda k: F.max(F.when(F.col("r") == k, p))
    over = lambda t: F.sum((p > t).cast("int"))
    none = lambda x: F.sum(F.ln(F.greatest(1 - x, F.lit(1e-6))))
    stats = d.groupBy("qi").agg(
        F.count("*").alias("n_cand"), *(at(k).alias(f"top{k}") for k in range(1, 6)), F.sum(p).alias("sum_p"),
        F.sum(F.when(owned, p).otherwise(0.0)).alias("sum_p_ex"), F.sum("ex").alias("n_ex"),
        over(0.5).alias("n_05"), over(0.8).alias("n_08"), over(0.95).alias("n_095"),
        F.sum(((p > 0.5) & owned).cast("int")).alias("n_05_ex"),
        none(p).alias("log_p0"), none(F.when(owned, p).otherwise(0.0)).alias("log_p0_ex"),
        F.max(F.when(F.col("r") == 1, F.col("ex"))).alias("top1_survives_ex"))
    return all_q.select("qi").distinct().join(stats, "qi", "left").na.fill(0)


def entity_decide(df: DataFrame, col: str, entity: DataFrame, empty_scale: float = 1.2, n_blend: float = 1.0) -> DataFrame:
    """expected_f after exclusivity, with the query's own estimates (entity: qi, p_empty, n_hat) of emptiness and size."""
    d = exclusive(df, col).join(entity, "qi")
    order, whole = Window.partitionBy("qi").orderBy(F.desc(col), "pi"), Window.partitionBy("qi")
    size = F.greatest(F.lit(0.5), n_blend * F.col("n_hat") + (1 - n_blend) * F.sum(col).over(whole))
    d = d.withColumns({"k": F.row_number().over(order), "hits": F.sum(col).over(order.rowsBetween(Window.unboundedPreceding, 0)), "size": size})
    d = d.withColumn("ef", F.round(1.25 * F.col("hits") / (F.col("k") + 0.25 * F.col("size")), 12)).withColumn("best", F.max("ef").over(whole))
    d = d.withColumn("kstar", F.min(F.when(F.col("ef") == F.col("best"), F.col("k"))).over(whole))
    return d.where((F.col("k") <= F.col("kstar")) & (F.col("best") > empty_scale * F.col("p_empty"))).select(*df.columns)


def apply_rule(df: DataFrame, col: str, rule: str, exclusive_first: bool = True, **options) -> DataFrame:
    d = exclusive(df, col) if exclusive_first else df
    return expected_f(d, col, **options) if rule == "expected_f" else threshold(d, col, **options)


def by_rule(df: DataFrame, col: str, rule: dict) -> DataFrame:
    """The pairs that a row of sweep() takes: rule, excl, and t and rel or miss and bias."""
    own = bool(rule["excl"])
    if rule["rule"] == "expected_f":
        return apply_rule(df, col, "expected_f", own, miss=rule["miss"], empty_bias=rule["bias"])
    return apply_rule(df, col, "threshold", own, t=rule["t"], rel=rule["rel"] or 0.0)


def rank_percentile(df: DataFrame, col: str, group: str) -> DataFrame:
    """Average rank over the group's size."""
    g, v = Window.partitionBy(group), Window.partitionBy(group, col)
    return df.withColumn(f"{col}_pct", (F.rank().over(Window.partitionBy(group).orderBy(col)) + (F.count("*").over(v) - 1) / 2) / F.count("*").over(g))


def auc(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Mann-Whitney AUC of each feature, folded to 0.5 and up; ranks come from counts by value, so no window holds all rows."""
    tall = df.select(label, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("x")).select(label, "x.*")
    by = tall.groupBy("feature", "v").agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("feature").orderBy("v")) - F.col("n")
    s = by.withColumn("r", below + (F.col("n") + 1) / 2).groupBy("feature").agg(F.sum(F.col("pos") * F.col("r")).alias("rs"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    a = (F.col("rs") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))
    return s.select("feature", F.round(F.greatest(a, 1 - a), 6).alias("auc"))

"""Records and scored pairs out of the test tables; the SQL beside each view gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LI = """li AS (SELECT l_orderkey qi, l_partkey pi, max(l_extendedprice) score, round(max(l_discount) * 10, 2) p FROM lineitem GROUP BY 1, 2)"""


def li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qi"), F.col("l_partkey").alias("pi")).agg(F.max("l_extendedprice").alias("score"), F.round(F.max("l_discount") * 10, 2).alias("p"))


#: Truth over the pairs: every part divisible by 7.
LI_TRUTH = LI + """, lt AS (SELECT qi, pi, score, p, (pi % 7 = 0)::INT AS label FROM li), nt AS (SELECT qi, sum(label)::BIGINT ntrue FROM lt GROUP BY 1)"""


def li_truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = li(spark, d).withColumn("label", (F.col("pi") % 7 == 0).cast("int"))
    return pairs, pairs.groupBy("qi").agg(F.sum("label").alias("ntrue"))


DOC = """doc AS (SELECT doc_id id, lang country, lower(split_part(text, chr(10), 1)) AS name, lower(substr(text, length(split_part(text, chr(10), 1)) + 2)) AS addr, lower(trim(text)) AS body, doc_id % 4 = 0 AS is_q FROM documents)"""


def doc(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as records: the first line is the name, all the others are the address."""
    first = F.substring_index("text", "\n", 1)
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("country"), F.lower(first).alias("name"),
        F.lower(F.substring("text", F.length(first) + 2, F.length("text"))).alias("addr"), F.lower(F.trim("text")).alias("body"), (F.col("doc_id") % 4 == 0).alias("is_q"))


#: Truth: equal texts across sides.
DOC_TRUTH = DOC + """, truth AS (SELECT a.id qi, b.id pi FROM doc a JOIN doc b ON a.country = b.country AND a.body = b.body AND a.is_q AND NOT b.is_q)"""


def doc_truth(r: DataFrame) -> DataFrame:
    """Exact copies meet on a digest of the text, so whole texts aren't shuffled."""
    k = r.withColumn("k", F.sha2("body", 256))
    return k.where("is_q").select("country", "k", F.col("id").alias("qi")).join(k.where("not is_q").select("country", "k", F.col("id").alias("pi")), ["country", "k"]).select("qi", "pi")


PART = """part_r AS (SELECT p_partkey id, lower(p_type) country, lower(p_name) AS name, p_size::VARCHAR AS num1, p_brand AS brand, p_size || ' ' || p_brand || ', ' || p_type AS addr, p_partkey % 4 = 0 AS is_q FROM part)"""


def part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.lower("p_type").alias("country"), F.lower("p_name").alias("name"), F.col("p_size").cast("string").alias("num1"), F.col("p_brand").alias("brand"),
        F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_brand", F.lit(", "), "p_type").alias("addr"), (F.col("p_partkey") % 4 == 0).alias("is_q"))


#: PART with name suffixes, three countries and a state component, so that aliases, legal forms and states occur.
PARTX = """partx AS (SELECT p_partkey id, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' LLC' WHEN 2 THEN ' d/b/a Wellness Co' WHEN 3 THEN ' #71076' ELSE '' END AS name,
 CASE p_partkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'india' ELSE 'france' END AS country,
 p_size || ' ' || p_brand || ' St, 00' || p_size || 'b Tenth Ave, ' || CASE p_partkey % 3 WHEN 0 THEN 'TN' WHEN 1 THEN 'MH' ELSE 'Nord' END AS addr, p_partkey % 4 = 0 AS is_q FROM part)"""


def partx(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.when(k % 5 == 0, " Pvt Ltd").when(k % 5 == 1, " LLC").when(k % 5 == 2, " d/b/a Wellness Co").when(k % 5 == 3, " #71076").otherwise("")
    pick = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        k.alias("id"), F.concat("p_name", suffix).alias("name"), pick("us", "india", "france").alias("country"),
        F.concat(size, F.lit(" "), "p_brand", F.lit(" St, 00"), size, F.lit("b Tenth Ave, "), pick("TN", "MH", "Nord")).alias("addr"), (k % 4 == 0).alias("is_q"))

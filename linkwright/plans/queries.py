"""Queries by name and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import audit, blocking, decide, features, models, records
from ..sources import tables
from ..sources.staging import scratch
from . import linkage
from .views import DOC, DOC_TRUTH, LI, LI_TRUTH, PART, PARTX, doc, doc_truth, li, li_truth, part, partx, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- sources and sinks ---------------------------------------------------------------------------------------------
def _raw(spark: SparkSession, d: str) -> DataFrame:
    names = F.concat(F.when(F.col("is_q"), "S1-").when(F.col("id") % 2 == 0, "S2-").otherwise("S3-"), F.col("id").cast("string"))
    return partx(spark, d).select("id", "is_q", names.alias("entity_id"), F.col("name").alias("business_name"), F.when(F.col("id") % 11 != 0, F.col("addr")).alias("business_address"), "country")


_RAW = PARTX + """, raw AS (SELECT id, is_q, CASE WHEN is_q THEN 'S1-' WHEN id % 2 = 0 THEN 'S2-' ELSE 'S3-' END || id AS entity_id, name AS business_name,
 CASE WHEN id % 11 <> 0 THEN addr END AS business_address, country FROM partx)"""


@query(f"WITH {_RAW} SELECT entity_id, business_name, coalesce(business_address, '') AS business_address, country FROM raw")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records as tab-separated text and back; missing values come back empty."""
    path = scratch(spark, "records-tsv")
    tables.write_tsv(_raw(spark, d).select("entity_id", "business_name", "business_address", "country"), path)
    return tables.read_tsv(spark, path)


@query(f"WITH {_RAW} SELECT entity_id, country, business_address IS NULL AS bare FROM raw")
def partitioned_parts(spark: SparkSession, d: str) -> DataFrame:
    """Records in a folder for each country, read as parts with three columns."""
    path = scratch(spark, "records-parts")
    tables.write_parquet(_raw(spark, d), path, by="country")
    return tables.read_parts(spark, path, columns=["entity_id", "country", "business_address"]).select("entity_id", "country", F.isnull("business_address").alias("bare"))


#: Each query's partners: the pool's records of its country with its name.
_MATES = """mates AS (SELECT q.id AS qi, c.id AS pi, 'S1-' || q.id AS s1, CASE WHEN c.id % 2 = 0 THEN 'S2-' ELSE 'S3-' END || c.id AS cand FROM partx q JOIN partx c
 ON q.is_q AND NOT c.is_q AND q.country = c.country AND q.name = c.name)"""


def _mates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = _raw(spark, d)
    q, p = raw.where("is_q"), raw.where("not is_q")
    pairs = q.select("country", "business_name", F.col("id").alias("qi")).join(p.select("country", "business_name", F.col("id").alias("pi")), ["country", "business_name"]).select("qi", "pi")
    return pairs, q.select(F.col("id").alias("qi"), F.col("id").alias("at"), "entity_id"), p.select(F.col("id").alias("pi"), "entity_id")


@query(f"""WITH {PARTX}, {_MATES}, l AS (SELECT qi, string_agg(cand, ',' ORDER BY cand) AS ids FROM mates GROUP BY 1)
SELECT 'source1_entity_id' || chr(9) || 'matched_entity_ids' AS value UNION ALL SELECT 'S1-' || id || chr(9) || coalesce(ids, '') FROM partx LEFT JOIN l ON qi = id WHERE is_q""")
def answer_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the answer file: a header, then each query with its sorted partners."""
    pairs, queries, pool = _mates(spark, d)
    path = scratch(spark, "answer-file")
    tables.write_lists(queries, pairs, pool, path)
    return tables.read_lines(spark, path)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{v}', {n})" for v, n in (
    ("carriage return", 0), ("header missing or repeated", 0), ("not two columns", 0), ("repeated query", 0), ("repeated id in a list", 0), ("bad id", 0), ("unknown query", 0),
    ("missing query", 0), ("unknown pool id", 0), ("wrong prefix", 0))) + ") AS t(violation, n)")
def answer_file_violations(spark: SparkSession, d: str) -> DataFrame:
    """The file-level checks of answer_file's lines, which must find nothing."""
    _, queries, pool = _mates(spark, d)
    return audit.file_violations(answer_file(spark, d), "matched_entity_ids", queries, pool)


@query(f"WITH {PARTX}, {_MATES} SELECT s1, cand FROM mates")
def truth_wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    """The answer file's lists as one row for each partner; empty lists give none."""
    lines = answer_file(spark, d).where(~F.col("value").startswith("source1"))
    parts = F.split("value", "\t")
    return tables.truth_pairs(lines.select(parts[0].alias("source1_entity_id"), parts[1].alias("matched_entity_ids")))


# ---- normalisation -------------------------------------------------------------------------------------------------
_FOLD_SQL = "replace(replace(translate({}, '%s', '%s'), 'ß', 'ss'), 'œ', 'oe')" % V.FOLD


@query(f"SELECT doc_id, {_FOLD_SQL.format('text')} AS folded FROM documents")
def ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.ascii_fold(F.col("text")).alias("folded"))


_STOP = "[" + ", ".join(f"'{w}'" for w in V.NAME_STOP) + "]"
_CLEAN = r"""regexp_replace(regexp_replace(replace(replace(lower(name), '&', ' and '), '+', ' plus '), '\(\s*id[:\s]*\d+\s*\)|#\s*\d+|\bid[:\s]+\d+', ' ', 'g'), '\.(com|net|org|in|co)\b', ' \1', 'g')"""
_ALIAS = V.ALIAS.replace("'", "''")
_LEET = "CASE WHEN regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') THEN translate(t, '%s', '%s') ELSE t END" % V.LEET


def _tokens_sql(s: str) -> str:
    return f"list_transform(list_transform(regexp_extract_all({s}, '[a-z0-9]+'), lambda t: {_LEET}), lambda t: coalesce(element_at({_map(V.NAME_CANON)}, t)[1], t))"


def _core_sql(s: str) -> str:
    return f"array_to_string(list_filter({_tokens_sql(s)}, lambda t: NOT list_contains({_STOP}, t) AND NOT regexp_full_match(t, '[0-9]+')), ' ')"


_SPLIT = f"regexp_replace(s, '{_ALIAS}', chr(1), 'g')"


@query(f"WITH {PARTX}, c AS (SELECT id, {_CLEAN} AS s FROM partx) SELECT id, array_to_string({_tokens_sql(f'replace({_SPLIT}, chr(1), chr(32))')}, ' ') AS name_norm, {_core_sql(f'replace({_SPLIT}, chr(1), chr(32))')} AS name_core FROM c")
def norm_name_core(spark: SparkSession, d: str) -> DataFrame:
    return partx(spark, d).select("id", T.name_norm(F.col("name")).alias("name_norm"), T.name_core(F.col("name")).alias("name_core"))


@query(f"""WITH {PARTX}, c AS (SELECT id, {_CLEAN} AS s FROM partx), p AS (SELECT id, unnest(list_filter(string_split({_SPLIT}, chr(1)), lambda x: trim(x) <> '')) AS part, generate_subscripts(list_filter(string_split({_SPLIT}, chr(1)), lambda x: trim(x) <> ''), 1) AS i FROM c)
SELECT id, string_agg({_core_sql('part')}, '|' ORDER BY i) AS name_alias FROM p GROUP BY id""")
def name_alias_parts(spark: SparkSession, d: str) -> DataFrame:
    return partx(spark, d).select("id", T.name_alias(F.col("name")).alias("name_alias"))


_ADDR = f"""a AS (SELECT id, country, string_split(lower(addr), ',') AS parts FROM partx),
 b AS (SELECT id, country, list_transform(parts, lambda p: CASE WHEN NOT regexp_matches(p, '[0-9]') THEN element_at({_map(V.STATE_BY_KEY)}, country || '|' || array_to_string(regexp_extract_all(p, '[a-z]+'), ' '))[1] END) AS found, parts FROM a),
 e AS (SELECT id, country, coalesce(list_filter(found, lambda x: x IS NOT NULL)[-1], '') AS addr_state,
  regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(parts, lambda p, i: found[i] IS NULL), ' , '), '(\\d+)(st|nd|rd|th)\\b', '\\1 ', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g') AS s FROM b),
 t AS (SELECT id, addr_state, list_transform(regexp_extract_all(s, '[a-z0-9]+'), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN coalesce(nullif(ltrim(t, '0'), ''), '0')
  ELSE coalesce(element_at({_map(V.ORDINALS)}, t)[1], CASE WHEN country = 'france' THEN element_at({_map(V.FR_ADDR)}, t)[1] END, element_at({_map(V.ADDR_CANON)}, t)[1], t) END) AS toks FROM e)"""


@query(f"WITH {PARTX}, {_ADDR} SELECT id, array_to_string(toks, ' ') AS addr_norm, addr_state FROM t")
def addr_state_strip(spark: SparkSession, d: str) -> DataFrame:
    a, c = F.col("addr"), F.col("country")
    return partx(spark, d).select("id", T.addr_norm(a, c).alias("addr_norm"), T.addr_state(a, c).alias("addr_state"))


@query(f"""WITH {PARTX}, {_ADDR}, n AS (SELECT id, list_filter(toks, lambda t: regexp_full_match(t, '[0-9]+')) AS nums FROM t)
SELECT id, array_to_string(list_filter(nums, lambda x, i: list_position(nums, x) = i), ' ') AS addr_nums FROM n""")
def norm_addr_nums(spark: SparkSession, d: str) -> DataFrame:
    return partx(spark, d).select("id", T.addr_nums(F.col("addr"), F.col("country")).alias("addr_nums"))


@query(f"""WITH {PARTX}, c AS (SELECT id, {_CLEAN} AS s FROM partx), n AS (SELECT id, {_tokens_sql(f'replace({_SPLIT}, chr(1), chr(32))')} AS toks FROM c)
SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(toks, lambda t: element_at({_map(V.LEGAL)}, t)[1]), lambda x: x IS NOT NULL))), ' ') AS legal FROM n""")
def legal_form_set(spark: SparkSession, d: str) -> DataFrame:
    return partx(spark, d).select("id", T.legal_forms(T.name_norm(F.col("name"))).alias("legal"))


# ---- blocking ------------------------------------------------------------------------------------------------------
def _key_sql(view: str, keys: list[str], max_q: int, max_p: int, name: str) -> str:
    by, full = ", ".join(["country", *keys]), " AND ".join(f"{k} <> ''" for k in keys)
    return f"""SELECT qi, pi, round(1.0::DOUBLE / np, 6) AS {name}_score, 0 AS {name}_rank FROM
 (SELECT id qi, {by} FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {view} WHERE is_q AND {full}) WHERE n <= {max_q}) JOIN
 (SELECT id pi, n AS np, {by} FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {view} WHERE NOT is_q AND {full}) WHERE n <= {max_p}) USING ({by})"""


def _key(r: DataFrame, name: str, keys: list[str], caps: tuple[int, int]) -> DataFrame:
    return blocking.key_pass(name, r.where("is_q"), r.where("not is_q"), keys, *caps)


@query(f"WITH {DOC} {_key_sql('doc', ['name'], 3, 30, 'k_name')}")
def key_pass_name(spark: SparkSession, d: str) -> DataFrame:
    return _key(doc(spark, d), "k_name", ["name"], (3, 30))


_PARTK = PART + ", pk AS (SELECT *, array_to_string(list_sort(string_split(name, ' ')), ' ') AS name_sorted, replace(name, ' ', '') AS name_nosp FROM part_r)"


def _partk(spark: SparkSession, d: str) -> DataFrame:
    return part(spark, d).withColumns({"name_sorted": F.array_join(F.array_sort(F.split("name", " ")), " "), "name_nosp": F.replace("name", F.lit(" "), F.lit(""))})


@query(f"WITH {_PARTK} {_key_sql('pk', ['name', 'num1'], 20, 200, 'k_name_num')}")
def key_pass_name_num(spark: SparkSession, d: str) -> DataFrame:
    return _key(_partk(spark, d), "k_name_num", ["name", "num1"], (20, 200))


@query(f"WITH {_PARTK} {_key_sql('pk', ['name_sorted', 'num1'], 20, 200, 'k_sorted_num')}")
def key_pass_sorted_num(spark: SparkSession, d: str) -> DataFrame:
    return _key(_partk(spark, d), "k_sorted_num", ["name_sorted", "num1"], (20, 200))


@query(f"WITH {_PARTK} {_key_sql('pk', ['name_nosp', 'num1'], 20, 200, 'k_nosp_num')}")
def key_pass_nospace_num(spark: SparkSession, d: str) -> DataFrame:
    return _key(_partk(spark, d), "k_nosp_num", ["name_nosp", "num1"], (20, 200))


def _tfidf_sql(tokens: str, min_df: int = 1, view: str = "doc", end: str = "", max_df: int | None = blocking.MAX_DF) -> str:
    """Scored pairs sc<end> of a view's records by the cosine of their tokens' weights w<end>; max_df None: of all tokens."""
    tk, tf, nn, dfs, x, w, sc = (f"{n}{end}" for n in ("tk", "tf", "nn", "dfs", "x", "w", "sc"))
    return f"""{tk} AS (SELECT country, id, is_q, unnest({tokens}) AS token FROM {view}), {tf} AS (SELECT country, id, is_q, token, count(*) c FROM {tk} GROUP BY ALL),
 {nn} AS (SELECT country, count(*) n FROM {view} GROUP BY 1), {dfs} AS (SELECT country, token, count(*) df FROM {tf} GROUP BY 1, 2 HAVING count(*) {f'BETWEEN {min_df} AND {max_df}' if max_df else f'>= {min_df}'}),
 {x} AS (SELECT country, id, is_q, token, (1 + ln(c)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS x FROM {tf} JOIN {dfs} USING (country, token) JOIN {nn} USING (country)),
 {w} AS (SELECT country, id, is_q, token, x / sqrt(sum(x * x) OVER (PARTITION BY country, id)) AS w FROM {x}),
 {sc} AS (SELECT q.id qi, p.id pi, round(sum(q.w * p.w), 9) AS score FROM {w} q JOIN {w} p ON q.country = p.country AND q.token = p.token AND q.is_q AND NOT p.is_q GROUP BY 1, 2)"""


_WORDS = r"regexp_extract_all(lower(name || ' ' || addr), '\S+')"
_GRAMS = "list_transform(generate_series(1, length(replace(name, ' ', '')) - 3), lambda i: substr(replace(name, ' ', ''), i, 4))"


def _post(spark: SparkSession, d: str) -> DataFrame:
    return blocking.postings(doc(spark, d), blocking.words(F.concat_ws(" ", "name", "addr")))


def _scored(spark: SparkSession, d: str, forward: int | None, reverse: int | None = None, max_df: int | None = blocking.MAX_DF) -> DataFrame:
    return blocking.similar(doc(spark, d), blocking.words(F.concat_ws(" ", "name", "addr")), forward, reverse, max_df)


@query(f"WITH {DOC}, {_tfidf_sql(_WORDS)} SELECT country, id, is_q, token, round(w, 6) AS w FROM w")
def tfidf_postings(spark: SparkSession, d: str) -> DataFrame:
    return _post(spark, d).select("country", "id", "is_q", "token", F.round("w", 6).alias("w"))


def _top_sql(name: str, k: int, by: str, tie: str, scored: str = "sc") -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {tie}) AS r FROM {scored}"
    return f"SELECT qi, pi, round(score, 6) AS {name}_score, (r - 1)::INT AS {name}_rank FROM ({ranked}) WHERE r <= {k}"


@query(f"WITH {DOC}, {_tfidf_sql(_WORDS, max_df=None)} {_top_sql('comb', 50, 'qi', 'pi')}")
def tfidf_topk_forward(spark: SparkSession, d: str) -> DataFrame:
    return blocking.top_k(_scored(spark, d, 50, max_df=None), "comb", 50)


@query(f"WITH {DOC}, {_tfidf_sql(_WORDS, max_df=None)} {_top_sql('rev', 5, 'pi', 'qi')}")
def tfidf_topk_reverse(spark: SparkSession, d: str) -> DataFrame:
    return blocking.top_k(_scored(spark, d, None, 5, max_df=None), "rev", 5, True)


@query(f"WITH {DOC}, {_tfidf_sql(_GRAMS, 2, max_df=None)} {_top_sql('name_ch', 12, 'qi', 'pi')}")
def char4_topk(spark: SparkSession, d: str) -> DataFrame:
    return blocking.top_k(blocking.similar(doc(spark, d), blocking.char_grams(F.replace("name", F.lit(" "), F.lit(""))), 12, min_df=2), "name_ch", 12)


@query(f"""WITH {DOC}, {_tfidf_sql(_WORDS)}, f AS ({_top_sql('comb', 50, 'qi', 'pi')}), r AS ({_top_sql('rev', 5, 'pi', 'qi')}), k AS ({_key_sql('doc', ['name'], 3, 30, 'k_name')})
SELECT *, (comb_score IS NOT NULL)::INT + (rev_score IS NOT NULL)::INT + (k_name_score IS NOT NULL)::INT AS n_passes FROM f FULL JOIN r USING (qi, pi) FULL JOIN k USING (qi, pi)""")
def union_passes_full_outer(spark: SparkSession, d: str) -> DataFrame:
    sc = _scored(spark, d, 50, 5)
    return blocking.union_passes({"comb": blocking.top_k(sc, "comb", 50), "rev": blocking.top_k(sc, "rev", 5, True), "k_name": key_pass_name(spark, d)})


@query(f"WITH {DOC_TRUTH}, {_tfidf_sql(_WORDS)}, r AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY score DESC, pi) AS rn FROM sc), h AS (SELECT rn FROM r SEMI JOIN truth USING (qi, pi) WHERE rn <= 50) SELECT " + ", ".join(f"coalesce(sum((rn <= {n})::INT), 0)::BIGINT AS hit_{n}" for n in (5, 10, 15, 20, 30, 50)) + ", count(*) AS hit_all FROM h")
def recall_at_n(spark: SparkSession, d: str) -> DataFrame:
    return audit.recall_at(decide.prune(_scored(spark, d, 50), "score", 50), doc_truth(doc(spark, d)))


@query(f"WITH {DOC}, {_tfidf_sql(_WORDS)}, k AS ({_key_sql('doc', ['name'], 3, 30, 'k_name')}) SELECT k.qi, k.pi, round(coalesce(score, 0), 6) AS tfidf FROM k LEFT JOIN sc ON k.qi = sc.qi AND k.pi = sc.pi")
def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    return features.cosine(key_pass_name(spark, d).select("qi", "pi"), _post(spark, d), "tfidf")


@query(f"WITH {DOC}, f AS (SELECT country, name, count(*) freq FROM doc GROUP BY 1, 2), z AS (SELECT country, count(*) sz FROM doc WHERE NOT is_q GROUP BY 1) SELECT country, name, freq, round(freq::DOUBLE / sz * 1e6, 6) AS freq_rel FROM f LEFT JOIN z USING (country)")
def name_freq_relative(spark: SparkSession, d: str) -> DataFrame:
    return blocking.name_frequency(doc(spark, d))


#: PARTX normalised, with the columns that keys and text views use.
_REC = f"""{PARTX}, {_ADDR}, c AS (SELECT id, {_CLEAN} AS s FROM partx),
 nm AS (SELECT id, array_to_string({_tokens_sql(f'replace({_SPLIT}, chr(1), chr(32))')}, ' ') AS name_norm, {_core_sql(f'replace({_SPLIT}, chr(1), chr(32))')} AS name_core FROM c),
 an AS (SELECT id, addr_state, array_to_string(toks, ' ') AS addr_norm, list_filter(toks, lambda t: regexp_full_match(t, '[0-9]+')) AS nums FROM t),
 rec AS MATERIALIZED (SELECT id, country, is_q, name_norm, name_core, addr_norm, addr_state, array_to_string(list_filter(nums, lambda x, i: list_position(nums, x) = i), ' ') AS addr_nums,
  coalesce(nums[1], '') AS num1, array_to_string(list_sort(string_split(name_core, ' ')), ' ') AS name_sorted, replace(name_core, ' ', '') AS name_nosp FROM partx JOIN nm USING (id) JOIN an USING (id))"""
_VIEWS = {"comb": "name_core || ' ' || addr_norm", "addr": "addr_norm", "nameaddr": "'n_' || replace(name_core, ' ', '_') || ' ' || addr_norm", "name_nospace": "name_nosp"}


def _candidates_sql() -> str:
    scored, passes = {}, {}
    for name, (kind, what, k, direction) in blocking.PASSES.items():
        if kind == "key":
            passes[name] = _key_sql("rec", what, *k, name)
            continue
        grams = "list_transform(generate_series(1, length(name_nosp) - 3), lambda i: substr(name_nosp, i, 4))"
        tokens, least = (grams, 2) if kind == "char" else (rf"regexp_extract_all(lower({_VIEWS[what]}), '\S+')", 1)
        scored[what] = _tfidf_sql(tokens, least, "rec", f"_{what}")
        by, tie = ("pi", "qi") if direction == "reverse" else ("qi", "pi")
        passes[name] = _top_sql(name, k, by, tie, f"sc_{what}")
    each = ", ".join(f"pass_{n} AS ({sql})" for n, sql in passes.items())
    joined = " FULL JOIN ".join(f"pass_{n}" + (" USING (qi, pi)" if i else "") for i, n in enumerate(passes))
    count = " + ".join(f"({n}_score IS NOT NULL)::INT" for n in passes)
    return f"WITH {_REC}, {', '.join(scored.values())}, {each} SELECT *, {count} AS n_passes FROM {joined}"


@query(_candidates_sql())
def generate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All ten passes over normalised records; scores of one text serve both directions."""
    return blocking.generate(_normal(spark, d))


# ---- features ------------------------------------------------------------------------------------------------------
_SET = "list_distinct(list_filter(string_split({}, ' '), lambda t: t <> ''))"


@query(f"""WITH {DOC}, k AS ({_key_sql('doc', ['name'], 3, 30, 'k_name')}), s AS (SELECT qi, pi, {_SET.format('a.addr')} x, {_SET.format('b.addr')} y FROM k JOIN doc a ON a.id = qi JOIN doc b ON b.id = pi),
 n AS (SELECT qi, pi, len(list_intersect(x, y)) i, len(x) m, len(y) n FROM s)
SELECT qi, pi, i::INT AS atok_inter, round(i / nullif(m + n - i, 0)::DOUBLE, 6) AS atok_jacc, round(i / nullif(m, 0)::DOUBLE, 6) AS atok_cont_q, round(i / nullif(n, 0)::DOUBLE, 6) AS atok_cont_c, m::INT AS atok_len_q, n::INT AS atok_len_c FROM n""")
def token_set_stats(spark: SparkSession, d: str) -> DataFrame:
    r = doc(spark, d)
    j = key_pass_name(spark, d).select("qi", "pi").join(r.select(F.col("id").alias("qi"), F.col("addr").alias("a")), "qi").join(r.select(F.col("id").alias("pi"), F.col("addr").alias("b")), "pi")
    return j.select("qi", "pi", *T.set_stats(F.col("a"), F.col("b"), "atok"))


_NP = f"{_PARTK}, k AS ({_key_sql('pk', ['name'], 3, 30, 'k_name')}), j AS (SELECT k.qi, k.pi, a.num1 AS na, b.num1 AS nb, a.brand AS ba, b.brand AS bb, a.name AS x, b.name AS y FROM k JOIN pk a ON a.id = qi JOIN pk b ON b.id = pi)"


def _np(spark: SparkSession, d: str) -> DataFrame:
    r = _partk(spark, d)
    side = lambda key, e: r.select(F.col("id").alias(key), F.col("num1").alias(f"n{e}"), F.col("brand").alias(f"b{e}"))
    return _key(r, "k_name", ["name"], (3, 30)).select("qi", "pi").join(side("qi", "a"), "qi").join(side("pi", "b"), "pi")


@query(f"WITH {_NP} SELECT qi, pi, levenshtein(na, nb)::INT AS num_lev, (na = nb)::INT AS num_eq, abs(na::DOUBLE - nb::DOUBLE) AS num_absdiff FROM j")
def levenshtein_num(spark: SparkSession, d: str) -> DataFrame:
    return _np(spark, d).select("qi", "pi", F.levenshtein("na", "nb").alias("num_lev"), (F.col("na") == F.col("nb")).cast("int").alias("num_eq"), F.abs(F.col("na").try_cast("double") - F.col("nb").try_cast("double")).alias("num_absdiff"))


@query(f"WITH {_NP} SELECT qi, pi, round(jaro_winkler_similarity(ba, bb), 6) AS jw FROM j")
def jaro_winkler_brand(spark: SparkSession, d: str) -> DataFrame:
    return _np(spark, d).select("qi", "pi", F.round(S.jaro_winkler_udf("ba", "bb"), 6).alias("jw"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    names = F.concat(F.when(F.col("is_q"), "S1-").when(F.col("id") % 2 == 0, "S2-").otherwise("S3-"), F.col("id").cast("string"))
    return partx(spark, d).select("id", names.alias("entity_id"), F.col("name").alias("business_name"), F.col("addr").alias("business_address"), "country", "is_q")


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return records.normalize(_raw(spark, d))


def _view(r: DataFrame) -> DataFrame:
    pairs = blocking.key_pass("k", r.where("is_q"), r.where("not is_q"), ["addr_nums"], 20, 200).select("qi", "pi")
    return features.pair_view(pairs, r)


def _lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence: one list after another, each made of the last."""
    cell = "greatest(made[-1], line[y[2] + 1], CASE WHEN y[1] = x[1] THEN line[y[2]] + 1 ELSE 0 END)"
    line = f"list_reduce(list_transform(string_split({b}, ''), lambda v, k: [unicode(v), k]), lambda made, y: list_append(made, {cell}), [0])"
    return f"list_reduce(list_transform(string_split({a}, ''), lambda u: [unicode(u), 0]), lambda line, x: {line}, list_resize([0], length({b}) + 1, 0))[-1]"


def _ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 200.0::DOUBLE * {_lcs_sql(a, b)} / (length({a}) + length({b})) END"


def _stretch_sql(a: str, b: str) -> str:
    """The best ratio of a with any stretch of b that is no longer than a."""
    stretch = f"substr({b}, greatest(0, h - length({a})) + 1, least(h, length({b})) - greatest(0, h - length({a})))"
    return f"list_max(list_transform(generate_series(1, length({a}) + length({b}) - 1), lambda h: {_ratio_sql(a, stretch)}))"


def _partial_sql(a: str, b: str) -> str:
    either = f"greatest({_stretch_sql(a, b)}, CASE WHEN length({a}) = length({b}) THEN {_stretch_sql(b, a)} END)"
    return f"CASE WHEN {a} = {b} THEN 100.0 WHEN {a} = '' THEN 0.0 WHEN contains({b}, {a}) THEN 100.0 ELSE {either} END"


def _alike_sql(source: str, a: str, b: str, name: str) -> str:
    """CTE name(a, b, ratio, pratio, tsort, tset, jw): measures of each two strings of a source once."""
    text = "array_to_string(list_sort({}), ' ')".format
    words = "list_filter(string_split({}, ' '), lambda t: t <> '')".format
    return f"""{name}_1 AS (SELECT a, b, {text(words('a'))} AS sa, {text(words('b'))} AS sb, list_distinct({words('a')}) AS x, list_distinct({words('b')}) AS y,
  CASE WHEN length(a) > length(b) THEN b ELSE a END AS less, CASE WHEN length(a) > length(b) THEN a ELSE b END AS more FROM (SELECT DISTINCT {a} AS a, {b} AS b FROM {source})),
 {name}_2 AS (SELECT *, {text('list_intersect(x, y)')} AS common, {text('list_filter(x, lambda t: NOT list_contains(y, t))')} AS l, {text('list_filter(y, lambda t: NOT list_contains(x, t))')} AS r FROM {name}_1),
 {name}_3 AS (SELECT *, trim(common || ' ' || l) AS jl, trim(common || ' ' || r) AS jr FROM {name}_2),
 {name} AS MATERIALIZED (SELECT a, b, {_ratio_sql('a', 'b')} AS ratio, {_ratio_sql('sa', 'sb')} AS tsort, jaro_winkler_similarity(a, b) AS jw, {_partial_sql('less', 'more')} AS pratio,
  CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN common <> '' AND (l = '' OR r = '') THEN 100.0
   ELSE greatest({_ratio_sql('jl', 'jr')}, CASE WHEN common <> '' THEN 200.0 * length(common) / (2 * length(common) + 1 + least(length(l), length(r))) END) END AS tset FROM {name}_3)"""


_PAIRS = f"""{_REC}, k AS ({_key_sql('rec', ['addr_nums'], 20, 200, 'k')}), v AS MATERIALIZED (SELECT qi, pi, {', '.join(f'{e}.{c} AS {c}_{e}' for e in 'qc' for c in ('name_norm', 'name_core', 'addr_norm', 'addr_nums', 'addr_state'))}
 FROM k JOIN rec q ON q.id = qi JOIN rec c ON c.id = pi), {_alike_sql('v', 'name_core_q', 'name_core_c', 'nm_like')}, {_alike_sql('v', 'addr_norm_q', 'addr_norm_c', 'ad_like')}"""
_LIKED = "v JOIN nm_like n ON n.a = name_core_q AND n.b = name_core_c JOIN ad_like d ON d.a = addr_norm_q AND d.b = addr_norm_c"


def _feature_sql() -> str:
    legal = f"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(name_norm_{{0}}, ' '), lambda t: element_at({_map(V.LEGAL)}, t)[1]), lambda x: x IS NOT NULL))), ' ')"
    street = r"trim(regexp_replace(regexp_replace(addr_norm_{0}, '\b\d+\b', '', 'g'), '\s+', ' ', 'g'))"
    made = {"legal": legal, "bare": "replace(name_core_{0}, ' ', '')", "street": street, "first": "split_part(addr_nums_{0}, ' ', 1)"}
    more = ", ".join(f"{sql.replace('{0}', e)} AS {name}_{e}" for name, sql in made.items() for e in "qc")
    liked = {"nm_like": "name_core", "ad_like": "addr_norm", "full_like": "name_norm", "bare_like": "bare", "street_like": "street", "first_like": "first"}
    extra = ", ".join(_alike_sql("u", f"{c}_q", f"{c}_c", n) for n, c in liked.items() if n not in ("nm_like", "ad_like"))
    joins = " ".join(f"JOIN {n} ON {n}.a = {c}_q AND {n}.b = {c}_c" for n, c in liked.items())
    sets = []
    for column, prefix in (("name_core", "ntok"), ("addr_norm", "atok"), ("addr_nums", "num"), ("legal", "lg")):
        x, y = _SET.format(f"{column}_q"), _SET.format(f"{column}_c")
        sets += [f"len(list_intersect({x}, {y}))::INT AS {prefix}_inter", f"len({x})::INT AS {prefix}_len_q", f"len({y})::INT AS {prefix}_len_c"]
    share = lambda p, q, name: f"round({p} / nullif({q}, 0)::DOUBLE, 6) AS {name}"
    shares = [share(f"{p}_inter", f"({p}_len_q + {p}_len_c - {p}_inter)", "legal_jacc" if p == "lg" else f"{p}_jacc") for p in ("ntok", "atok", "num", "lg")]
    shares += [share(f"{p}_inter", f"{p}_len_{e}", f"{p}_cont_{e}") for p in ("ntok", "atok", "num") for e in "qc"]
    flag = lambda test, name: f"({test})::INT::DOUBLE AS {name}"
    when = lambda a, b, value, name: f"CASE WHEN {a} <> '' AND {b} <> '' THEN {value} END AS {name}"
    both_first = lambda value, name: when("first_q", "first_c", value, name)
    columns = [
        *(f"round({t}.{m}, 6) AS {name}" for t, m, name in (
            ("nm_like", "tset", "c_n_tset"), ("nm_like", "ratio", "c_n_ratio"), ("ad_like", "tset", "c_a_tset"), ("ad_like", "ratio", "c_a_ratio"), ("full_like", "tsort", "nfull_tsort"),
            ("street_like", "tset", "aw_tset"), ("bare_like", "ratio", "n_nospace_ratio"), ("bare_like", "pratio", "n_nospace_pratio"), ("nm_like", "jw", "n_jw"),
            *((t, m, f"{e}_{m}") for t, e in (("nm_like", "n"), ("ad_like", "a")) for m in ("ratio", "pratio", "tsort", "tset")))),
        both_first("(first_q = first_c)::INT::DOUBLE", "c_num1_eq"), both_first("(first_q = first_c)::INT::DOUBLE", "num_first_eq"), both_first("levenshtein(first_q, first_c)::INT", "num_first_lev"),
        both_first("round(first_like.pratio, 6)", "num_first_pfx"), both_first("abs(first_q::DOUBLE - first_c::DOUBLE)", "num_first_absdiff"),
        flag("addr_norm_c = ''", "c_a_empty"), flag("addr_norm_c = ''", "a_empty_c"), flag("addr_norm_q = ''", "a_empty_q"), flag("name_core_c = ''", "n_empty_c"),
        "levenshtein(name_core_q, name_core_c)::INT AS n_lev", flag("string_split(name_core_q, ' ')[-1] = string_split(name_core_c, ' ')[-1]", "n_last_eq"),
        flag("split_part(name_core_q, ' ', 1) = split_part(name_core_c, ' ', 1)", "n_first_eq"), flag("legal_q <> '' AND legal_c <> ''", "legal_both"), flag("legal_q <> '' OR legal_c <> ''", "legal_any"),
        flag("legal_q = '' AND legal_c <> ''", "legal_only_c"), flag("legal_q <> '' AND legal_c = ''", "legal_only_q"), when("legal_q", "legal_c", "(legal_q = legal_c)::INT::DOUBLE", "legal_eq"),
        when("addr_state_q", "addr_state_c", "(addr_state_q = addr_state_c)::INT::DOUBLE", "state_eq"), flag("pi % 2 = 1", "is_s3"), "count(*) OVER (PARTITION BY qi) AS g_size",
        "row_number() OVER (PARTITION BY qi ORDER BY round(nm_like.tset + ad_like.tset, 9) DESC, pi) AS g_sim_rank", *sets]
    corpus = f"""{_tfidf_sql(_SET.format('name_core').replace('list_distinct', ''), 1, 'rec', '_tn', 10**12)}, {_tfidf_sql(_SET.format('addr_norm').replace('list_distinct', ''), 1, 'rec', '_ta', 10**12)},
 sz AS (SELECT country, count(*) AS pool FROM rec WHERE NOT is_q GROUP BY 1), fr AS (SELECT id, count(*) OVER (PARTITION BY country, name_core) AS freq, pool FROM rec LEFT JOIN sz USING (country)),
 al AS (SELECT id, {_core_sql('part')} AS part FROM (SELECT id, unnest(string_split({_SPLIT}, chr(1))) AS part FROM c) WHERE trim(part) <> ''), ap AS (SELECT qi, pi, name_core_q, coalesce(part, '') AS part FROM v LEFT JOIN al ON al.id = pi),
 {_alike_sql('ap', 'name_core_q', 'part', 'al_like')}, best AS (SELECT qi, pi, round(max(tsort), 6) AS n_alias_best FROM ap JOIN al_like ON a = name_core_q AND b = part GROUP BY 1, 2)"""
    names = ", ".join(f"round(ln(1 + f{e}.freq), 6) AS n_freq_{e}, round(ln(1 + round(f{e}.freq::DOUBLE / f{e}.pool * 1e6, 6)), 6) AS n_freq_rel_{e}" for e in "qc")
    return f"""WITH {_PAIRS}, u AS MATERIALIZED (SELECT *, {more} FROM v), {extra}, {corpus}, m AS (SELECT qi, pi, {', '.join(columns)} FROM u {joins})
SELECT m.* EXCLUDE (lg_inter, lg_len_q, lg_len_c), {', '.join(shares)}, ntok_len_c - ntok_inter AS ntok_extra_c, ntok_len_q - ntok_inter AS ntok_missing_q, n_alias_best,
 round(coalesce(n.score, 0), 6) AS n_tfidf, round(coalesce(d.score, 0), 6) AS a_tfidf, {names}
FROM m JOIN best USING (qi, pi) LEFT JOIN sc_tn n USING (qi, pi) LEFT JOIN sc_ta d USING (qi, pi) JOIN fr fq ON fq.id = qi JOIN fr fc ON fc.id = pi"""


@query(_feature_sql())
def pair_feature_table(spark: SparkSession, d: str) -> DataFrame:
    """All pair features but those of the passes, over pairs that share their numbers."""
    r = _normal(spark, d)
    out = features.corpus_features(features.pair_features(features.cheap_features(_view(r))), r)
    return out.select("qi", "pi", *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if t != "string" and c not in ("qi", "pi")))


@query(f"WITH {_PAIRS} SELECT qi, pi, " + ", ".join(f"round({e}.{m}, 6) AS {p}_{m}" for e, p in (("n", "n"), ("d", "a")) for m in ("ratio", "pratio", "tsort", "tset")) + f", round(n.jw, 6) AS n_jw FROM {_LIKED}")
def pair_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Ratio, partial ratio, token-sort, token-set and Jaro-Winkler of names and addresses."""
    return features.pair_features(_view(_normal(spark, d))).select("qi", "pi", *_r(*(f"{e}_{m}" for e in "na" for m in ("ratio", "pratio", "tsort", "tset")), "n_jw"))


_OTHER = "coalesce(CASE WHEN rk = 1 THEN max(CASE WHEN rk = 2 THEN {0} END) OVER (PARTITION BY qi) ELSE max(CASE WHEN rk = 1 THEN {0} END) OVER (PARTITION BY qi) END, '')"


@query(f"""WITH {_PAIRS}, f AS (SELECT v.*, n.tset + d.tset AS like_sum, row_number() OVER (PARTITION BY qi ORDER BY n.ratio DESC, pi) AS rk FROM {_LIKED}),
 g AS (SELECT *, {_OTHER.format('name_core_c')} AS on_, {_OTHER.format('addr_norm_c')} AS oa, count(*) OVER (PARTITION BY qi) AS g_size, count(*) OVER (PARTITION BY qi, addr_norm_c) AS g_same_addr,
  count(*) OVER (PARTITION BY qi, name_core_c) AS g_same_name, row_number() OVER (PARTITION BY qi ORDER BY round(like_sum, 9) DESC, pi) AS g_sim_rank FROM f),
 {_alike_sql('g', 'name_core_c', 'on_', 'on_like')}, {_alike_sql('g', 'addr_norm_c', 'oa', 'oa_like')}
SELECT qi, pi, CASE WHEN g_size > 1 THEN round(n.tsort, 6) END AS cvc_name, CASE WHEN g_size > 1 THEN round(d.tsort, 6) END AS cvc_addr, g_same_addr, g_same_name, g_size, g_sim_rank
FROM g JOIN on_like n ON n.a = name_core_c AND n.b = on_ JOIN oa_like d ON d.a = addr_norm_c AND d.b = oa""")
def group_context_sim(spark: SparkSession, d: str) -> DataFrame:
    out = features.group_features(features.cheap_features(_view(_normal(spark, d))), "c_n_ratio")
    return out.select("qi", "pi", *_r("cvc_name", "cvc_addr"), "g_same_addr", "g_same_name", "g_size", "g_sim_rank")


# ---- windows and decisions -----------------------------------------------------------------------------------------
_STATS = """SELECT qi, pi, score, row_number() OVER q AS s_q_rank, round(score - max(score) OVER (PARTITION BY qi), 6) AS s_q_gap_max, count(*) OVER (PARTITION BY qi) AS s_q_n,
 round(score - nth_value(score, 2) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS s_q_gap_2nd, round(sum(score) OVER (PARTITION BY qi), 6) AS s_q_sum,
 row_number() OVER p AS s_p_rank, round(score - max(score) OVER (PARTITION BY pi), 6) AS s_p_gap_max, count(*) OVER (PARTITION BY pi) AS s_p_n,
 round(score - nth_value(score, 2) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS s_p_gap_2nd
 FROM li WINDOW q AS (PARTITION BY qi ORDER BY score DESC, pi), p AS (PARTITION BY pi ORDER BY score DESC, qi)"""


@query(f"WITH {LI} {_STATS}")
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    g = decide.group_stats(li(spark, d).drop("p"), "score", "s")
    return g.select("qi", "pi", "score", "s_q_rank", "s_p_rank", "s_q_n", "s_p_n", *_r("s_q_gap_max", "s_q_gap_2nd", "s_q_sum", "s_p_gap_max", "s_p_gap_2nd"))


@query(f"WITH {LI} SELECT qi, pi, score FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY score DESC, pi) AS rn FROM li) WHERE rn <= 2")
def prune_topn(spark: SparkSession, d: str) -> DataFrame:
    return decide.prune(li(spark, d), "score", 2).select("qi", "pi", "score")


_EXCL = "ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pi ORDER BY p DESC, qi) AS rn FROM {}) WHERE rn = 1)"


@query(f"WITH {LI}, {_EXCL.format('li')} SELECT qi, pi, p FROM ex")
def exclusive_owner(spark: SparkSession, d: str) -> DataFrame:
    return decide.exclusive(li(spark, d), "p").select("qi", "pi", "p")


@query(f"WITH {LI} SELECT qi, pi, p FROM (SELECT *, max(p) OVER (PARTITION BY qi) AS t FROM li) WHERE p >= 0.3 AND p >= 0.8 * t")
def threshold_rel(spark: SparkSession, d: str) -> DataFrame:
    return decide.threshold(li(spark, d), "p", 0.3, 0.8).select("qi", "pi", "p")


def _ef_sql(source: str) -> str:
    return f"""e1 AS (SELECT *, row_number() OVER o AS k, sum(p) OVER (o ROWS UNBOUNDED PRECEDING) AS hits, sum(p) OVER (PARTITION BY qi) AS tot,
 CASE WHEN max(p) OVER (PARTITION BY qi) >= 1 THEN 0 ELSE exp(sum(CASE WHEN p < 1 THEN ln(1 - p) END) OVER (PARTITION BY qi)) END AS none FROM {source} WHERE p > 0.01 WINDOW o AS (PARTITION BY qi ORDER BY p DESC, pi)),
 e2 AS (SELECT *, round(1.25 * hits / (k + 0.25 * tot), 12) AS ef FROM e1), e3 AS (SELECT *, max(ef) OVER (PARTITION BY qi) AS best FROM e2),
 e4 AS (SELECT *, min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY qi) AS kstar FROM e3), chosen AS (SELECT * FROM e4 WHERE k <= kstar AND best > none)"""


@query(f"WITH {LI}, {_ef_sql('li')} SELECT qi, pi, p FROM chosen")
def expected_f_subset(spark: SparkSession, d: str) -> DataFrame:
    return decide.expected_f(li(spark, d), "p").select("qi", "pi", "p")


_F05 = "CASE WHEN ntrue = 0 THEN (np = 0)::INT::DOUBLE WHEN np = 0 OR tp = 0 THEN 0 ELSE 1.25 * tp / (np + 0.25 * ntrue) END"


def _macro_sql(pred: str, truth: str) -> str:
    return f"""m AS (SELECT n.qi, ntrue, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np FROM {truth} n LEFT JOIN (SELECT qi, sum(label) tp, count(*) np FROM {pred} GROUP BY 1) USING (qi))
SELECT round(avg({_F05}), 6) AS macro_f05, round(sum(tp)::DOUBLE / nullif(sum(np), 0)::DOUBLE, 6) AS pair_precision, round(sum(tp)::DOUBLE / nullif(sum(ntrue), 0)::DOUBLE, 6) AS pair_recall,
 round(avg(CASE WHEN ntrue = 0 THEN (np = 0)::INT::DOUBLE END), 6) AS singleton_acc, sum(np - tp)::BIGINT AS fp, sum(ntrue - tp)::BIGINT AS fn, count(*) AS n_q FROM m"""


@query(f"WITH {LI_TRUTH}, {_EXCL.format('lt')}, {_ef_sql('ex')}, {_macro_sql('chosen', 'nt')}")
def expected_f_decision(spark: SparkSession, d: str) -> DataFrame:
    """The whole decision: owners, then subsets by expected F0.5, then the metric."""
    pairs, truth = li_truth(spark, d)
    return decide.macro_f05(decide.apply_rule(pairs, "p", "expected_f"), truth)


@query(f"WITH {DOC_TRUTH}, k AS ({_key_sql('doc', ['name'], 3, 30, 'k_name')}), pr AS (SELECT k.qi, k.pi, (t.qi IS NOT NULL)::INT AS label FROM k LEFT JOIN truth t ON k.qi = t.qi AND k.pi = t.pi), nt AS (SELECT id qi, count(t.pi) AS ntrue FROM doc LEFT JOIN truth t ON t.qi = id WHERE is_q GROUP BY 1), {_macro_sql('pr', 'nt')}")
def macro_f05(spark: SparkSession, d: str) -> DataFrame:
    r = doc(spark, d)
    truth = doc_truth(r)
    return decide.macro_f05(audit.labelled(key_pass_name(spark, d).select("qi", "pi"), truth), tables.truth_counts(r.where("is_q").select(F.col("id").alias("qi")), truth))


_GRID = (0.2, 0.4, 0.6, 0.8)


@query(f"""WITH {LI_TRUTH}, {_EXCL.format('lt')}, b AS (SELECT 0 AS excl, qi, p, label FROM lt UNION ALL SELECT 1, qi, p, label FROM ex), g AS (SELECT excl, t, qi, sum(label) tp, count(*) np FROM b, (VALUES {', '.join(f'({t}::DOUBLE)' for t in _GRID)}) v(t) WHERE p >= t GROUP BY 1, 2, 3),
 a AS (SELECT excl, t, nt.qi, ntrue, coalesce(tp, 0) tp, coalesce(np, 0) np FROM nt CROSS JOIN (SELECT DISTINCT excl, t FROM g) LEFT JOIN g USING (excl, t, qi)) SELECT excl, t, round(avg({_F05}), 6) AS macro_f05 FROM a GROUP BY 1, 2""")
def rule_grid(spark: SparkSession, d: str) -> DataFrame:
    pairs, truth = li_truth(spark, d)
    return decide.rule_grid(pairs, truth, "p", list(_GRID))


_SWEEP_ALL = f"""a1 AS (SELECT c.cfg, nt.qi, ntrue, coalesce(tp, 0) tp, coalesce(np, 0) np FROM nt CROSS JOIN (SELECT cfg FROM c1) c LEFT JOIN g1 ON g1.cfg = c.cfg AND g1.qi = nt.qi),
 m1 AS (SELECT cfg, round(avg({_F05}), 6) AS macro_f05 FROM a1 GROUP BY 1), b1 AS (SELECT excl, t FROM m1 JOIN c1 USING (cfg) ORDER BY macro_f05 DESC, cfg LIMIT 1)"""


def _sweep_sql() -> str:
    t, rel = decide.SWEEP_T, decide.SWEEP_REL
    first = ", ".join(f"({e * len(t) + i}, {e}, {x}::DOUBLE)" for e in (0, 1) for i, x in enumerate(t))
    n = 2 * len(t)
    finer = ", ".join(f"({n + i}, {k}, {r}::DOUBLE)" for i, (k, r) in enumerate((k, r) for k in range(-5, 6) for r in rel))
    n += 11 * len(rel)
    expected = ", ".join(f"({n + i}, {m}::DOUBLE, {b}::DOUBLE)" for i, (m, b) in enumerate((m, b) for m in decide.SWEEP_MISS for b in decide.SWEEP_BIAS))
    return f"""WITH {LI_TRUTH}, {_EXCL.format('lt')}, b AS (SELECT 0 AS excl, qi, pi, p, label FROM lt UNION ALL SELECT 1, qi, pi, p, label FROM ex), c1(cfg, excl, t) AS (VALUES {first}),
 g1 AS (SELECT cfg, qi, sum(label) tp, count(*) np FROM b JOIN c1 USING (excl) WHERE p >= t GROUP BY 1, 2), {_SWEEP_ALL},
 own AS (SELECT b.*, max(p) OVER (PARTITION BY qi) AS top FROM b WHERE excl = (SELECT excl FROM b1)), c2(cfg, k, rel) AS (VALUES {finer}), c3(cfg, miss, bias) AS (VALUES {expected}),
 x1 AS (SELECT *, row_number() OVER o AS k, sum(p) OVER (o ROWS UNBOUNDED PRECEDING) AS hits, sum(p) OVER (PARTITION BY qi) AS tot,
  CASE WHEN max(p) OVER (PARTITION BY qi) >= 1 THEN 0 ELSE exp(sum(CASE WHEN p < 1 THEN ln(1 - p) END) OVER (PARTITION BY qi)) END AS none FROM own WHERE p > 0.01 WINDOW o AS (PARTITION BY qi ORDER BY p DESC, pi)),
 x2 AS (SELECT *, round(1.25 * hits / (k + 0.25 * (tot + miss)), 12) AS ef FROM x1, c3), x3 AS (SELECT *, max(ef) OVER (PARTITION BY qi, cfg) AS best FROM x2),
 x4 AS (SELECT *, min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY qi, cfg) AS kstar FROM x3),
 g2 AS (SELECT cfg, qi, sum(label) tp, count(*) np FROM (SELECT cfg, qi, label FROM own, c2 WHERE p >= round((SELECT t FROM b1) + c2.k / 100.0::DOUBLE, 2) AND p >= rel * top
  UNION ALL SELECT cfg, qi, label FROM x4 WHERE k <= kstar AND best > bias * none) GROUP BY 1, 2),
 a2 AS (SELECT c.cfg, nt.qi, ntrue, coalesce(tp, 0) tp, coalesce(np, 0) np FROM nt CROSS JOIN (SELECT cfg FROM c2 UNION ALL SELECT cfg FROM c3) c LEFT JOIN g2 ON g2.cfg = c.cfg AND g2.qi = nt.qi),
 m AS (SELECT cfg, macro_f05 FROM m1 UNION ALL SELECT cfg, round(avg({_F05}), 6) FROM a2 GROUP BY 1) SELECT cfg, macro_f05, (row_number() OVER (ORDER BY macro_f05 DESC, cfg) = 1)::INT AS best FROM m"""


@query(_sweep_sql())
def decision_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All 94 rules of the search, the best one marked."""
    pairs, truth = li_truth(spark, d)
    return decide.sweep(pairs, truth, "p").select("cfg", "macro_f05", "best")


_AGG = (", ".join(f"coalesce(max(p) FILTER (r = {k}), 0) AS top{k}" for k in range(1, 6)) + ", count(*) AS n_cand, round(sum(p), 6) AS sum_p, "
        + ", ".join(f"sum((p > {t})::INT)::BIGINT AS {n}" for t, n in ((0.5, "n_05"), (0.8, "n_08"), (0.95, "n_095")))
        + ", round(sum(ln(greatest(1 - p, 1e-6))), 6) AS log_p0, sum(ex)::BIGINT AS n_ex, round(sum(p * ex), 6) AS sum_p_ex, sum((p > 0.5 AND ex = 1)::INT)::BIGINT AS n_05_ex,"
        + " round(sum(ln(greatest(1 - p * ex, 1e-6))), 6) AS log_p0_ex, max(ex) FILTER (r = 1) AS top1_survives_ex")


@query(f"WITH {LI}, r AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pi) AS r, (row_number() OVER (PARTITION BY pi ORDER BY p DESC, qi) = 1)::INT AS ex FROM li) SELECT qi, {_AGG} FROM r GROUP BY qi")
def entity_aggregates(spark: SparkSession, d: str) -> DataFrame:
    a = decide.aggregates(li(spark, d), "p", li(spark, d))
    rounded = ("sum_p", "log_p0", "sum_p_ex", "log_p0_ex")
    return a.select("qi", *(c for c in decide.ENTITY_FEATURES if c not in rounded), *_r(*rounded))


_VOTES = LI + ", a AS (SELECT qi, pi FROM li WHERE p >= 0.5), b AS (SELECT qi, pi FROM li WHERE score > 20000), c AS (SELECT qi, pi FROM li WHERE (qi + pi) % 3 = 0)"


def _votes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = li(spark, d)
    return x.where("p >= 0.5"), x.where("score > 20000"), x.where("(qi + pi) % 3 = 0")


for _rule, _sql in {
    "e04": "SELECT * FROM a", "majority": "SELECT qi, pi FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1, 2 HAVING count(*) >= 2",
    "e04_and_any": "SELECT * FROM a SEMI JOIN (SELECT * FROM b UNION SELECT * FROM c) USING (qi, pi)", "e02_and_s3": "SELECT * FROM b INTERSECT SELECT * FROM c",
    "e02_and_e04": "SELECT * FROM a INTERSECT SELECT * FROM b", "all_three": "SELECT * FROM a INTERSECT SELECT * FROM b INTERSECT SELECT * FROM c"}.items():
    QUERIES[f"vote_{_rule}"] = lambda spark, d, rule=_rule: decide.ensemble(*_votes(spark, d), rule)
    ORACLE_SQL[f"vote_{_rule}"] = f"WITH {_VOTES} {_sql}"


@query(f"WITH {_VOTES} SELECT count(*) AS n, count(b.qi) AS \"both\", round(count(b.qi) / count(*)::DOUBLE, 6) AS share FROM a LEFT JOIN b ON a.qi = b.qi AND a.pi = b.pi")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _votes(spark, d)
    return audit.agreement(a, b)


@query(f"WITH {_VOTES}, x AS (SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT change, count(*) AS n, round(avg((pi % 2)::DOUBLE) * 100, 2) AS odd_share FROM x GROUP BY 1")
def diff_profile(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _votes(spark, d)
    return audit.added_removed(a, b).groupBy("change").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pi") % 2).cast("double")) * 100, 2).alias("odd_share"))


@query(f"WITH {LI}, l AS (SELECT qi, string_agg(pi::VARCHAR, ',' ORDER BY pi::VARCHAR) AS ids FROM (SELECT DISTINCT qi, pi FROM li WHERE p >= 0.5) GROUP BY 1) SELECT q.qi, coalesce(ids, '') AS matched_entity_ids FROM (SELECT DISTINCT qi FROM li) q LEFT JOIN l USING (qi)")
def list_sink_view(spark: SparkSession, d: str) -> DataFrame:
    x = li(spark, d)
    return tables.answer_lists(x.select("qi").distinct(), x.where("p >= 0.5"))


_DL = "dl AS (SELECT doc_id, lang, n_chars, length(text) - length(replace(text, '!', '')) AS bangs, quality FROM documents JOIN labels USING (doc_id))"


def _dl(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("bigint").alias("bangs"))
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query(f"WITH {_DL} SELECT doc_id, round((rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY lang), 6) AS n_chars_pct FROM dl")
def avg_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return decide.rank_percentile(_dl(spark, d), "n_chars", "lang").select("doc_id", *_r("n_chars_pct"))


@query(f"""WITH {_DL}, t AS (SELECT quality, 'n_chars' AS feature, n_chars::DOUBLE v FROM dl UNION ALL SELECT quality, 'bangs', bangs FROM dl), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS r FROM t),
 s AS (SELECT feature, sum(quality * r) rs, sum(quality)::DOUBLE p, count(*)::DOUBLE n FROM r GROUP BY 1) SELECT feature, round(greatest((rs - p * (p + 1) / 2) / (p * (n - p)), 1 - (rs - p * (p + 1) / 2) / (p * (n - p))), 6) AS auc FROM s""")
def feature_auc(spark: SparkSession, d: str) -> DataFrame:
    return decide.auc(_dl(spark, d), ["n_chars", "bangs"], "quality")


_CAUSE = f"""{PART}, pr AS (SELECT q.id qi, p.id pi, q.name = p.name AS same_name, q.brand = p.brand AS same_addr, p.addr AS addr_c, q.num1 = p.num1 AS num_eq, (q.name = p.name AND q.num1 = p.num1)::INT AS label
 FROM part_r q JOIN part_r p ON q.country = p.country AND q.is_q AND NOT p.is_q AND (q.name = p.name OR q.brand = p.brand))"""


def _cause(spark: SparkSession, d: str) -> DataFrame:
    r = part(spark, d)
    q = r.where("is_q").select(F.col("id").alias("qi"), "country", F.col("name").alias("nq"), F.col("brand").alias("bq"), F.col("num1").alias("mq"))
    p = r.where("not is_q").select(F.col("id").alias("pi"), "country", F.col("name").alias("nc"), F.col("brand").alias("bc"), F.col("num1").alias("mc"), F.col("addr").alias("addr_c"))
    # two equi-joins, not one on either key; the second leaves out what the first has found
    by_name = q.join(p, (q.country == p.country) & (F.col("nq") == F.col("nc"))).drop("country")
    by_brand = q.join(p, (q.country == p.country) & (F.col("bq") == F.col("bc"))).drop("country").where("nq <> nc")
    j = by_name.unionByName(by_brand).withColumns({"same_name": F.col("nq") == F.col("nc"), "same_addr": F.col("bq") == F.col("bc"), "num_eq": F.col("mq") == F.col("mc")})
    return j.withColumn("label", (F.col("same_name") & F.col("num_eq")).cast("int"))


@query(f"""WITH {_CAUSE} SELECT CASE WHEN same_name THEN 'same name' WHEN same_addr THEN 'same address' WHEN addr_c = '' THEN 'no candidate address'
 WHEN NOT num_eq THEN 'house number differs' ELSE 'other' END AS cause, count(*) AS n FROM pr WHERE label = 0 GROUP BY 1""")
def fp_cause(spark: SparkSession, d: str) -> DataFrame:
    return audit.fp_cause(_cause(spark, d))


@query(f"WITH {_CAUSE}, h AS (SELECT qi, pi, num_eq, max(num_eq::INT) OVER (PARTITION BY qi) AS s FROM pr WHERE same_name) SELECT qi, pi FROM h WHERE s = 1 AND NOT num_eq")
def hard_subgroup(spark: SparkSession, d: str) -> DataFrame:
    return audit.hard_subgroup(_cause(spark, d).where("same_name")).select("qi", "pi")


@query(f"WITH {DOC_TRUTH}, {_tfidf_sql(_WORDS)}, c AS ({_top_sql('comb', 2, 'qi', 'pi')}), k AS ({_key_sql('doc', ['name'], 1, 2, 'k_name')}), m AS (SELECT * FROM truth ANTI JOIN k USING (qi, pi)) SELECT CASE WHEN c.qi IS NULL THEN 'blocking' ELSE 'scoring' END AS lost_by, count(*) AS n FROM m LEFT JOIN c USING (qi, pi) GROUP BY 1")
def fn_split(spark: SparkSession, d: str) -> DataFrame:
    r = doc(spark, d)
    return audit.fn_split(doc_truth(r), blocking.top_k(_scored(spark, d, 2), "comb", 2), _key(r, "k_name", ["name"], (1, 2)))


@query(f"""WITH {LI}, x AS (SELECT qi, pi, round(1 - p, 2) AS pf, (score > 20000)::INT AS in_sample FROM li), m AS (SELECT avg(pf) AS mean FROM x WHERE in_sample = 0),
 f AS (SELECT qi, pi, in_sample, round(greatest(0, least(1, pf * {audit.TARGET} / mean)), 9) AS f FROM x, m),
 a AS (SELECT *, CASE WHEN in_sample = 1 AND f > {audit.LOSS} / ({audit.GAIN} + {audit.LOSS}) THEN 'remove' WHEN in_sample = 0 AND f < {audit.RESCUE} THEN 'rescue' WHEN in_sample = 1 THEN 'keep' ELSE 'leave' END AS action FROM f)
SELECT qi, pi, action, CASE action WHEN 'remove' THEN 1 WHEN 'rescue' THEN -1 ELSE 0 END * round(f * {audit.GAIN} - (1 - f) * {audit.LOSS}, 6) AS gain FROM a""")
def calibrated_removal(spark: SparkSession, d: str) -> DataFrame:
    x = li(spark, d).select("qi", "pi", F.round(1 - F.col("p"), 2).alias("pf"), (F.col("score") > 20000).cast("int").alias("in_sample"))
    return audit.calibrated_removal(x).select("qi", "pi", "gain", "action")


@query(f"WITH {_CAUSE}, t AS (SELECT DISTINCT pi FROM pr WHERE label = 1) SELECT CASE WHEN t.pi IS NULL THEN 'distractor' ELSE 'another query' END AS owner, count(*) AS n FROM pr LEFT JOIN t USING (pi) WHERE label = 0 GROUP BY 1")
def fp_owner(spark: SparkSession, d: str) -> DataFrame:
    pairs = _cause(spark, d)
    return audit.fp_owner(pairs, pairs.where("label = 1"))


@query(f"WITH {LI} SELECT qi, pi, score FROM li ORDER BY score DESC, qi, pi LIMIT 40")
def strongest_pairs(spark: SparkSession, d: str) -> DataFrame:
    return audit.strongest(li(spark, d), "score", 40).select("qi", "pi", "score")


@query("SELECT count(*) FILTER (q IS NULL) AS quality, count(*) FILTER (t IS NULL) AS toxic FROM (SELECT l.quality AS q, l.toxic AS t FROM documents LEFT JOIN labels l USING (doc_id))")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.null_counts(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "toxic"])


@query(f"""WITH {_VOTES}, q AS (SELECT DISTINCT qi FROM li WHERE qi % 5 <> 0), p AS (SELECT DISTINCT pi FROM li WHERE pi % 5 <> 0) SELECT 'unknown query' AS violation, count(*) AS n FROM a ANTI JOIN q USING (qi) UNION ALL SELECT 'unknown pool id', count(*) FROM a ANTI JOIN p USING (pi)
 UNION ALL SELECT 'repeated pair', count(*) FROM (SELECT 1 FROM a GROUP BY qi, pi HAVING count(*) > 1) UNION ALL SELECT 'not a candidate', count(*) FROM a ANTI JOIN b USING (qi, pi)
 UNION ALL SELECT 'several owners', count(*) FROM (SELECT pi FROM (SELECT DISTINCT qi, pi FROM a) GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated query', 0""")
def integrity_violations(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _votes(spark, d)
    x = li(spark, d)
    return audit.integrity(a.select("qi", "pi"), b.select("qi", "pi"), x.select("qi").distinct().where("qi % 5 <> 0"), x.select("pi").distinct().where("pi % 5 <> 0"))


@query(r"""WITH z AS (SELECT regexp_extract_all(lower(p_name), '[^\s,]+') AS a, regexp_extract_all(p_type, '[^\s,]+') AS b FROM part), e AS (SELECT unnest(a) AS x, unnest(b) AS y FROM (SELECT a, b FROM z WHERE len(a) = len(b) UNION ALL SELECT a[1:len(b)], b FROM z WHERE len(a) > len(b))),
 c AS (SELECT y, regexp_replace(x, '[^a-z0-9&]', '', 'g') AS x, count(*) n FROM e GROUP BY 1, 2) SELECT y, x, n FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY n DESC, x) AS r FROM c) WHERE r = 1 AND n >= 2""")
def learned_dictionary(spark: SparkSession, d: str) -> DataFrame:
    # names are cut to as many words as types have, so the two align
    t = table(spark, d, "part").select(F.lower("p_name").alias("n"), F.col("p_type").alias("b"))
    size = F.size(records.script_tokens(F.col("b")))
    a = F.array_join(F.slice(records.script_tokens(F.col("n")), 1, F.greatest(size, F.lit(1))), " ")
    return records.learned_words(t.select(a.alias("a"), "b"))


@query(f"WITH {DOC}, r AS (SELECT id, country, row_number() OVER (PARTITION BY country ORDER BY id) AS r, count(*) OVER (PARTITION BY country) AS n, count(*) OVER () AS total FROM doc) SELECT id, country FROM r WHERE r <= greatest(1, round(n * 300.0::DOUBLE / total))")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return records.stratified_sample(doc(spark, d).select("id", "country"), "country", ["id"], 300)


@query(f"WITH {LI} SELECT percentile AS q, v FROM (SELECT 0.5::DOUBLE AS percentile, round(quantile_cont(score, 0.5), 6) AS v FROM li UNION ALL SELECT 0.95, round(quantile_cont(score, 0.95), 6) FROM li UNION ALL SELECT 0.9, round(quantile_disc(p, 0.9), 6) FROM li)")
def score_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = li(spark, d).agg(F.array(*(F.struct(F.lit(a).alias("q"), F.round(F.expr(e), 6).alias("v")) for a, e in ((0.5, "percentile(score, 0.5)"), (0.95, "percentile(score, 0.95)"), (0.9, "percentile_disc(0.9) WITHIN GROUP (ORDER BY p)")))).alias("x"))
    return q.select(F.inline("x"))


# ---- pools of two models -------------------------------------------------------------------------------------------
@query(f"WITH {LI}, c AS (SELECT qi, pi, score FROM li WHERE p >= 0.3) SELECT qi, pi, score, 0 AS forced FROM c UNION ALL SELECT qi, pi, NULL, 1 FROM (SELECT qi, pi FROM li WHERE (qi + pi) % 3 = 0) ANTI JOIN c USING (qi, pi)")
def forced_candidates(spark: SparkSession, d: str) -> DataFrame:
    x = li(spark, d)
    return decide.with_forced(x.where("p >= 0.3").select("qi", "pi", "score"), x.where("(qi + pi) % 3 = 0"))


_POOL = LI_TRUTH + """, po AS (SELECT *, (row_number() OVER (PARTITION BY qi ORDER BY p DESC, pi) <= 2)::INT AS in_first,
 (row_number() OVER (PARTITION BY qi ORDER BY score DESC, pi) <= 2 OR (qi + pi) % 17 = 0)::INT AS in_second FROM lt), up AS (SELECT * FROM po WHERE in_first = 1 OR in_second = 1)"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    pairs, _ = li_truth(spark, d)
    return decide.union_pool(pairs.withColumn("forced", ((F.col("qi") + F.col("pi")) % 17 == 0).cast("int")), "p", "score", 2)


@query(f"WITH {_POOL} SELECT qi, pi, in_first, in_second FROM up")
def legacy_union_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d).select("qi", "pi", "in_first", "in_second")


@query(f"""WITH {_POOL} SELECT CASE WHEN in_first = 1 AND in_second = 0 THEN 'first only' WHEN in_first = 0 AND in_second = 1 THEN 'second only' ELSE 'both' END AS src, count(*) AS n, round(avg(label), 6) AS pos_rate,
 quantile_disc(round(p, 6), 0.5) AS p50, quantile_disc(round(p, 6), 0.9) AS p90, round(avg((p > 0.1 AND p < 0.9)::INT), 6) AS uncertain FROM up GROUP BY 1""")
def candidate_source(spark: SparkSession, d: str) -> DataFrame:
    return decide.candidate_source(_pool(spark, d), "p")


@query(f"""WITH {LI}, {_EXCL.format('li')}, z AS (SELECT qi, pi, p, (qi % 10) / 10.0::DOUBLE AS p_empty, row_number() OVER w AS k, sum(p) OVER w AS hits, greatest(0.5::DOUBLE, qi % 3 + 0.5::DOUBLE) AS size FROM ex WINDOW w AS (PARTITION BY qi ORDER BY p DESC, pi ROWS UNBOUNDED PRECEDING)),
 e AS (SELECT *, round(1.25::DOUBLE * hits / (k + 0.25::DOUBLE * size), 12) AS ef FROM z), b AS (SELECT *, max(ef) OVER (PARTITION BY qi) AS best FROM e), s AS (SELECT *, min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY qi) AS kstar FROM b)
SELECT qi, pi, p FROM s WHERE k <= kstar AND best > 1.2::DOUBLE * p_empty""")
def entity_decision(spark: SparkSession, d: str) -> DataFrame:
    x = li(spark, d)
    entity = x.select("qi").distinct().select("qi", (F.col("qi") % 10 / 10.0).alias("p_empty"), (F.col("qi") % 3 + 0.5).alias("n_hat"))
    return decide.entity_decide(x, "p", entity).select("qi", "pi", "p")


@query(f"""WITH {LI_TRUTH}, y AS (SELECT qi, sum(label) hit, count(*) n FROM lt GROUP BY 1) SELECT round(sum(hit) / sum(ntrue)::DOUBLE, 6) AS blocking_recall, round(avg(n), 6) AS avg_cands,
 round(quantile_cont(n, 0.95), 6) AS p95_cands, max(n) AS max_cands FROM nt JOIN y USING (qi)""")
def candidate_statistics(spark: SparkSession, d: str) -> DataFrame:
    pairs, truth = li_truth(spark, d)
    return decide.macro_f05(pairs.where("p >= 0.5"), truth, pairs).select("blocking_recall", "avg_cands", "p95_cands", "max_cands")


# ---- models --------------------------------------------------------------------------------------------------------
def _model_input(spark: SparkSession, d: str) -> DataFrame:
    pairs, _ = li_truth(spark, d)
    return decide.group_stats(pairs, "p", "s").withColumn("odd", F.col("pi") % 7)


@query()
def gbt_oof_stage1(spark: SparkSession, d: str) -> DataFrame:
    scored, _ = models.out_of_fold(_model_input(spark, d), ["p", "s_q_rank", "s_q_gap_2nd", "odd"], "stage1", models.matcher(3, 3), share=0.3)
    return scored.select("qi", "pi", "label", "stage1")


@query()
def entity_models(spark: SparkSession, d: str) -> DataFrame:
    pairs, truth = li_truth(spark, d)
    return models.entity_models(decide.aggregates(pairs, "p", truth), truth, decide.ENTITY_FEATURES)[0]


@query()
def lr_repair(spark: SparkSession, d: str) -> DataFrame:
    x = _model_input(spark, d)
    names = ["p", "s_q_rank", "s_q_gap_2nd", "odd"]
    return models._scored(models.precision_rule(x, names), models.assembled(x, names), "p_false").select("qi", "pi", "p_false")


# ---- the whole linkage ---------------------------------------------------------------------------------------------
def partx_truth(r: DataFrame) -> DataFrame:
    """Truth over normalised PARTX records: equal name and equal first number, give or take one, within a country."""
    k = r.where("name_core <> '' and addr_nums <> ''").select("id", "is_q", "country", "name_core", F.split("addr_nums", " ")[0].cast("int").alias("num"))
    q = k.where("is_q").select(F.col("id").alias("qi"), "country", "name_core", F.explode(F.array(*(F.col("num") + i for i in (-1, 0, 1)))).alias("num"))
    return q.join(k.where("not is_q").select(F.col("id").alias("pi"), "country", "name_core", "num"), ["country", "name_core", "num"]).select("qi", "pi")


@query()
def linkage_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Records to report: ten passes, pruning, all features, two matching stages, the search of a rule, macro F0.5.

    Trees are shallower and fewer than a production run's, the pairs and records whole.
    """
    r = linkage.normalized(_raw(spark, d))
    return linkage.train(r, partx_truth(r), linkage.Settings(stage0=(4, 8), matcher=(4, 8), share0=0.5, share=0.6)).report

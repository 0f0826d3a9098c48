import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from linkwright.functions import similarity as S
from linkwright.functions import text as T
from linkwright.operators import audit, blocking, decide, features, models, pools, records
from linkwright.plans import linkage
from linkwright.sources import staging, tables


def test_names_and_addresses(spark):
    df = spark.createDataFrame([("c0ok 5ervices lnc", "3744 TENTH STREET", "us"), (None, None, "us"), ("", "", ""), ("Café & Söhne d/b/a X", "12 St, Tennessee", "us")], "n string, a string, c string")
    out = df.select(T.name_core(F.col("n")), T.addr_nums(F.col("a"), F.col("c")), T.addr_state(F.col("a"), F.col("c")), T.name_alias(F.col("n"))).collect()
    assert tuple(out[0]) == ("cook services", "3744 10", "", "cook services")
    assert tuple(out[1]) == ("", "", "", "") and tuple(out[2]) == ("", "", "", "")
    assert out[3][2] == "tennessee" and out[3][3] == "cafe sohne|x"


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *_next(row, x, b)]
    return row[-1]


def _next(row, x, b):
    out, left = [], 0
    for j, y in enumerate(b):
        left = row[j] + 1 if x == y else max(left, row[j + 1])
        out.append(left)
    return out


def _partial(a, b):
    """Every stretch of the longer string, either way round if both are as long."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    cuts = lambda x, y: max(200 * _lcs(x, y[max(0, h - len(x)) : h]) / (len(x) + min(h, len(y)) - max(0, h - len(x))) for h in range(1, len(y) + len(x)))
    return max(cuts(a, b), cuts(b, a) if len(a) == len(b) else 0.0)


def test_similarities():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(9))) for _ in range(2))
        assert S.lcs(a, b) == _lcs(a, b)
        assert S.partial_ratio(a, b) == pytest.approx(_partial(a, b)) == pytest.approx(S.partial_ratio(b, a))
    assert S.ratio("", "") == 100 and S.token_set("", "") == 0 and S.token_set("a b", "b a c") == 100
    assert S.token_sort("b a", "a b") == 100 and S.partial_ratio("bc", "abcd") == 100
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)


def test_metric_and_owners(spark):
    pred = spark.createDataFrame([(1, 10, 1), (1, 11, 0), (1, 12, 1), (3, 30, 0)], "qi long, pi long, label int")
    truth = spark.createDataFrame([(1, 2), (2, 0), (3, 0)], "qi long, ntrue long")
    assert decide.macro_f05(pred, truth).first()["macro_f05"] == pytest.approx((0.7142857 + 1) / 3, abs=1e-6)
    own = decide.exclusive(spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.2), (2, 10, 0.5), (2, 12, 0.95)], "qi long, pi long, p double"), "p")
    assert {(r.qi, r.pi) for r in own.collect()} == {(1, 10), (1, 11), (2, 12)}


def test_expected_f_with_certain_pair(spark):
    out = decide.expected_f(spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.02), (2, 3, 0.02)], "qi long, pi long, p double"), "p")
    assert [(r.qi, r.pi) for r in out.collect()] == [(1, 1)]


def test_entity_decide_and_empty(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 3, 0.1)], "qi long, pi long, p double")
    e = spark.createDataFrame([(1, 0.01, 2.0), (2, 0.9, 0.1)], "qi long, p_empty double, n_hat double")
    assert {(r.qi, r.pi) for r in decide.entity_decide(s, "p", e).collect()} == {(1, 1), (1, 2)}
    none = s.where("false")
    assert decide.exclusive(none, "p").count() == 0 and audit.added_removed(none, none).count() == 0
    assert math.isclose(decide.aggregates(s, "p", e).where("qi = 1").first()["sum_p"], 1.7)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"x\\y\t\tUS\n', encoding="utf-8")
    row = tables.read_tsv(spark, str(tmp_path / "a.tsv")).first()
    assert tuple(row) == ("S1-1", '"x\\y', "", "US")
    pairs = tables.truth_pairs(spark.createDataFrame([("a", "c,b"), ("d", "")], "source1_entity_id string, matched_entity_ids string"))
    assert {tuple(r) for r in pairs.collect()} == {("a", "c"), ("a", "b")}
    lists = tables.answer_lists(spark.createDataFrame([(1,), (2,)], "qi long"), spark.createDataFrame([(1, 10), (1, 9), (1, 9)], "qi long, pi long"))
    assert {tuple(r) for r in lists.collect()} == {(1, "10,9"), (2, "")}


def test_transliteration(spark):
    words = spark.createDataFrame([("राम", "ram")], "y string, x string")
    df = spark.createDataFrame([("राम xyz",), ("plain",)], "n string")
    assert {r.n for r in records.transliterate(df, "n", words).collect()} == {"ram xyz", "plain"}


def test_entry_imports_without_llm(monkeypatch):
    import __spark_entry__ as e

    assert e._optional("linkwright.nothing.queries") is None and e._optional("no_such_module") is None
    assert "expected_f_decision" in e.queries()


def test_block_scores_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(c, i, i % 3 == 0, t, float(r.randrange(1, 9))) for c in "ab" for i in range(20) for t in r.sample("uvwxyz", 3)] + [("only queries", 99, True, "u", 1.0), ("only pool", 98, False, "u", 1.0)]
    post = spark.createDataFrame(rows, "country string, id long, is_q boolean, token string, w double")
    want = {}
    for c, i, q, t, w in rows:
        for c2, j, q2, t2, w2 in rows:
            if q and not q2 and (c, t) == (c2, t2):
                want[i, j, c] = want.get((i, j, c), 0.0) + w * w2
    for block in ((2, 3), (512, 4096)):
        got = blocking.scored_pairs(post, block=block).collect()
        assert sorted((x.qi, x.pi, x.score) for x in got) == sorted((i, j, s) for (i, j, _), s in want.items())
    assert blocking.scored_pairs(post.where("false")).count() == 0
    every = blocking.scored_pairs(post, block=(2, 3))
    for k, reverse in ((2, False), (3, True)):
        some = blocking.scored_pairs(post, *((None, k) if reverse else (k, None)), block=(64, 64), least_tasks=1)
        assert some.count() < every.count()
        best = [{tuple(x) for x in blocking.top_k(p, "s", k, reverse).collect()} for p in (some, every)]
        assert best[0] == best[1]


def test_similar_equals_scored_pairs_with_copies_and_shared_ids(spark, monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choices("abcdefghijklmnop", k=r.randrange(1, 9))) for _ in range(60)]
    rows = [(i, c, i % 4 == 0, r.choice(texts)) for i in range(400) for c in ("x", "y") if (i + (c == "y")) % 2]
    rows += [(8, "x", True, "a q q"), (9, "x", False, "a q"), (1000, "x", None, "a b"), (1001, "x", False, None), (1002, "x", True, ""), (1003, "only pool", False, "a"), (1004, None, True, "a")]
    records = spark.createDataFrame(rows, "id long, country string, is_q boolean, t string")
    tokens = blocking.words(F.col("t"))
    want = blocking.scored_pairs(blocking.weights(records.where("country is not null"), tokens, 150, 2)).toPandas().sort_values(["qi", "pi"])
    monkeypatch.setattr(blocking, "PACK", 300)
    monkeypatch.setattr(blocking, "CELLS", 200)
    for sizes in ({}, {"most": 7, "entries": 200}):
        got = blocking.similar(records, tokens, None, None, 150, 2, **sizes).toPandas().sort_values(["qi", "pi"])
        assert got[["qi", "pi"]].values.tolist() == want[["qi", "pi"]].values.tolist()
        assert got.score.tolist() == pytest.approx(want.score.tolist(), abs=1e-8)
        some = blocking.similar(records, tokens, 3, 2, 150, 2, **sizes)
        pairs = some.toPandas()
        assert len(pairs) < len(want) and not pairs.duplicated(["qi", "pi"]).any()
        for k, reverse in ((3, False), (2, True)):
            best = [sorted(tuple(x) for x in blocking.top_k(spark.createDataFrame(p), "s", k, reverse).collect()) for p in (pairs, want)]
            assert [x[:2] for x in best[0]] == [x[:2] for x in best[1]]


def test_kept_pairs_do_not_grow_with_the_rounds(spark):
    r = random.Random(7)
    rows = [(i, "x", i % 4 == 0, " ".join(r.choices("abcdefgh", k=6))) for i in range(480)]
    records = spark.createDataFrame(rows, "id long, country string, is_q boolean, t string").repartition(12, "id")
    tokens = blocking.words(F.col("t"))
    every = staging.staged(blocking.scored_pairs(blocking.weights(records, tokens)), "every")
    for forward, reverse in ((3, None), (None, 2), (3, 2)):
        some = blocking.similar(records, tokens, forward, reverse, entries=1)  # a round for each block of the pool
        if not reverse:
            assert some.count() <= 3 * 120 * (blocking.FEW + 1)
        for k, back in ((forward, False), (reverse, True)):
            best = [sorted((x.qi, x.pi, x[3]) for x in blocking.top_k(p, "s", k, back).collect()) for p in (some, every) if k]
            assert not k or best[0] == best[1]


def test_many_copies_are_multiplied_once():
    import numpy as np

    n, seen = 4000, []
    tokens, w, rows = np.tile(np.arange(3), n), np.full(3 * n, 3 ** -0.5), np.repeat(np.arange(n), 3)
    cls, entries = blocking._classes((tokens, w, rows), n)
    pool = blocking._Pool(np.arange(n), cls, entries)
    pool.scores, scores = lambda out, *a: (seen.append(out.shape), scores(out, *a)), pool.scores
    i, j, s = blocking._product(blocking._Side(np.arange(n), cls, entries), pool, 2, 1)
    assert seen == [(1, 1)] and len(s) == 2 * n + n - 2 and set(s) == {1.0}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted({(k, x) for k in range(n) for x in (0, 1)} | {(0, k) for k in range(n)})


def test_char_grams_short_empty_null_and_wide(spark):
    texts = [None, "", "abc", "ABCD", "aé\U0001f600bcd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", blocking.char_grams(F.col("t")).alias("g"))
    got = {x.i: x.g for x in df.collect()}
    for i, t in enumerate(texts):
        t = (t or "").lower()
        assert got[i] == [t[k : k + 4] for k in range(len(t) - 3)]


def test_gaps_to_the_best_and_second_best(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.6), (1, 12, 0.1), (2, 13, 0.5)], "qi long, pi long, s double")
    got = {r.pi: r for r in decide.group_stats(df, "s", "x").collect()}
    assert [got[k].x_q_gap_2nd for k in (10, 11, 12)] == pytest.approx([0.3, 0.0, -0.5]) and got[13].x_q_gap_2nd is None
    assert [got[k].x_q_gap_max for k in (10, 11, 12, 13)] == pytest.approx([0.0, -0.3, -0.8, 0.0])
    assert got[10].x_p_gap_2nd is None and got[10].x_p_gap_max == 0.0


def test_causes_of_false_pairs(spark):
    rows = [(1, 1, True, True, "x", False, 0), (1, 2, False, True, "x", False, 0), (1, 3, False, False, "", False, 0), (1, 4, False, False, "x", False, 0), (1, 5, False, False, "x", True, 0), (1, 6, True, True, "x", True, 1)]
    df = spark.createDataFrame(rows, "qi long, pi long, same_name boolean, same_addr boolean, addr_c string, num_eq boolean, label int")
    assert {tuple(r) for r in audit.fp_cause(df).collect()} == {(c, 1) for c in ("same name", "same address", "no candidate address", "house number differs", "other")}
    owners = audit.fp_owner(df, spark.createDataFrame([(9, 2), (9, 3)], "qi long, pi long"))
    assert {tuple(r) for r in owners.collect()} == {("another query", 2), ("distractor", 3)}


def test_repair_only_removes_from_the_answer_and_rescues_the_rest(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.8), (1, 2, 1, 0.01), (1, 3, 0, 0.8), (1, 4, 0, 0.01), (1, 5, 0, 0.5)], "qi long, pi long, in_sample int, pf double")
    got = {r.pi: r for r in audit.calibrated_removal(df).collect()}
    m = audit.TARGET / ((0.8 + 0.01 + 0.5) / 3)
    assert [got[k].action for k in range(1, 6)] == ["remove", "keep", "leave", "rescue", "leave"]
    assert got[1].gain == pytest.approx(0.8 * m * 0.2 - (1 - 0.8 * m) * 0.0625, abs=1e-6) and got[4].gain == pytest.approx((1 - 0.01 * m) * 0.0625 - 0.01 * m * 0.2, abs=1e-6)
    assert {r.pi for r in audit.repaired(audit.calibrated_removal(df)).collect()} == {2, 4}


def test_the_precision_rule_learns_false_pairs(spark):
    df = spark.createDataFrame([(i, i, float(i % 10 < 5), int(i % 10 < 5)) for i in range(200)], "qi long, pi long, p double, label int")
    x = models._scored(models.precision_rule(df, ["p"]), models.assembled(df, ["p"]), "p_false").collect()
    assert all((r.p_false > 0.5) == (r.label == 0) for r in x)
    assert "Predict: 1.0" in models.rule_tree(df, ["p"], 5).toDebugString


def test_entity_models_are_out_of_fold_and_kept_models_average(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 10 + k, 0.9 if (i % 2 and k < 2) else 0.1) for i in range(80) for k in range(4)], "qi long, pi long, p double")
    truth = df.select("qi").distinct().withColumn("ntrue", F.when(F.col("qi") % 2 == 1, 2).otherwise(0))
    agg = decide.aggregates(df, "p", truth)
    row = agg.where("qi = 1").first()
    assert (row.n_cand, row.top1, row.top3, row.top5, row.n_05, row.n_08, row.n_095, row.top1_survives_ex) == (4, 0.9, 0.1, 0.0, 2, 2, 0, 1)
    out, kept = models.entity_models(agg, truth, ["top1", "sum_p", "n_05"])
    got = {r.qi: r for r in out.collect()}
    assert len(got) == 80 and all((r.p_empty > 0.5) == (q % 2 == 0) for q, r in got.items()) and len(kept) == 2
    assert {r.qi for r in models.entity_mean(agg, ["top1", "sum_p", "n_05"], kept).collect()} == set(got)
    d = df.withColumn("label", (F.col("p") > 0.5).cast("int"))
    _, fitted = models.out_of_fold(d, ["p"], "s", models.matcher(2, 2))
    models.save_folds(fitted, str(tmp_path / "m"))
    a, b = (models.fold_mean(d, ["p"], "s", m).select("qi", "pi", "s").collect() for m in (fitted, models.load_folds(str(tmp_path / "m"))))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_answer_file_in_query_order_and_its_checks(spark, tmp_path):
    q = spark.createDataFrame([(1, 0, "S1-b"), (2, 1, "S1-a"), (3, 2, "S1-c")], "qi long, at long, entity_id string")
    names = spark.createDataFrame([(10, "S2-9"), (11, "S3-10")], "pi long, entity_id string")
    tables.write_lists(q, spark.createDataFrame([(1, 10), (1, 11), (1, 11), (3, 10)], "qi long, pi long"), names, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-b\tS2-9,S3-10\nS1-a\t\nS1-c\tS2-9\n"
    check = lambda path: {r.violation: r.n for r in audit.file_violations(tables.read_lines(spark, path), "matched_entity_ids", q, names).collect() if r.n}
    assert check(str(tmp_path / "out")) == {}
    (tmp_path / "bad.tsv").write_bytes(b"S1-b\tS2-9,S2-9\r\nS1-b\tS2-9, nan\nS1-x\tS1-b\nS1-a\n")
    found = check(str(tmp_path / "bad.tsv"))
    assert found["carriage return"] == 1 and found["header missing or repeated"] == 1 and found["not two columns"] == 1 and found["repeated query"] == 1
    assert found["bad id"] >= 1 and found["unknown query"] == 1 and found["missing query"] == 2 and found["wrong prefix"] >= 1


def test_stage_folders(spark, tmp_path):
    from linkwright.sources import staging

    df = spark.range(5)
    path = str(tmp_path / "stage")
    assert not staging.is_done(spark, path) and staging.resumed(df, path).count() == 5
    assert staging.resumed(spark.range(9), path).count() == 5 and staging.folder_bytes(spark, path) > 0
    staging.save_json(spark, {"t": 0.5, "x": "é"}, str(tmp_path / "rule"))
    assert staging.load_json(spark, str(tmp_path / "rule")) == {"t": 0.5, "x": "é"}
    for i in range(2):
        staging.log_line(spark, audit.scorecard(f"e{i}", {"f": i}, {}), str(tmp_path / "log"))
    assert sorted(r["experiment"] for r in staging.read_log(spark, str(tmp_path / "log"))) == ["e0", "e1"]
    assert tables.read_parts(spark, path, columns=["id"]).count() == 5
    staging.forget(spark, path)
    assert staging.folder_bytes(spark, path) == 0


def test_a_stage_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", disk.getAllBlocks().mkString(" ")))
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    rows = staging.staged(df, "freed")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.collect()))


def test_votes_of_kept_models_on_their_own_pool(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.7, 0.0, 0.9, 3), (1, 2, 0, 0.1, 0.2, 0.8, 2)], "qi long, pi long, in_second int, comb_score double, k_name_score double, L_s0 double, n_passes int").withColumn("s0", F.lit(0.5))
    row = pools.earlier_view(df).collect()
    assert [(r.pi, r.s0, r.n_passes) for r in row] == [(1, 0.9, 1)]
    votes = pools.earlier_votes(pools.earlier_view(df).select("qi", "pi", F.col("s0").alias("p")), {"rule": "threshold", "excl": 1, "t": 0.5, "rel": None})
    assert [tuple(r) for r in votes.collect()] == [(1, 1)]


def test_features_by_hand_and_by_brute_force(spark):
    rows = [(1, "S1-1", "Acme Tools Ltd", "12 Main St, Tennessee", "us", True), (2, "S2-2", "Acme Tool Inc d/b/a Best", "14 Main Street", "us", False), (3, "S3-3", "Other", "", "us", False)]
    r = records.normalize(spark.createDataFrame(rows, "id long, entity_id string, business_name string, business_address string, country string, is_q boolean"))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "qi long, pi long")
    got = {x.pi: x for x in features.corpus_features(features.pair_features(features.cheap_features(features.pair_view(pairs, r))), r).collect()}
    a, b = got[2], got[3]
    assert (a.legal_both, a.legal_eq, a.num_first_eq, a.num_first_lev, a.num_first_absdiff, a.is_s3, b.is_s3, b.a_empty_c, b.num_first_eq) == (1.0, 0.0, 0.0, 1, 2.0, 0.0, 1.0, 1.0, None)
    for x in (a, b):
        q, c = x.name_core_q, x.name_core_c
        assert x.n_ratio == pytest.approx(200 * _lcs(q, c) / (len(q) + len(c))) and x.n_pratio == pytest.approx(_partial(q, c)) and x.c_n_ratio == x.n_ratio
        assert x.n_alias_best == pytest.approx(max(S.token_sort(q, y) for y in x.name_alias_c.split("|")))
    assert a.n_tfidf > 0 and b.n_tfidf == 0 and a.n_freq_q == pytest.approx(math.log(2), abs=1e-6) and a.n_freq_rel_c == pytest.approx(math.log1p(5e5), abs=1e-6)
    d = {x.pi: x for x in features.diagnostics(features.pair_view(pairs, r)).collect()}
    assert (d[2].num_exact, d[2].num_missing, d[3].num_exact, d[3].num_missing, d[3].cand_addr_missing) == (0.0, 0.0, None, 1.0, 1.0)


def test_learned_components(spark):
    pairs = spark.createDataFrame([("a", "x")] * 5 + [("b", "x")] * 5 + [("b", "y")] * 2 + [("c", "x")], "y string, x string")
    assert [tuple(r) for r in records.learned_components(pairs).collect()] == [("a", "x", 5)]


def test_letters_beyond_latin_1(spark):
    df = spark.createDataFrame([("Łódź Černý Győr Şişli Đà Nẵng ıİ ß",)], "t string")
    assert df.select(T.ascii_fold(F.col("t"))).first()[0] == "Lodz Cerny Gyor Sisli Da Nang iI ss"


def test_other_scripts_become_latin(spark):
    words = {"नमस्ते भारत": "nmste bhart", "ગુજરાત": "gujrat", "ಕರ್ನಾಟಕ": "krnatk", "প্রাইভেট লিমিটেড": "praibhet limited", "१२३": "123", "Москва Щука": "Moskva Shchuka",
             "подъезд": "podezd", "Ελλάδα Αθήνα": "Ellada Athina", "Ќ": "K", "東京": "東京", "": "", "plain": "plain"}
    df = spark.createDataFrame([*words.items(), (None, None)], "t string, want string")
    assert [r for r in df.select(T.ascii_fold(F.col("t")).alias("got"), "want").collect() if r.got != r.want] == []


def test_similarities_of_many_pairs_are_those_of_one():
    random.seed(5)
    text = lambda: "".join(random.choice("aab cdé 😀1") for _ in range(random.choice([0, 1, 2, 5, 13, 40, 63, 64, 65, 90])))
    pairs = [(text(), text()) for _ in range(1500)] + [(x, x[random.randint(0, 3):random.randint(0, 60)]) for x in (text() for _ in range(300))]
    for one, many in S.MANY.items():
        assert many(pairs).tolist() == [one(a, b) for a, b in pairs] and not len(many([]))


def test_many_similarities_are_quicker_than_single_ones():
    pairs = [(f"{i % 50} brand {i % 23} street {i % 50}b 10 avenue", f"{i % 41} brand {i % 19} street {i % 41}b tenth avenue") for i in range(4000)]
    took = {}
    for f, run in (("one", lambda: [S.partial_ratio(a, b) for a, b in pairs]), ("many", lambda: S._all(*zip(*pairs), S.partial_ratio))):
        began = time.thread_time()
        run()
        took[f] = time.thread_time() - began
    assert took["many"] < took["one"] / 2


def test_fits_read_what_they_learn_from_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return float(x % 10)

    d = spark.range(400).select((F.col("id") / 4).cast("long").alias("qi"), F.col("id").alias("pi"), (F.col("id") % 10 > 6).cast("int").alias("label"), F.udf(counted, "double")("id").alias("p"))
    scored, fitted = models.out_of_fold(d, ["p"], "s", models.matcher(2, 2))
    assert seen.value <= 400 and len(fitted) == 2
    assert all((r.s > 0.5) == (r.label == 1) for r in scored.collect())


def test_a_small_file_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).selectExpr("id", "concat('S1-', id) entity_id", "'Acme Co' business_name", "'1 Main St' business_address", "'us' country", "id % 4 = 0 is_q").coalesce(1).write.parquet(str(tmp_path / "r"))
    raw = spark.read.parquet(str(tmp_path / "r"))
    assert raw.rdd.getNumPartitions() == 1
    assert records.dealt(raw).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert linkage.normalized(raw).count() == 100

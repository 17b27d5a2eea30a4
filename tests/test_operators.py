"""Small hand cases and brute-force comparisons for the operators."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from ringwatch.catalog import TBM_FEATURES
from ringwatch.functions import scoring, text
from ringwatch.functions.rounding import round_exact
from ringwatch.operators import binned, calibration, forest, kernel, reconstruction, triggers, windows
from ringwatch.operators.quantiles import exact_percentiles


def test_round_exact_is_python_round(spark):
    rng = random.Random(3)
    xs = [rng.uniform(-5, 5) for _ in range(500)] + [i / 1000 for i in range(-300, 300)] + [0.005, 0.5625, 2.675]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_exact(F.col("x"), 2).alias("r")).collect()
    assert all(r.r == round(r.x, 2) for r in rows)


def test_normal_cdf(spark):
    xs = [i / 50 for i in range(-500, 501)]
    df = spark.createDataFrame([(x,) for x in xs], "z double")
    for r in scoring.with_normal_cdf(df, {"c": "z"}).collect():
        assert abs(r.c - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-14


def test_valid_sensors(spark):
    rows = [(1.0, 2.0), (None, 2.0), (-1.0, 2.0), (float("nan"), 2.0), (1.0, float("inf")), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(scoring.valid_sensors(["a", "b"])).collect()]
    assert got == [True, False, False, False, False, True]


def test_clean_json_and_stratum_key(spark):
    cases = {'["a", null]': "a，None", '"x"': "x", "'y'": "y", "none": "-", "[z": "[z", '{"k": 1}': '{"k": 1}'}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.c for r in df.select("s", text.clean_json_value(F.col("s")).alias("c")).collect()}
    assert got == cases
    keys = spark.createDataFrame([("3.0",), ("3.5",), (" clay ",)], "s string").select(text.stratum_key(F.col("s")))
    assert [r[0] for r in keys.collect()] == ["3", "3_5", "clay"]


def test_exact_percentiles_with_hot_key(spark):
    rng = np.random.default_rng(5)
    data = [("hot", float(v)) for v in rng.lognormal(0, 3, 3000)] + [("cold", 1.0), ("cold", 2.0), ("cold", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.999}).collect()}
    hot = np.array([v for k, v in data if k == "hot"])
    assert math.isclose(got["hot"].a, np.quantile(hot, 0.5), rel_tol=1e-12)
    assert math.isclose(got["hot"].b, np.quantile(hot, 0.999), rel_tol=1e-12)
    assert got["cold"].n == 2 and got["cold"].a == 1.5


def _brute(items, n=3):
    def first_run(cut):
        start = None
        for i, (pri, _) in enumerate(items + [(0, 0.0)]):
            if pri >= cut and i < len(items):
                start = i if start is None else start
            else:
                if start is not None and i - start >= n:
                    return start, i
                start = None
        return None

    for cut in (4, 3):
        run = first_run(cut)
        if run:
            return cut, max(p for _, p in items[run[0] : run[1]])
    for pri in (2, 1):
        chosen = [p for q, p in items if q == pri]
        if chosen:
            return pri, max(chosen)
    return 1, max(p for _, p in items)


def test_ring_risk_across_slices(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for ring in range(40):
        items = [(rng.choice([1, 2, 3, 3, 4, 4, 4]), rng.randrange(100) / 100) for _ in range(rng.randrange(1, 60))]
        want[ring] = _brute(items)
        for i, (pri, p) in enumerate(items):
            rows.append(("s", ring, "clog", datetime(2024, 1, 1) + timedelta(seconds=i), i, pri, p))
    df = spark.createDataFrame(rows, "shield_id string, ring bigint, risk_type string, time timestamp_ntz, point_id bigint, priority int, probability double")
    for seconds in (1, 7, 10**6):
        got = {r.ring: (r.priority, r.probability) for r in triggers.ring_risk(df, 3, seconds).collect()}
        assert got == want


def test_windows_do_not_depend_on_slices_or_blocks(spark):
    rng = random.Random(2)
    rows = []
    for ring, n in ((1, 300), (2, 48), (3, 20)):
        for i in range(n):
            cells = [None if rng.random() < 0.2 else float(rng.randrange(50)) for _ in TBM_FEATURES]
            rows.append((ring, datetime(2024, 1, 1) + timedelta(seconds=i), i, *cells))
    df = spark.createDataFrame(rows, "ring bigint, time timestamp_ntz, point_id bigint, " + ", ".join(f"{f} double" for f in TBM_FEATURES))

    def run(seconds, block):
        out = windows.sliding_windows(df, ["ring"], TBM_FEATURES, seconds=seconds, block=block)
        return sorted((r.ring, r.window_idx, r.end_time, tuple(r.vals), tuple(r["mask"])) for r in out.collect())

    whole = run(10**6, 2048)
    assert len(whole) == (300 - 48) // 8 + 1 + 1 + 1
    assert run(9, 64) == whole


def test_kde_thresholds_reach_their_levels(spark):
    rng = np.random.default_rng(7)
    scores = rng.beta(2, 8, 400)
    df = spark.createDataFrame([("a", float(s)) for s in scores] + [("b", 0.5)] * 30 + [("c", 0.1)], "stratum string, risk_score double")
    got = {r.stratum: r for r in calibration.kde_thresholds(df, ["stratum"]).collect()}
    assert got["b"].status == "no dispersion" and got["c"].status == "too few scores"
    r = got["a"]

    def cdf(x):
        return float(np.mean([0.5 * math.erfc(-(x - s) / r.bandwidth / math.sqrt(2)) for s in scores]))

    base, mass = cdf(0.0), cdf(1.0) - cdf(0.0)
    for level, target in ((r.low, 0.95), (r.medium, 0.995), (r.high, 0.999)):
        assert abs((cdf(level) - base) / mass - target) < 1e-9
    assert r.low < r.medium < r.high


def test_forest_ranks_outliers_higher():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(256, 4))
    trees = [forest.grow_tree(x, np.random.default_rng(i)) for i in range(50)]
    width = max(len(t["feature"]) for t in trees)
    packed = {k: np.array([list(t[k]) + [-1 if k == "feature" else 0] * (width - len(t[k])) for t in trees]) for k in trees[0]}
    packed["norm"] = float(forest.mean_path(256))
    scores = forest.raw_scores(packed, np.vstack([np.zeros((1, 4)), np.full((1, 4), 9.0)]))
    assert 0 < scores[0] < scores[1] < 1


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    from ringwatch.sources.tables import read_delimited, split_by_kind

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.csv").write_text("\ufeffRING,a,b\n1,10,20\n2,11,21\n", encoding="utf-8")
    (tmp_path / "x" / "two.csv").write_text("b,RING,a\n22,3,12\n", encoding="utf-8")
    (tmp_path / "x" / "geo.csv").write_text("Ring_Index,Cluster_Label\n1,0\n", encoding="utf-8")
    rows = read_delimited(spark, f"{tmp_path}/x/[ot]*.csv", columns=["RING", "a", "b", "c"])
    got = sorted((r["RING"], r["a"], r["b"], r["c"], r["folder"], r["file_name"]) for r in rows.collect())
    assert got == [("1", "10", "20", None, "x", "one.csv"), ("2", "11", "21", None, "x", "one.csv"), ("3", "12", "22", None, "x", "two.csv")]
    machine, geology = split_by_kind(spark, f"{tmp_path}/x/*.csv")
    assert sorted(r["file_name"] for r in machine.collect()) == ["one.csv", "two.csv"]
    assert [r["file_name"] for r in geology.collect()] == ["geo.csv"]


def _kernel_levels(scores, h, xs):
    cdf = lambda x: sum(0.5 * math.erfc((s - x) / h / math.sqrt(2)) for s in scores) / len(scores)
    return [cdf(x) for x in xs]


def test_kernel_tables_equal_the_plain_sums(spark):
    rng = np.random.default_rng(3)
    scores = {"a": rng.beta(2, 5, 700), "b": np.concatenate([rng.normal(0.5, 1e-4, 400), rng.lognormal(0, 4, 300), [-1e9, 1e12]])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in scores.items() for v in vs], "k string, s double").repartition(5)
    asked = {("a",): (0.02, [0.0, 1.0, 0.3]), ("b",): (3e-5, [0.0, 1.0, 0.5, 0.5001])}
    tables = kernel.kernel_tables(df, ["k"], "s", asked)
    for (key,), (h, anchors) in asked.items():
        table = tables[key,]
        assert table.size == len(scores[key]) and len(table.centre) <= kernel.ANCHORS * 2 * (kernel.REACH + kernel.TAIL) / kernel.STEP + 5
        for x in [a + d * h for a in anchors for d in (-40, -3.3, 0, 0.26, 17, 63)]:
            want, step = _kernel_levels(scores[key], h, [x])[0], 1e-3 * h
            slope = (_kernel_levels(scores[key], h, [x + step])[0] - _kernel_levels(scores[key], h, [x - step])[0]) / (2 * step)
            got = table.at(x)
            assert abs(got[0] - want) < 1e-13 and abs(got[1] - slope) <= 1e-5 * max(abs(slope), 1.0)
    assert tables["b",].at(0.25) is None


def test_thresholds_of_narrow_and_odd_scores_hit_their_levels(spark):
    rng = np.random.default_rng(9)
    scores = {"wide": rng.beta(2, 5, 3000), "narrow": 0.4 + 1e-6 * rng.normal(size=500), "outside": rng.normal(3, 0.1, 100), "flat": np.full(50, 0.5),
              "few": rng.random(10), "tail": np.concatenate([rng.normal(0.3, 1e-5, 800), rng.random(60)])}
    rows = [(k, float(v)) for k, vs in scores.items() for v in vs] + [("wide", float("nan")), ("wide", None), ("wide", float("inf"))]
    df = spark.createDataFrame(rows, "k string, s double")
    found = calibration.kde_thresholds(df, ["k"], score="s")
    status = {r["k"]: r["status"] for r in found.collect()}
    assert status == {"wide": "ok", "narrow": "ok", "tail": "ok", "outside": "no mass in [0, 1]", "flat": "no dispersion", "few": "too few scores"}
    levels = calibration.threshold_levels(df, found, ["k"], "s").collect()
    assert len(levels) == 3
    for r in levels:
        assert all(abs(r[f"{k}_cdf"] - p) < 1e-9 for k, p in (("low", 0.95), ("medium", 0.995), ("high", 0.999)))


def _points(spark, rings, hole=7):
    rng = np.random.default_rng(1)
    rows = []
    for stratum, ring, n in rings:
        for i in range(n):
            values = [None if (i * 5 + k) % hole == 0 else float(rng.integers(0, 40) + 100 * k) for k in range(len(TBM_FEATURES))]
            rows.append((stratum, ring, datetime(2024, 1, 1) + timedelta(seconds=i), i, *values))
    return spark.createDataFrame(rows, "stratum string, ring long, time timestamp_ntz, point_id long, " + ", ".join(f"{f} double" for f in TBM_FEATURES))


def test_binned_medians_equal_those_of_all_window_cells(spark, monkeypatch):
    monkeypatch.setattr(binned, "BINS", 8)
    points = _points(spark, [("a", 1, 48), ("a", 2, 47), ("a", 3, 131), ("a", 4, 700), ("b", 1, 56)])
    smoothed = windows.smoothed_points(points, ["stratum", "ring"], TBM_FEATURES)
    cells = {}
    for r in windows.sliding_windows(points, ["stratum", "ring"], TBM_FEATURES).filter("NOT partial").collect():
        for at, (v, ok) in enumerate(zip(r["vals"], r["mask"])):
            if ok:
                cells.setdefault((r["stratum"], TBM_FEATURES[at // 48], at % 48), []).append(v)
    medians, spread = binned.cell_medians(smoothed, TBM_FEATURES)
    got = {tuple(r)[:3]: r["median"] for r in medians.collect()}
    assert got == {k: float(np.median(v)) for k, v in cells.items()}
    off = {tuple(r)[:3]: r["median"] for r in spread.collect()}
    assert off == {k: float(np.median(np.abs(np.array(v) - np.median(v)))) for k, v in cells.items()}


def test_trends_from_running_sums_and_from_batches_agree_with_plain_ones(spark):
    points = _points(spark, [("a", 1, 48), ("a", 2, 3), ("a", 3, 200), ("b", 1, 20)], hole=3)
    points = points.withColumn(TBM_FEATURES[0], F.lit(1e7 + 0.1))  # steady, high
    keys = ["stratum", "ring"]
    wins = {(r["stratum"], r["ring"], r["window_idx"]): r for r in windows.sliding_windows(points, keys, TBM_FEATURES).collect()}
    got = windows.point_trends(points, keys, TBM_FEATURES, block=64).collect()
    assert {(r["stratum"], r["ring"], r["window_idx"]) for r in got} == set(wins)
    for r in got:
        w = wins[r["stratum"], r["ring"], r["window_idx"]]
        assert (r["partial"], r["end_time"]) == (w["partial"], w["end_time"])
        batch = reconstruction.trend_matrix(np.array([w["vals"]]), np.array([w["mask"]]), TBM_FEATURES, 48)[0]
        for j, (t, f) in enumerate(zip(r["trends"], TBM_FEATURES)):
            i = [k for k in range(48) if w["mask"][48 * j + k]]
            y = [w["vals"][48 * j + k] for k in i]
            weight = {"thrust_spd": 1.5, "ch_spd": 0.7, "ch_torque": 0.7, "thrust_force": 1.5, "ch_contact_force": 1.5}[f]
            want = [weight * np.polyfit(i, y, 1)[0], weight * (y[-1] - y[0]), 0.0, weight * np.std(y)] if len(i) >= 3 else [0.0] * 4
            np.testing.assert_allclose(list(t), want, rtol=1e-7, atol=1e-7)
            np.testing.assert_allclose(batch[4 * j : 4 * j + 4], want, rtol=1e-7, atol=1e-7)


def test_stream_trigger_merges_batches_late_slices_and_late_points(spark, tmp_path):
    from ringwatch.operators.triggers import ring_risk
    from ringwatch.streaming import triggers as stream

    rng = random.Random(7)
    start, points = datetime(2024, 1, 1), []
    for ring, many in ((1, 400), (2, 30), (3, 6)):  # ring 1 holds most points and many slices
        for k in range(many):
            points.append(("s", ring, "clog", 1000 * ring + k, start + timedelta(minutes=20 * k + ring), rng.choice([1, 1, 2, 3, 4, 4, 4]), rng.randrange(100) / 100))
    schema = "shield_id string, ring long, risk_type string, point_id long, time timestamp_ntz, priority int, probability double"
    batches = [[], [], [], []]
    for at, p in enumerate(points):
        k = p[3] % 1000
        if p[1] == 1:
            batch = 2 if k % 23 == 5 else 3 if 90 <= k < 130 else 0 if k < 201 else 1  # late points, late slices, a border within a slice
        else:
            batch = at % 2
        batches[batch].append(p)
    folder = str(tmp_path / "trigger")
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        df = df.withColumn("slice", stream.time_slice(df, "time"))
        stream.advance(df, k, folder)
        if k == 1:
            stream.advance(df, k, folder)  # the same batch again
        seen = spark.createDataFrame([p for b in batches[: k + 1] for p in b], schema)
        want = sorted(map(tuple, ring_risk(seen).collect()), key=repr)
        got = stream.latest_results(spark, folder).select(*ring_risk(seen).columns)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_forest_samples_are_exact_and_independent_of_partitions(spark):
    from ringwatch.catalog import ModelConfig

    config = ModelConfig(trees=12, samples_per_tree=64)
    rng = np.random.default_rng(2)
    rows = [(s, k, rng.normal(size=3).tolist()) for s, n in (("big", 5000), ("small", 40), ("even", 64)) for k in range(n)] + [(None, 1, [0.0] * 3)]
    df = spark.createDataFrame(rows, "stratum string, seq long, vec array<double>")
    one = forest.fit_forest(df.coalesce(1), ["stratum", "seq"], config).collect()
    many = forest.fit_forest(df.repartition(13), ["stratum", "seq"], config).collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, many), key=repr)
    assert {(r["stratum"], r["sample_size"]) for r in one} == {("big", 64), ("small", 40), ("even", 64)} and len(one) == 36
    assert len({tuple(r["threshold"]) for r in one if r["stratum"] == "big"}) == 12


def _training_folders(root, strata, rings=24, points=60):
    """One machine and one geology file per stratum, as text."""
    from ringwatch.catalog import GEO_FEATURES

    rng = random.Random(3)
    for label in strata:
        folder = root / f"cluster_{label}"
        folder.mkdir()
        lines = ["Ring.No,time,point_id," + ",".join(TBM_FEATURES)]
        for ring in range(rings):
            for k in range(points):
                at = datetime(2024, 1, 1) + timedelta(seconds=1000 * ring + k)
                lines.append(f"{ring}.25,{at},{ring * points + k}," + ",".join(str(round(rng.gauss(50, 5), 3)) for _ in TBM_FEATURES))
        (folder / "tbm.csv").write_text("\n".join(lines) + "\n")
        head = "Ring_Index,Cluster_Label," + ",".join(GEO_FEATURES)
        (folder / "geo.csv").write_text("\n".join([head] + [f"{ring},{label}," + ",".join(str(ring % 5 + 1) for _ in GEO_FEATURES) for ring in range(rings)]) + "\n")


def test_training_from_files_checks_strata_and_models_come_back_from_their_store(spark, tmp_path):
    import pytest

    from ringwatch.catalog import ModelConfig
    from ringwatch.plans import reports, store, training

    (tmp_path / "data").mkdir()
    _training_folders(tmp_path / "data", ["0", "1", "7"])
    files = str(tmp_path / "data" / "*" / "*.csv")
    with pytest.raises(Exception, match="missing strata: 4"):
        training.training_input(spark, files, ["0", "4"])
    summary = reports.training_data_summary(spark, files, ["0", "1"]).collect()  # 7 is left out
    assert {r["stratum"] for r in summary} == {"0", "1"}
    fused = training.training_input(spark, files, ["0", "1"])
    assert fused.count() == 2 * 24 * 60
    config = ModelConfig(trees=5, samples_per_tree=32, components=4)
    models = training.train_models(fused, config)
    told = {(r["part"], r["stratum"]): r["rows"] for r in training.training_report(models, str(tmp_path / "report"), bins=10).collect()}
    assert {p for p, _ in told} == {"scores", "metrics", "histogram", "density"} and {g for _, g in told} == {"0", "1"}
    assert sum(n for (p, _), n in told.items() if p == "scores") == models.scores.count() and told["metrics", "0"] == 1
    saved = spark.read.parquet(str(tmp_path / "report" / "density"))
    assert saved.agg(F.sum("count")).first()[0] == models.scores.count()
    root = str(tmp_path / "models")
    assert store.latest_version(spark, root) is None
    assert store.save_models(models, root) == 1
    fresh = spark.newSession()
    again = store.load_models(fresh, root)
    assert again.config == config
    columns = models.scores.columns
    assert sorted(map(tuple, again.scores.select(columns).collect()), key=repr) == sorted(map(tuple, models.scores.collect()), key=repr)
    audit = store.audit_models(fresh, root).collect()
    assert len(audit) == 2 and all(r["count_ok"] and r["digest_ok"] and r["thresholds_ok"] for r in audit)
    told = store.stored_documents(fresh, root).collect()
    assert all(r["score_count"] == r["train_sequences"] + r["val_sequences"] + r["test_sequences"] for r in told)
    spark.createDataFrame([(1,)], "x int").write.json(f"{root}/version=2/documents")  # never completed
    assert store.latest_version(spark, root) == 1
    with pytest.raises(FileNotFoundError):
        store.load_models(spark, str(tmp_path / "nothing"))


def test_rows_without_a_time_are_cut_into_slices(spark):
    from ringwatch.operators.ordered import add_index, time_slice

    rng = random.Random(8)
    rows = []
    for i in range(9000):
        ring = 1 if i % 3 == 0 else 2 + i % 40
        at = None if i % 2 else datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(10**6))
        rows.append((ring, at, i - 300, None if rng.random() < 0.3 else float(rng.randrange(100))))
    rows.append((1, None, None, 5.0))
    df = spark.createDataFrame(rows, "ring bigint, time timestamp_ntz, point_id bigint, v double")
    slices = df.filter("ring = 1 AND time IS NULL").select(time_slice(df, span=256).alias("s")).groupBy("s").count().collect()
    assert len(slices) > 30 and max(r["count"] for r in slices) <= 256
    order = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or datetime.min, r[2] is not None, r[2] or 0))
    want, last, at = {}, None, 0
    for k, (ring, _, pid, v) in enumerate(order):
        if k == 0 or order[k - 1][0] != ring:
            last, at = 0.0, 0
        last = last if v is None else v
        want[ring, pid] = (at, last)
        at += 1
    got = {(r.ring, r.point_id): (r.idx, r.v_fill) for r in windows.fill_forward(df, ["ring"], ["v"]).collect()}
    assert got == want
    sliced = df.withColumn("_s", time_slice(df, span=64))
    numbered = add_index(sliced, ["ring"], "_s", [F.col("time").asc_nulls_last(), "point_id"]).collect()
    assert {(r.ring, r.point_id): r.idx for r in numbered} == {k: v[0] for k, v in want.items()}


def test_salted_ring_join_is_a_join(spark):
    from ringwatch.operators.joins import join_rings

    points = spark.createDataFrame([("s", 1 if i % 3 else i % 50, i) for i in range(3000)] + [("s", None, 9000)], "shield_id string, ring bigint, point_id bigint")
    rings = spark.createDataFrame([("s", r, r * 2) for r in range(0, 50, 2)] + [("s", 1, 7)], "shield_id string, ring bigint, x bigint")
    keys = ["shield_id", "ring"]
    for how in ("inner", "left", "left_semi"):
        own, plain = join_rings(points, rings, keys, how), points.join(rings, keys, how)
        assert own.columns == plain.columns
        assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert join_rings(points.drop("point_id"), rings, keys).count() == points.join(rings, keys).count()


def test_point_store_prunes_folders_and_row_groups(spark, tmp_path):
    from ringwatch.sources import point_store, tables

    rows = [(f"0{s}", ring, datetime(2024, 1, 1) + timedelta(hours=ring, seconds=i), 1000 * ring + i, float(i))
            for s in range(2) for ring in range(40) for i in range(200 if ring == 7 else 10)]
    rows += [("00", None, None, 1, 1.0), ("01", -3, datetime(2023, 12, 31), 2, 2.0)]
    points = spark.createDataFrame(rows, "shield_id string, ring bigint, time timestamp_ntz, point_id bigint, v double")
    path = str(tmp_path / "points")
    point_store.write_points(points, path, span=8)
    assert sorted(map(repr, point_store.read_points(spark, path).select(points.columns).collect())) == sorted(map(repr, points.collect()))
    part = point_store.read_points(spark, path, "01", 6, 17).select(points.columns)
    assert sorted(map(tuple, part.collect())) == sorted(r for r in rows if r[0] == "01" and r[1] is not None and 6 <= r[1] < 17)
    folders = {r[0].rsplit("/points/", 1)[-1].rsplit("/", 1)[0] for r in part.select(F.col("_metadata.file_path")).distinct().collect()}
    assert folders == {f"shield_id=01/ring_span={k}" for k in (0, 1, 2)}
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "ring_span" in plan.split("PartitionFilters")[1] and "GreaterThanOrEqual(ring,6)" in plan
    assert [r["ring"] for r in point_store.read_points(spark, path, start=-8, end=0).collect()] == [-3]

    history = str(tmp_path / "history")
    point_store.write_history(points.select("point_id", "time", "v"), history)
    found = tables.history_scan(point_store.read_history(spark, history), "2024-01-01", "2024-01-01")
    low, high = datetime(2023, 12, 31, 16), datetime(2024, 1, 1, 16)
    assert sorted(r["time"] for r in found.collect()) == sorted(r[2] for r in rows if r[2] is not None and low <= r[2] < high)
    assert "day" in found._jdf.queryExecution().toString().split("PartitionFilters")[1]
    assert point_store.read_history(spark, history).count() == len(rows)


def test_report_parts_per_ring_and_risk(spark):
    from ringwatch import catalog
    from ringwatch.plans import reports

    fields = catalog.key_parameter_fields()
    rows = [("a", ring, None if i == 3 else datetime(2024, 1, 1) + timedelta(hours=ring, seconds=i), 100 * ring + i, *[float(i) if i else None for _ in fields])
            for ring in range(9) for i in range(12)]
    points = spark.createDataFrame(rows, "shield_id string, ring bigint, time timestamp_ntz, point_id bigint, " + ", ".join(f"{f} double" for f in fields))
    report = spark.createDataFrame([("a", 8, "clog"), ("a", 0, "mud_cake"), ("b", 1, "clog")], "shield_id string, ring bigint, risk_type string")
    shields = spark.createDataFrame([("a", "P_a")], "shield_id string, project_code string")
    got = {(r.shield_id, r.ring): r for r in reports.with_request_parts(report, points, shields, sample=5).collect()}
    assert got["a", 8].project_code == "P_a" and got["b", 1].project_code is None and got["b", 1].key_parameters is None
    assert len(got["a", 0].key_parameters) == 5 and len(got["a", 8].key_parameters) == 30
    first = got["a", 8].key_parameters[0]
    assert first["time"] == "2024/1/1 11:0:0" or first["time"].startswith("2024/1/1 11:")
    own = catalog.RISKS["clog"].key_fields
    assert set(first["values"]) == {catalog.FIELD_LABELS[f] for f in own}
    assert all(v["value"] is None and v["unit"] == catalog.field_unit(f) for f, v in ((f, first["values"][catalog.FIELD_LABELS[f]]) for f in own))


def test_thresholds_must_rise_and_small_tables_alone_are_broadcast(spark):
    import pytest

    from ringwatch.operators import profiles
    from ringwatch.scratch import broadcast_if_small

    schema = "stratum string, low double, medium double, high double"
    good = spark.createDataFrame([("0", 0.1, 0.2, 1.0), ("1", 0.0, 0.5, 0.6)], schema)
    assert sorted(map(tuple, scoring.checked_thresholds(good).collect())) == sorted(map(tuple, good.collect()))
    for bad in ((0.1, 0.1, 0.2), (0.1, 0.2, 1.1), (-0.1, 0.2, 0.3), (0.1, float("nan"), 0.3), (0.1, 0.2, None)):
        with pytest.raises(Exception, match="rise strictly"):
            scoring.checked_thresholds(spark.createDataFrame([("5", *bad)], schema)).collect()
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hint(broadcast_if_small(spark.range(5), 5)) and not hint(broadcast_if_small(spark.range(6), 5))
    rows = [("a", 0.5, 1.0), ("a", 0.5, 3.0), ("a", 0.5, None), ("a", float("nan"), 1.0), ("b", 0.0, 0.0), ("b", 1.0, 1.0), ("b", 0.49, 0.51)]
    got = profiles.score_density(spark.createDataFrame(rows, "g string, ae_error double, if_anomaly double"), ["g"], bins=2).collect()
    assert sorted((r.g, r.x_bin, r.y_bin, r["count"], r.x_left, r.y_left) for r in got) == [
        ("a", 1, 0, 1, 0.5, 1.0), ("a", 1, 1, 1, 0.5, 2.0), ("b", 0, 0, 1, 0.0, 0.0), ("b", 0, 1, 1, 0.0, 0.5), ("b", 1, 1, 1, 0.5, 0.5)]

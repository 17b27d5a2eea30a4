"""What keeps training and windows in proportion to their input."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.operators import reconstruction, windows
from ringwatch.plans import training

TBM = catalog.TBM_FEATURES


def _fused(spark, rings):
    rng = np.random.default_rng(11)
    rows = []
    for stratum, ring, n in rings:
        for i in range(n):
            values = [None if (i * 5 + k) % 7 == 0 else float(rng.integers(0, 40) + 100 * k) for k in range(len(TBM))]
            rows.append((stratum, f"src{stratum}", ring, datetime(2024, 1, 1) + timedelta(seconds=i), len(rows), *values))
    names = ", ".join(f"{f} double" for f in TBM)
    points = spark.createDataFrame(rows, f"stratum string, data_source string, ring bigint, time timestamp_ntz, point_id bigint, {names}")
    return points.withColumns({f: F.col("ring") * 1.0 + k for k, f in enumerate(catalog.GEO_FEATURES)})


def test_wanted_windows_are_those_of_a_join(spark):
    fused = _fused(spark, [("0", 1, 300), ("0", 2, 48), ("0", 3, 20), ("1", 4, 130)])
    # unknown rings and windows, a null, and a window that two rows ask for
    asked = [("0", 1, 0, 1.0), ("0", 1, 7, 2.0), ("0", 1, 7, 3.0), ("0", 1, 31, 4.0), ("0", 1, 32, 5.0), ("0", 1, -1, 5.0), ("0", 2, 0, 6.0),
             ("0", 2, 1, 6.0), ("0", 3, 0, 7.0), ("0", 3, 1, 7.0), ("1", 9, 0, 8.0), ("1", 4, None, 9.0), (None, 4, 0, 9.0)]
    wanted = spark.createDataFrame([(s, f"src{s}", r, w, x) for s, r, w, x in asked], "stratum string, data_source string, ring bigint, window_idx bigint, weight double")
    keys = training.RING_KEYS
    for block in (64, 2048):
        cut = lambda **more: windows.sliding_windows(fused, keys, TBM, block=block, carry=catalog.GEO_FEATURES, **more)  # noqa: B023, E731
        want = cut().join(wanted, [*keys, "window_idx"])
        got = cut(wanted=wanted).select(*want.columns)
        assert got.count() == 6
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_scalers_read_the_points_twice(spark):
    fused = _fused(spark, [("0", r, 60) for r in range(1, 9)])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    training.scalers(fused.mapInArrow(counted, fused.schema)).collect()
    assert read.value <= 2 * fused.count()


def test_training_input_is_a_written_table(spark, tmp_path):
    for stratum in ("0", "1"):
        folder = tmp_path / f"area{stratum}"
        folder.mkdir()
        lines = [f"{r},2024-01-01 00:00:{i:02d},{r * 60 + i}," + ",".join(str(i % 9 + k) for k in range(len(TBM))) for r in range(1, 4) for i in range(5)]
        (folder / "tbm.csv").write_text("RING,time,point_id," + ",".join(TBM) + "\n" + "\n".join(lines) + "\n")
        (folder / "geo.csv").write_text(",".join(["Ring_Index", "Cluster_Label", *catalog.GEO_FEATURES]) + "\n" + "".join(f"{r},{stratum}" + ",1.5" * len(catalog.GEO_FEATURES) + "\n" for r in range(1, 4)))
    rows = training.training_input(spark, f"{tmp_path}/*/*.csv", ["0", "1"])
    assert rows.count() == 30
    assert rows.inputFiles() and all(f.endswith(".parquet") for f in rows.inputFiles())


@pytest.mark.parametrize("parts", [3, 40])
def test_moments_sent_do_not_grow_with_partitions(spark, parts):
    rng = np.random.default_rng(5)
    size, dim = 48, len(catalog.FEATURES) * 48
    cells, geo = len(TBM) * size, len(catalog.GEO_FEATURES)
    data = [("a", rng.normal(size=cells).tolist(), [True] * cells, rng.normal(size=geo).tolist(), 0, float(1 + i % 2)) for i in range(40)]
    rows = spark.createDataFrame(data, "stratum string, z array<double>, mask array<boolean>, gz array<double>, pad int, weight double").repartition(parts)
    fitted = reconstruction.fit_reconstruction(rows)
    got = fitted.collect()[0]
    x = np.array([[*z, *np.repeat(g, size)] for _, z, _, g, _, _ in data])
    w = np.array([r[5] for r in data])
    np.testing.assert_allclose(got["mean"], (w @ x) / w.sum(), atol=1e-9)
    found = np.array(got["components"]).reshape(-1, dim)
    centred = x - np.array(got["mean"])
    values = np.linalg.eigvalsh((centred * w[:, None]).T @ centred / w.sum())[::-1][: len(found)]
    np.testing.assert_allclose(found @ found.T, np.eye(len(found)), atol=1e-8)
    np.testing.assert_allclose(((centred @ found.T) ** 2 * w[:, None]).sum(axis=0) / w.sum(), values, rtol=1e-6)
    cores = spark.sparkContext.defaultParallelism
    assert parts <= cores or f"Coalesce {cores}" in fitted._jdf.queryExecution().toString()


def test_blocks_are_made_in_one_reading_and_serve_scalers_and_windows(spark):
    fused = _fused(spark, [("0", r, n) for r, n in enumerate((60, 20, 130, 300, 48, 70, 5, 90), 1)])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    once = training.point_blocks(fused.mapInArrow(counted, fused.schema))
    assert read.value == fused.count()
    rings = training.ring_table(fused)
    plain = sorted(map(str, training.scalers(fused).collect()))
    assert sorted(map(str, training.scalers(fused, blocks=once, rings=rings).collect())) == plain
    cut = sorted(map(str, training.windows_of(fused).collect()))
    assert sorted(map(str, training.windows_of(fused, blocks=once, rings=rings).collect())) == cut
    for block in (64, 2048):
        small = windows.point_blocks(fused, training.RING_KEYS, TBM, block=block)
        ends = [f"{f}{end}" for f in TBM for end in ("_s", "_ok")]
        columns = [*training.RING_KEYS, "idx", "n", *ends]
        got = windows.block_points(small, training.RING_KEYS, TBM, block).select(*columns)
        want = windows.smoothed_points(fused, training.RING_KEYS, TBM).select(*columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

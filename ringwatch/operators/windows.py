"""Fill, smoothing and sliding windows over the ordered points of a ring.

Rings may be of any length. Points get their position in the ring from time slices, then
move to blocks of consecutive positions with the few neighbours a block needs on either
side, so smoothing and window cutting see one bounded block at a time.

Machine features vary within a ring and are handled per point. Geology is constant within
a ring (one row per ring, zero-filled), so it stays one value per ring until vectors are
assembled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.catalog import ModelConfig
from ringwatch.operators import joins
from ringwatch.operators.ordered import SLICE_SECONDS, time_slice
from ringwatch.scratch import materialize

BLOCK = 2048


def sort_column(columns, candidates=None) -> str | None:
    """First sort column present among the accepted names."""
    return next((c for c in candidates or catalog.SORT_CANDIDATES if c in columns), None)


def order_by_time(df: DataFrame, candidates=None, tie: str = "point_id") -> tuple[DataFrame, list]:
    """Frame with its sort column parsed and the ordering to use; unreadable times sort last."""
    name = sort_column(df.columns, candidates)
    if name is None:
        return df, [F.col(tie)]
    quoted = F.col(f"`{name}`")
    if name != "POINT_NO" and df.schema[name].dataType.typeName() == "string":
        df = df.withColumn(name, quoted.try_cast("timestamp_ntz"))
    return df, [quoted.asc_nulls_last(), F.col(tie)]


def fill_forward(
    df: DataFrame,
    keys: list[str],
    features: list[str],
    seconds: int = SLICE_SECONDS,
    time_col: str = "time",
    tie: str = "point_id",
) -> DataFrame:
    """Add ring position ``idx``, ring size ``n`` and, per feature, ``<f>_fill`` and ``<f>_ok``.

    A missing value takes the last valid one of its ring, 0.0 before the first; ``_ok`` tells
    whether the value was measured.
    """
    part = [*keys, "_slice"]
    sliced = df.withColumn("_slice", time_slice(df, time_col, seconds, tie))
    order = Window.partitionBy(*part).orderBy(F.col(time_col).asc_nulls_last(), tie)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = [c for c in df.columns if c not in features]
    local = sliced.select(
        *kept,
        *features,
        "_slice",
        (F.row_number().over(order).cast("bigint") - 1).alias("_rn"),
        F.count(F.lit(1)).over(whole).alias("_size"),
        *[F.last(f, ignorenulls=True).over(so_far).alias(f"{f}_fill") for f in features],
    )
    # the last row of a slice carries its size and last valid values to the later slices
    tails = local.filter("_rn = _size - 1").select(*part, "_size", *[f"{f}_fill" for f in features])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *part,
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("n"),
        *[F.last(f"{f}_fill", ignorenulls=True).over(earlier).alias(f"{f}_carry") for f in features],
    )
    out = local.join(carried, part)
    return out.select(
        *kept,
        (F.col("_rn") + F.col("_before")).alias("idx"),
        "n",
        *[F.coalesce(f"{f}_fill", f"{f}_carry", F.lit(0.0)).alias(f"{f}_fill") for f in features],
        # told from the readings here, so that both uses of a slice send the same columns, in one shuffle
        *[F.col(f).isNotNull().alias(f"{f}_ok") for f in features],
    )


def _middle_of(values: list[Column]) -> Column:
    """Median of the present ones among a few columns (absent neighbours are NULL)."""
    ordered = F.sort_array(F.array(*values))
    absent = F.lit(0)
    for v in values:
        absent = absent + F.when(v.isNull(), 1).otherwise(0)
    present = F.lit(len(values)) - absent
    low = (absent + F.floor((present - 1) / 2)).cast("int")
    high = (absent + F.floor(present / 2)).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)) / F.lit(2.0)


def into_blocks(filled: DataFrame, reach_right: int, reach_left: int, block: int = BLOCK) -> DataFrame:
    """Copy each point to its block and, near a border, to the neighbour that needs it."""
    own = F.floor(F.col("idx") / block).cast("bigint")
    at = F.col("idx") % block
    targets = F.array(
        own,
        F.when((at < reach_right) & (own > 0), own - 1),
        F.when(at >= block - reach_left, own + 1),
    )
    return filled.withColumn("block", F.explode(F.filter(targets, lambda b: b.isNotNull())))


def smooth(blocked: DataFrame, keys: list[str], features: list[str], width: int) -> DataFrame:
    """Centred rolling median over the filled values, with fewer values at the ring's ends."""
    if width <= 1:
        return blocked.withColumns({f"{f}_s": F.col(f"{f}_fill") for f in features})
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    half = width // 2
    out = {}
    for f in features:
        c = F.col(f"{f}_fill")
        near = [F.lag(c, i).over(w) for i in range(half, 0, -1)] + [c] + [F.lead(c, i).over(w) for i in range(1, half + 1)]
        out[f"{f}_s"] = near
    # neighbours first, medians in a second step, so each lag is computed once
    staged = blocked.withColumns({f"{name}_{i}": v for name, near in out.items() for i, v in enumerate(near)})
    medians = {name: _middle_of([F.col(f"{name}_{i}") for i in range(len(near))]) for name, near in out.items()}
    return staged.withColumns(medians).drop(*[f"{name}_{i}" for name, near in out.items() for i in range(len(near))])


def smoothed_points(
    df: DataFrame,
    keys: list[str],
    features: list[str],
    width: int = 5,
    seconds: int = SLICE_SECONDS,
    block: int = BLOCK,
    time_col: str = "time",
) -> DataFrame:
    """Filled and smoothed points, one row per input point."""
    half = max(width // 2, 1)
    blocked = into_blocks(fill_forward(df, keys, features, seconds, time_col), half, half, block)
    rows = smooth(blocked, keys, features, width)
    return rows.filter(F.floor(F.col("idx") / block) == F.col("block")).drop("block")


def _lanes(features: list[str]) -> dict:
    """Lane names with their column and the blank that pads it: values ``v0..`` and measured ``m0..``."""
    lanes = {f"v{j}": (F.col(f"{f}_s"), F.lit(0.0)) for j, f in enumerate(features)}
    return lanes | {f"m{j}": (F.col(f"{f}_ok"), F.lit(False)) for j, f in enumerate(features)}


def point_blocks(
    df: DataFrame,
    keys: list[str],
    features: list[str],
    config: ModelConfig = ModelConfig(),
    seconds: int = SLICE_SECONDS,
    block: int = BLOCK,
    time_col: str = "time",
    asked: DataFrame | None = None,
) -> DataFrame:
    """Smoothed points as one row per block of a ring: an array per feature and kind, times in ``_t``.

    A block holds its own points and the neighbours that its windows need; ``_base`` is the position of the
    first one. With ``asked`` only the blocks named there are made. Written once (``scratch.stored``), the
    blocks serve :func:`sliding_windows` and :func:`block_points`.
    """
    size, half = config.window_points, config.smoothing_window // 2
    if block % config.window_stride or block < size:
        raise ValueError("block must be a multiple of the stride and hold a window")
    rows = df.select(*dict.fromkeys([*keys, time_col, "point_id", *features]))
    blocked = into_blocks(fill_forward(rows, keys, features, seconds, time_col), size + half, half, block)
    if asked is not None:
        blocked = blocked.join(asked.select(*keys, "block"), [*keys, "block"], "left_semi")
    points = smooth(blocked, keys, features, config.smoothing_window)
    lanes = _lanes(features)
    item = F.struct("idx", F.col(time_col).alias("t"), *[c.alias(name) for name, (c, _) in lanes.items()])
    # bounded: a block holds at most block + size + 2 * half points
    blocks = points.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(item)).alias("pts"), F.max("n").alias("n"))
    pad = (F.lit(size) - F.least(F.lit(size), F.col("n"))).cast("int")
    # a lane per feature, once for the block; a window is a slice of each
    return blocks.select(
        *keys, "n", "block", F.element_at("pts", 1)["idx"].alias("_base"), F.col("pts")["t"].alias("_t"),
        *[F.concat(F.array_repeat(blank, pad), F.col("pts")[name]).alias(f"_{name}") for name, (_, blank) in lanes.items()],
    )


def block_points(blocks: DataFrame, keep: list[str], features: list[str], block: int = BLOCK) -> DataFrame:
    """Points of the blocks, each once: ``keep``, ``idx``, ``n`` and, per feature, ``<f>_s`` and ``<f>_ok``."""
    own = F.col("block") * block
    pad = F.size("_v0") - F.size("_t")
    at = (own - F.col("_base") + 1 + pad).cast("int")
    many = F.least(F.lit(block), F.col("n") - own).cast("int")
    names = {f"{f}{end}": f"_{kind}{j}" for j, f in enumerate(features) for kind, end in (("v", "_s"), ("m", "_ok"))}
    zipped = F.arrays_zip(*[F.slice(lane, at, many).alias(name) for name, lane in names.items()])
    rows = blocks.filter(many > 0).select(*keep, "n", own.alias("_own"), F.posexplode(zipped).alias("_i", "p"))
    return rows.select(*keep, (F.col("_own") + F.col("_i")).alias("idx"), "n", *[F.col("p")[name].alias(name) for name in names])


def sliding_windows(
    df: DataFrame,
    keys: list[str],
    features: list[str],
    config: ModelConfig = ModelConfig(),
    seconds: int = SLICE_SECONDS,
    block: int = BLOCK,
    time_col: str = "time",
    carry: list[str] = (),
    wanted: DataFrame | None = None,
    blocks: DataFrame | None = None,
    rings: DataFrame | None = None,
) -> DataFrame:
    """Windows of every ring: ``window_idx``, ``end_time``, ``partial``, ``vals`` and ``mask``.

    ``vals`` and ``mask`` are feature-major, one window length per feature. A ring shorter
    than a window gives one right-aligned window padded with zeros (``partial``). ``carry``
    names columns that are constant within ``keys``. With ``wanted`` (keys, ``window_idx`` and any other
    columns) only the windows named there are built, one for each of its rows, with its other columns.
    ``blocks`` are those of the points (:func:`point_blocks`) and ``rings`` a row per ring with the columns
    to carry, where they are at hand.
    """
    size, stride = config.window_points, config.window_stride
    others, asked = [], None
    if wanted is not None:
        others = [c for c in wanted.columns if c not in (*keys, "window_idx")]
        begin = (F.col("window_idx") * stride).cast("bigint")
        asked = wanted.select(*keys, F.floor(begin / block).cast("bigint").alias("block"), F.struct(begin.alias("start"), *others).alias("w"))
        # bounded: a block has at most block / stride windows
        asked = materialize(asked.groupBy(*keys, "block").agg(F.collect_list("w").alias("asked")))
    laned = point_blocks(df, keys, features, config, seconds, block, time_col, asked) if blocks is None else blocks
    if carry:
        # a value per ring need not move with every point
        of_ring = df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carry]) if rings is None else rings.select(*keys, *carry)
        laned = joins.join_rings(laned, of_ring, keys, tie="block")
    short, first = F.col("n") < size, F.col("block") * block
    if wanted is None:
        last = F.least(first + (block - stride), F.col("n") - size)
        starts = F.when(short, F.when(F.col("block") == 0, F.array(F.lit(0).cast("bigint")))).when(
            last >= first, F.sequence(first, last, F.lit(stride).cast("bigint"))
        )
        cut = laned.withColumn("start", F.explode(starts))
    else:
        cut = laned.join(asked, [*keys, "block"]).withColumn("w", F.explode("asked")).withColumn("start", F.col("w.start"))
        cut = cut.filter((F.col("start") >= 0) & (F.col("start") <= F.greatest(F.col("n") - size, F.lit(0))))
    at = (F.col("start") - F.col("_base") + 1).cast("int")
    whole = lambda kind: F.concat(*[F.slice(f"_{kind}{j}", at, F.lit(size)) for j in range(len(features))])

    return cut.select(
        *keys,
        *carry,
        F.col("n").alias("ring_points"),
        (F.col("start") / stride).cast("bigint").alias("window_idx"),
        short.alias("partial"),
        F.get("_t", (at + F.least(F.lit(size), F.col("n")) - 2).cast("int")).alias("end_time"),
        whole("v").alias("vals"),
        whole("m").alias("mask"),
        *[F.col("w")[c].alias(c) for c in others],
    )


def normalize_masked(vals: Column, mask: Column, median: Column, mad: Column, clip: float) -> Column:
    """(x - median) / mad within +-clip where measured, else 0; a zero mad counts as 1."""
    cells = F.arrays_zip(vals.alias("x"), mask.alias("ok"), median.alias("mid"), mad.alias("dev"))

    def cell(c: Column) -> Column:
        dev = F.when(c["dev"] == 0, F.lit(1.0)).otherwise(c["dev"])
        z = (c["x"] - c["mid"]) / dev
        if clip > 0:
            z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
        return F.when(c["ok"], z).otherwise(F.lit(0.0))

    return F.transform(cells, cell)


def flat_weights(features=None, config: ModelConfig = ModelConfig()) -> list[float]:
    """Weight of every cell of a window vector."""
    names = features or catalog.FEATURES
    return [catalog.FEATURE_WEIGHTS.get(f, 1.0) for f in names for _ in range(config.window_points)]


def _trend(n: Column, sums: dict[str, Column], ends: Column, weight: float) -> Column:
    """struct(slope, delta, curvature, spread) from the sums over a window's measured positions, times the weight.

    Needs three measured positions, else all are 0; curvature is always 0.
    """
    xx = n * sums["ii"] - sums["i"] * sums["i"]
    xy = n * sums["iy"] - sums["i"] * sums["y"]
    yy = F.greatest(n * sums["yy"] - sums["y"] * sums["y"], F.lit(0.0))
    enough = n >= 3
    out = {
        "slope": F.when(enough & (xx / n > 1e-12), xy / xx * weight),
        "delta": F.when(enough, ends * weight),
        "curvature": F.lit(0.0),
        "spread": F.when(enough, F.sqrt(yy) / n * weight),
    }
    return F.struct(*[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in out.items()])


def point_trends(
    df: DataFrame,
    keys: list[str],
    features: list[str],
    config: ModelConfig = ModelConfig(),
    seconds: int = SLICE_SECONDS,
    block: int = BLOCK,
    time_col: str = "time",
) -> DataFrame:
    """``trends`` of the windows of every ring, one struct per feature, without building the windows.

    Points of a block carry running sums of n, i, i * i, y, i * y and y * y over measured values; a
    window is the difference of the rows at its two ends. Values are taken from the block's first one,
    so that a steady signal on a high level loses no digits.
    """
    size, stride = config.window_points, config.window_stride
    if block % stride or block < size:
        raise ValueError("block must be a multiple of the stride and hold a window")
    half = config.smoothing_window // 2
    rows = df.select(*dict.fromkeys([*keys, time_col, "point_id", *features]))
    blocked = into_blocks(fill_forward(rows, keys, features, seconds, time_col), size + half, half, block)
    points = smooth(blocked, keys, features, config.smoothing_window)
    order = Window.partitionBy(*keys, "block").orderBy("idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "block").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("block") * block
    points = points.select(
        *keys, "block", "idx", "n", F.col(time_col).alias("end_time"), (F.col("idx") - first).cast("double").alias("i"),
        *[F.when(F.col(f"{f}_ok"), F.col(f"{f}_s") - F.first(f"{f}_s").over(so_far)).alias(f"y{j}") for j, f in enumerate(features)],
    )
    i = F.col("i")
    sums = {}
    for j in range(len(features)):
        y = F.col(f"y{j}")
        measured = F.when(y.isNotNull(), i)
        sums |= {f"n{j}": F.when(y.isNotNull(), 1.0), f"i{j}": measured, f"ii{j}": measured * i, f"y{j}": y, f"iy{j}": i * y, f"yy{j}": y * y}
    run = F.struct(*[F.coalesce(F.sum(c).over(so_far), F.lit(0.0)).alias(k) for k, c in sums.items()])
    last = F.struct(*[F.last(f"y{j}", ignorenulls=True).over(so_far).alias(f"y{j}") for j in range(len(features))])
    ahead = F.struct(*[F.last(f"y{j}", ignorenulls=True).over(back).alias(f"y{j}") for j in range(len(features))])
    opening = F.struct(*[F.first(f"y{j}", ignorenulls=True).over(so_far).alias(f"y{j}") for j in range(len(features))])
    points = points.select(*keys, "block", "idx", "n", "end_time", run.alias("run"), last.alias("last"), ahead.alias("ahead"), opening.alias("opening"))
    points = points.withColumns({"before": F.lag("run", size).over(order), "ahead": F.lag("ahead", size - 1).over(order)})
    start = F.col("idx") - (size - 1)
    whole = (F.col("n") >= size) & (start >= 0) & (start % stride == 0) & (F.floor(start / block) == F.col("block"))
    partial = (F.col("n") < size) & (F.col("idx") == F.col("n") - 1)
    ends = points.filter(whole | partial)

    def trend(j: int, feature: str) -> Column:
        part = {k: F.col("run")[f"{k}{j}"] - F.coalesce(F.col("before")[f"{k}{j}"], F.lit(0.0)) for k in ("n", "i", "ii", "y", "iy", "yy")}
        opened = F.when(F.col("n") < size, F.col("opening")[f"y{j}"]).otherwise(F.col("ahead")[f"y{j}"])
        return _trend(part["n"], part, F.col("last")[f"y{j}"] - opened, catalog.FEATURE_WEIGHTS.get(feature, 1.0))

    return ends.select(
        *keys,
        F.col("n").alias("ring_points"),
        F.when(F.col("n") < size, F.lit(0)).otherwise(start / stride).cast("bigint").alias("window_idx"),
        (F.col("n") < size).alias("partial"),
        "end_time",
        F.array(*[trend(j, f) for j, f in enumerate(features)]).alias("trends"),
    )


def trend_interactions(windows: DataFrame, features: list[str]) -> DataFrame:
    """Add ``interactions``: weighted products of slopes and of deltas for each feature pair."""
    pairs = []
    for a, fa in enumerate(features):
        for b in range(a + 1, len(features)):
            weight = catalog.FEATURE_WEIGHTS.get(fa, 1.0) * catalog.FEATURE_WEIGHTS.get(features[b], 1.0)
            for part in ("slope", "delta"):
                left, right = F.col("trends")[a][part], F.col("trends")[b][part]
                pairs.append(F.lit(weight) * left * right)
    return windows.withColumn("interactions", F.array(*pairs))

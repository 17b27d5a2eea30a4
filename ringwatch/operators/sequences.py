"""Ring splits and multi-ring sequences.

A sequence is six window references, one per ring. Window vectors are never copied into
sequences: window-level results are joined to the references instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwatch.catalog import ModelConfig
from ringwatch.operators.ordered import add_index, ring_slice
from ringwatch.scratch import materialize

WINDOW_CHUNK = 4096
SPLIT_SEED_OFFSET = {"train": 11, "val": 17, "test": 23}


def _cut(n: Column, share: float) -> Column:
    return F.floor(n.cast("double") * F.lit(share)).cast("bigint")


def split_rings(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Label each distinct ring of a source train, val or test by its rank (60/20/20)."""
    sliced = rings.withColumn("_s", ring_slice(F.col("ring")))
    indexed = add_index(sliced, keys, "_s", ["ring"], "ring_idx", total="ring_count").drop("_s")
    n = F.col("ring_count")
    train_end = F.greatest(F.lit(1), _cut(n, 0.6))
    val_end = F.greatest(train_end, _cut(n, 0.8))
    val_end = F.when((n >= 3) & (val_end == train_end), F.least(n - 1, train_end + 1)).otherwise(val_end)
    split = F.when(F.col("ring_idx") < train_end, "train").when(F.col("ring_idx") < val_end, "val").otherwise("test")
    return indexed.withColumn("split", split)


def split_by_position(index: Column, n: Column) -> Column:
    """Temporal split of n ordered sequences, used where rings alone cannot be split."""
    train_end = F.greatest(F.lit(1), _cut(n, 0.6))
    val_end = F.greatest(train_end + 1, _cut(n, 0.8))
    val_end = F.when(val_end >= n, n - 1).otherwise(val_end)
    by_share = F.when(index < train_end, "train").when(index < val_end, "val").otherwise("test")
    small = F.when(index == 0, "train").otherwise("val")
    return F.when(n <= 2, small).otherwise(by_share)


def usable_rings(ring_counts: DataFrame, keys: list[str], config: ModelConfig = ModelConfig()) -> DataFrame:
    """Rings that offer windows, indexed in order, with ``windows`` and ``is_latest``.

    ``ring_counts`` has keys, ring and ring_points. A ring shorter than a window offers one
    padded window unless it is the latest of its group.
    """
    size, stride = config.window_points, config.window_stride
    latest = ring_counts.groupBy(*keys).agg(F.max("ring").alias("_latest"))
    n = F.col("ring_points")
    full = F.floor((n - size) / stride).cast("bigint") + 1
    is_latest = F.col("ring") == F.col("_latest")
    windows = F.when(n >= size, full).when(~is_latest & (n > 0), F.lit(1).cast("bigint")).otherwise(0)
    rings = (
        ring_counts.join(latest, keys)
        .select(*keys, "ring", windows.alias("windows"), is_latest.alias("is_latest"))
        .filter("windows > 0")
        .withColumn("_s", ring_slice(F.col("ring")))
    )
    return add_index(rings, keys, "_s", ["ring"], "usable_idx").drop("_s")


def ring_groups(usable: DataFrame, keys: list[str], config: ModelConfig = ModelConfig()) -> DataFrame:
    """Groups of six usable rings in a row, with the number of sequences each yields.

    A group ending in the latest ring follows that ring's windows; others stop at the
    shortest ring of the group.
    """
    k = config.rings_per_sequence
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.struct(s.alias("step"), (F.col("usable_idx") - s).alias("group_idx"))))
    members = usable.select(*keys, "ring", "windows", "is_latest", steps.alias("m")).select(
        *keys, "ring", "windows", "is_latest", "m.step", "m.group_idx"
    )
    groups = (
        members.filter((F.col("group_idx") >= 0) & (F.col("group_idx") % config.sequence_stride == 0))
        .groupBy(*keys, "group_idx")
        .agg(
            F.count(F.lit(1)).alias("_members"),
            F.sort_array(F.collect_list(F.struct("step", "ring", "windows"))).alias("rings"),
            F.min("windows").alias("_min"),
            F.max(F.when(F.col("step") == k - 1, F.col("windows"))).alias("_last"),
            F.max(F.when(F.col("step") == k - 1, F.col("is_latest"))).alias("_ends"),
            F.max(F.when(F.col("step") == k - 1, F.col("ring"))).alias("end_ring"),
        )
        .filter(F.col("_members") == k)
    )
    return groups.select(
        *keys, "group_idx", "end_ring", "rings", F.when(F.col("_ends"), F.col("_last")).otherwise(F.col("_min")).alias("sequences")
    )


def sequences(groups: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sequence with its position among the group's windows.

    A ring may have very many windows, so the window numbers are spread in chunks before
    they are listed.
    """
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("sequences") - 1) / WINDOW_CHUNK).cast("bigint")))
    chunked = groups.filter("sequences > 0").withColumn("_chunk", chunks)
    low = F.col("_chunk") * WINDOW_CHUNK
    high = F.least(low + (WINDOW_CHUNK - 1), F.col("sequences") - 1)
    return (
        chunked.repartition(*keys, "group_idx", "_chunk")
        .withColumn("window_idx", F.explode(F.sequence(low, high)))
        .drop("_chunk")
    )


def sequence_steps(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """Six window references per sequence; shorter rings repeat their last window."""
    step = F.explode("rings").alias("s")
    return seqs.select(*keys, "group_idx", "window_idx", "end_ring", step).select(
        *keys,
        "group_idx",
        "window_idx",
        "end_ring",
        F.col("s.step").alias("step"),
        F.col("s.ring").alias("ring"),
        F.least(F.col("window_idx"), F.col("s.windows") - 1).alias("step_window_idx"),
    )


def number_sequences(seqs: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``seq_no`` (group order, then window order) and ``seq_count`` per key."""
    sliced = groups.select(*keys, "group_idx", "sequences").withColumn("_s", ring_slice(F.col("group_idx")))
    part = [*keys, "_s"]
    inside = Window.partitionBy(*part).orderBy("group_idx").rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("_in", F.coalesce(F.sum("sequences").over(inside), F.lit(0)))
    totals = sliced.groupBy(*part).agg(F.sum("sequences").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *part,
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_b"),
        F.sum("_t").over(Window.partitionBy(*keys)).alias("seq_count"),
    )
    offsets = local.join(totals, part).select(*keys, "group_idx", (F.col("_in") + F.col("_b")).alias("_first"), "seq_count")
    return seqs.join(offsets, [*keys, "group_idx"]).withColumn("seq_no", F.col("_first") + F.col("window_idx")).drop("_first")


def build_sequences(ring_counts: DataFrame, keys: list[str], config: ModelConfig = ModelConfig()) -> DataFrame:
    """Numbered sequences of every group of rings in ``ring_counts``."""
    groups = ring_groups(usable_rings(ring_counts, keys, config), keys, config)
    return number_sequences(sequences(groups, keys), groups, keys)


def split_sequences(ring_counts: DataFrame, keys: list[str], config: ModelConfig = ModelConfig()) -> DataFrame:
    """Sequences labelled train/val/test, by rings or, where that fails, by sequence order.

    A source falls back when it has no val or no test sequences although all its rings
    together give at least three. The choice needs group sizes only, so sequences are
    listed once, for the chosen groups.
    """
    rings = materialize(ring_counts.select(*keys, "ring", "ring_points"))
    labelled = split_rings(rings, keys).drop("ring_idx", "ring_count")
    by_ring = materialize(ring_groups(usable_rings(labelled, [*keys, "split"], config), [*keys, "split"], config))
    by_order = materialize(ring_groups(usable_rings(rings, keys, config), keys, config))
    have = by_ring.groupBy(*keys).agg(
        F.sum(F.when(F.col("split") == "val", F.col("sequences"))).alias("_val"),
        F.sum(F.when(F.col("split") == "test", F.col("sequences"))).alias("_test"),
    )
    total = by_order.groupBy(*keys).agg(F.sum("sequences").alias("_all"))
    nothing = F.lit(0)
    falls_back = total.join(have, keys, "left").filter(
        (F.col("_all") >= 3) & ((F.coalesce("_val", nothing) == 0) | (F.coalesce("_test", nothing) == 0))
    )
    falls_back = materialize(falls_back.select(*keys))
    columns = [*keys, "split", "group_idx", "window_idx", "end_ring", "rings", "seq_no", "seq_count"]
    split_groups = by_ring.join(falls_back, keys, "left_anti")
    kept = number_sequences(sequences(split_groups, [*keys, "split"]), split_groups, [*keys, "split"])
    order_groups = by_order.join(falls_back, keys, "left_semi")
    again = number_sequences(sequences(order_groups, keys), order_groups, keys).withColumn(
        "split", split_by_position(F.col("seq_no"), F.col("seq_count"))
    )
    return kept.select(*columns, F.lit("ring_level").alias("split_mode")).unionByName(
        again.select(*columns, F.lit("sequence_level_fallback").alias("split_mode"))
    )


def limit_sequences(seqs: DataFrame, keys: list[str], ids: list[str], limit: int, seed: int) -> DataFrame:
    """Seeded sample of at most ``limit`` sequences per key, the same on every run.

    ``ids`` tell the sequences of a key apart; those of the smallest digests of key, ids and seed are drawn.
    """
    if limit <= 0:
        return seqs
    ticket = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, *ids]], F.lit(str(seed))))
    drawn = seqs.withColumn("_ticket", ticket).withColumn("_part", F.substring("_ticket", 1, 2))
    by_part = Window.partitionBy(*keys, "_part").orderBy("_ticket")
    # the parts are the digests' first digits: ranked within a part, counted over the parts before
    sizes = drawn.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b"))
    return (
        drawn.withColumn("_r", F.row_number().over(by_part))
        .join(offsets, [*keys, "_part"])
        .filter(F.col("_b") + F.col("_r") <= limit)
        .drop("_ticket", "_part", "_r", "_b")
    )


def evenly_sampled(indexed: DataFrame, sample: int, index: str = "idx", total: str = "n") -> DataFrame:
    """Keep ``sample`` evenly spaced rows of each group; groups that small stay whole."""
    i, n = F.col(index), F.col(total)
    if sample <= 1:
        return indexed.filter((n <= sample) | (i == n - 1))
    # row i is kept when some j has floor(j * (n - 1) / (sample - 1)) = i
    step = F.lit(float(sample - 1))
    j = F.ceil(i.cast("double") * step / (n - 1).cast("double")).cast("bigint")

    def lands(c: Column) -> Column:
        return (c >= 0) & (c < sample) & (F.floor((c * (n - 1)).cast("double") / step).cast("bigint") == i)

    return indexed.filter((n <= sample) | lands(j - 1) | lands(j) | lands(j + 1))

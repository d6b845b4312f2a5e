"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, given by knots between which the weight is linear. Its integral
is the source's share of all words; a source gives at most ``epochs`` times its own words, and what is above goes to the
others by weight. A source's documents stand in a fixed pseudo-random order; the words before a document (in whole passes
over the source) are cumulative demand, and the inverse of the integrated schedule turns demand into the time at which the
document is read. Documents are range-sorted by that time.

A source may hold most rows: prefix sums are taken in (source, bucket), buckets being leading digits of the order key, and
only one row a bucket crosses buckets. The number of digits follows the number of rows, and the order does not depend on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Schedule = tuple[tuple[float, float], ...]  # (time, weight), times from 0 to 1

# Schedules of the sources in code point order, repeating: their integrals are 1, 2 and 3.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 2.0), (1.0, 4.0)))
EPOCHS = 3
BUCKET_ROWS = 50_000


def words(text: str) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Of each stretch between knots: its start, weight there, slope, integral before and after."""
    found, before = [], 0.0
    for (t, w), (end, v) in zip(schedule, schedule[1:]):
        after = before + (end - t) * (w + v) / 2
        found.append((t, w, (v - w) / (end - t), before, after))
        before = after
    return found


def integral(schedule: Schedule) -> float:
    return segments(schedule)[-1][-1]


def time_sql(schedule: Schedule, share: str) -> str:
    """The time at which the schedule's integral reaches ``share`` of its whole: on a stretch, the root of a quadratic."""
    whole = integral(schedule)
    cases = []
    for t, w, slope, before, after in segments(schedule):
        rest = f"({share} * {whole}D - {before}D)"
        root = f"{t}D + nullif(2D * {rest}, 0D) / ({w}D + sqrt(greatest(0D, {w * w}D + {2 * slope}D * {rest})))"
        cases.append(f"when {share} * {whole}D <= {after}D then coalesce({root}, {t}D)")
    return f"(case {' '.join(cases)} else 1D end)"


def targets(sizes: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size): one row per source, with its schedule's number and its target in words.

    Sources in code point order, null last, take the schedules in turn. With sources in order of size per weight, those below
    the common level take all they may, and the level of the others is what is left over their weights. There is one row per
    source here, so a single task sorts them."""
    weight = F.element_at(F.array(*[F.lit(integral(s)) for s in schedules]), F.col("schedule") + 1)
    ordered = sizes.withColumn(
        "schedule",
        ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules)).cast("int"),
    ).withColumns({"weight": weight, "most": F.col("source_size") * epochs})
    ranked = ordered.withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    common = F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("ratio"))).over(everything)
    return levels.select(
        "source", "source_size", "schedule", F.least(F.col("most").cast("double"), common * F.col("weight")).alias("target")
    )


def mix(
    df: DataFrame,
    keep: list[str],
    key: str,
    source: str = "source",
    size: Column | None = None,
    text: str = "text",
    schedules: tuple[Schedule, ...] = SCHEDULES,
    epochs: int = EPOCHS,
    into: str = "mix",
) -> DataFrame:
    """The columns ``keep`` and a struct ``into``: size, source_size, target, taken (words, repeats counted) and positions,
    the times in 0..1 of each reading of the document, in order.

    A reading is taken if its middle word is within its source's target, so each source comes to its target within half a
    document. Texts without words are never read. Rows with a null source form a source of their own, repeated rows are
    documents of their own, an empty table gives an empty one, and other columns are not touched."""
    rows = df.count()
    digits = max(0, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    kept = F.struct(*[F.col(c) for c in keep])
    sized = df.select(
        kept.alias("kept"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("of"),
        (size if size is not None else words(text)).alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("order"),
        F.xxhash64(F.struct(*[F.col(c) for c in keep])).alias("tie"),
    ).withColumn("bucket", F.substring("order", 1, digits))
    sums = sized.groupBy("source", "of", "bucket").agg(F.sum("size").alias("bucket_size"))
    wanted = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), schedules, epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "source", "of", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start")
    )
    plan = (
        offsets.alias("o")
        .join(wanted.alias("w"), F.expr("o.source <=> w.source"))
        .select("of", "bucket", "bucket_start", "source_size", "schedule", "target")
    )
    inside = (
        Window.partitionBy("of", "bucket").orderBy("order", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = counted.join(plan, ["of", "bucket"])  # the window's own keys, never null: the rows are not shuffled again
    shares = (
        f"transform(filter(sequence(0, {epochs - 1}), k -> size > 0 and "
        "k * source_size + bucket_start + inside + size / 2D <= target), "
        "k -> (k * source_size + bucket_start + inside + size / 2D) / target)"
    )
    by_schedule = " ".join(f"when {i} then {time_sql(s, 'u')}" for i, s in enumerate(schedules))
    return (
        placed.withColumn("shares", F.expr(shares))
        .withColumn("positions", F.expr(f"transform(shares, u -> case schedule {by_schedule} end)"))
        .select(
            "kept.*",
            F.struct(
                "size", "source_size", "target", (F.col("size") * F.size("shares")).alias("taken"), "positions"
            ).alias(into),
        )
    )


def in_training_order(mixed: DataFrame, tie: str, into: str = "mix", position: str = "position") -> DataFrame:
    """One row for each reading, range-sorted by its time (column ``position``); equal times in order of ``tie``. Documents
    that are not read have no row."""
    read = mixed.withColumn(position, F.explode(F.col(into)["positions"])).drop(into)
    return read.repartitionByRange(F.col(position), F.col(tie)).sortWithinPartitions(position, tie)

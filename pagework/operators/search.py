"""Index of opened files: building it from opens, keeping the latest, searching, and which opens count.

Every row belongs to an ``owner``. Opens are ``owner, file_path, ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagework.functions import text as tx
from pagework.operators import recency
from pagework.operators.rows import each

KEPT = 100
SHOWN = 8


def build_index(opens: DataFrame) -> DataFrame:
    """How often and when last each file was opened; both combine before the shuffle."""
    return opens.groupBy("owner", "file_path").agg(
        F.count("*").alias("open_count"), F.max("ts").alias("last_opened")
    ).withColumn("file_name", tx.base_name(F.col("file_path")))


def cap_index(index: DataFrame, keep: int = KEPT) -> DataFrame:
    """The latest ``keep`` files per owner. Spark cuts each task's rows to that many before the shuffle."""
    latest = Window.partitionBy("owner").orderBy(F.desc("last_opened"), "file_path")
    return index.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= keep).drop("_rank")


def recent_index(opens: DataFrame, keep: int = KEPT, before: DataFrame | None = None) -> DataFrame:
    """The index of the latest ``keep`` files per owner as it stands after taking in every open in turn: a file that fell out and
    was opened again starts at 1. ``before`` is the index of earlier opens."""
    found = recency.recent_files(opens, keep, before)
    return found.withColumn("file_name", tx.base_name(F.col("file_path")))


def search_index(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of ``owner, query`` rows in that owner's index, ranked: name hits first, then the latest.

    The index is cut to the latest ``KEPT`` files of an owner first, so it is one short array per owner. A query meets that
    array in one join and is filtered and ranked in its row; a busy owner's queries are split by the join.
    """
    newest = F.expr(
        "array_sort(collect_list(struct(last_opened, file_path, file_name, open_count)), (a, b) -> case"
        " when a.last_opened > b.last_opened then -1 when a.last_opened < b.last_opened then 1"
        " when a.file_path < b.file_path then -1 when a.file_path > b.file_path then 1 else 0 end)"
    )
    shelves = cap_index(index).groupBy("owner").agg(newest.alias("_files"))
    asked = queries.where(~tx.is_blank(F.col("query"), tx.SCRIPT_BLANKS)).select("owner", "query").distinct()
    named = "filter(_files, f -> contains(lower(f.file_name), lower(query)))"
    placed = "filter(_files, f -> contains(lower(f.file_path), lower(query)) and not contains(lower(f.file_name), lower(query)))"
    told = (
        f"concat(transform({named}, f -> named_struct('f', f, 'name_match', true)),"
        f" transform({placed}, f -> named_struct('f', f, 'name_match', false)))"
    )
    hits = each(asked.join(shelves, "owner"), F.expr(told), "_hit", "_pos")
    return hits.select(
        "owner", "query", "_hit.f.file_path", "_hit.f.open_count", "_hit.f.last_opened", "_hit.f.file_name", "_hit.name_match",
        (F.col("_pos") + 1).alias("rank"),
    )


def top_hits(hits: DataFrame, shown: int = SHOWN) -> DataFrame:
    return hits.where(F.col("rank") <= shown)


def flag_missing(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with ``is_missing``: the file is not in ``files`` or has size 0."""
    sizes = files.select("file_path", F.col("file_size").alias("_size"))
    return (
        hits.join(sizes, "file_path", "left")
        .withColumn("is_missing", F.coalesce("_size", F.lit(0)) <= 0)
        .drop("_size")
    )


def enabled_spans(control: DataFrame, opens: DataFrame, bucket: str = "day") -> DataFrame:
    """``owner, _bucket, _from, _to``: when recording was on and nothing was cleared since, cut at the borders of time buckets.

    Only control rows with a known action are looked at. In a row of switches of one kind the first counts; a span without end
    goes on to the owner's last open.
    """
    known = control.where(F.col("action").isin("enable", "disable", "clear"))
    # Of switches of one instant the one that turns recording on comes last.
    turned = F.max(F.when(F.col("action") != "clear", F.col("action") == "enable")).alias("_on")
    instants = known.groupBy("owner", "ts").agg(turned, F.max(F.col("action") == "clear").alias("_clears"))
    owner = Window.partitionBy("owner")
    at = owner.orderBy("ts")
    turns = (
        instants.withColumn("_cleared", F.max(F.when(F.col("_clears"), F.col("ts"))).over(owner))
        .where("_on is not null")
        .withColumn("_was", F.lag("_on", 1, False).over(at))
        .where("_on <> _was")
        .withColumn("_to", F.lead("ts").over(at))
        .where("_on")
    )
    last = opens.groupBy("owner").agg((F.max("ts") + F.expr("interval 1 second")).alias("_end"))
    spans = turns.join(last, "owner").select(
        "owner", F.greatest("ts", "_cleared").alias("_from"), F.coalesce("_to", "_end").alias("_to")
    )
    days = F.sequence(F.date_trunc(bucket, "_from"), F.date_trunc(bucket, "_to"), F.expr(f"interval 1 {bucket}"))
    return each(spans.where("_from < _to"), days, "_bucket")


def effective_opens(opens: DataFrame, control: DataFrame, bucket: str = "day") -> DataFrame:
    """Opens that were recorded and not cleared since.

    ``control`` has ``owner, ts, action`` with ``enable``, ``disable`` and ``clear``; recording starts disabled, and a
    control row acts before an open of the same instant. Opens are joined to the spans of time that count, on (owner, time
    bucket), and need no window; a busy owner is many small groups.
    """
    on = opens.select("owner", "file_path", "ts", F.date_trunc(bucket, "ts").alias("_bucket"))
    inside = on.join(enabled_spans(control, opens, bucket), ["owner", "_bucket"])
    return inside.where((F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to"))).select("owner", "file_path", "ts")


def enabled_now(control: DataFrame) -> DataFrame:
    """Owners whose index is switched on at the end of the log; a search by anyone else finds nothing."""
    switches = control.where(F.col("action").isin("enable", "disable"))
    last = F.max(F.struct("ts", (F.col("action") == "enable").alias("on"))).alias("_last")
    return switches.groupBy("owner").agg(last).where("_last.on").select("owner")

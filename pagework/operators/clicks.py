"""A log of clicks on the pages of a document, replayed in order.

Every page on the table has an id: 1 to n at first, and the next free number for each copy. A click names a page by its id, so what it
means depends on the clicks before it. The pages on the table are kept as stretches: neighbours whose ids, page numbers and turns
go on by one rule are one entry ``s, e, page, turn``. A click cuts at most two stretches, so a document of any length with k clicks has at
most 2k + 1 of them, and all clicks are folded in the document's row. Page rows are made at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagework.functions import messages as say
from pagework.operators.rows import Outcome, each, expand, present

ACTIONS = ("rotate", "duplicate", "delete", "move", "reset")
STRETCH = "struct<s: bigint, e: bigint, page: bigint, turn: int>"


def _piece(s: str, e: str, page: str, turn: str = "g.turn") -> str:
    return f"named_struct('s', cast({s} as bigint), 'e', cast({e} as bigint), 'page', cast({page} as bigint), 'turn', cast({turn} as int))"


def _cut(pages: str, at: str, middle: list[str]) -> str:
    """``pages`` with the page of id ``at`` replaced by ``middle``; the rest of its stretch stays on both sides."""
    left, right = _piece("g.s", f"{at} - 1", "g.page"), _piece(f"{at} + 1", "g.e", f"g.page + {at} + 1 - g.s")
    parts = ", ".join([left, *middle, right])
    return f"flatten(transform({pages}, g -> if({at} between g.s and g.e, filter(array({parts}), x -> x.s <= x.e), array(g))))"


def _place(at: str) -> str:
    """Number of the stretch that holds ``at``; 0 where none does."""
    return f"array_position(transform(t.pages, g -> {at} between g.s and g.e), true)"


def _fold() -> str:
    own, here, there = _piece("c.page_id", "c.page_id", "g.page + c.page_id - g.s"), "c.page_id", "c.target_id"
    turned = _piece(here, here, f"g.page + {here} - g.s", "(g.turn + 90) % 360")
    copy = _piece("t.free", "t.free", f"g.page + {here} - g.s")
    target = _piece(there, there, f"g.page + {there} - g.s")
    begin = "array(" + _piece("1", "page_count", "1", "0") + ")"
    # The moved page comes to the old place of the target: behind it where it stood before it, else before it.
    dragged = f"element_at(flatten(transform(t.pages, g -> if({here} between g.s and g.e, array({own}), cast(array() as array<{STRETCH}>)))), 1)"
    forward = f"({_place(here)} < {_place(there)} or ({_place(here)} = {_place(there)} and {here} < {there}))"
    without = _cut("t.pages", here, [])
    moved = f"if({forward}, {_cut(without, there, [target, dragged])}, {_cut(without, there, [dragged, target])})"
    known = f"{_place(here)} > 0"

    def state(pages: str, free: str = "t.free", count: str = "t.count") -> str:
        return f"named_struct('pages', {pages}, 'free', cast({free} as bigint), 'count', cast({count} as bigint))"

    step = (
        f"case when c.action = 'reset' then {state(begin, 'page_count + 1', 'page_count')}"
        f" when not coalesce({known}, false) then t"
        f" when c.action = 'rotate' then {state(_cut('t.pages', here, [turned]))}"
        f" when c.action = 'duplicate' then {state(_cut('t.pages', here, [own, copy]), 't.free + 1', 't.count + 1')}"
        f" when c.action = 'delete' and t.count > 1 then {state(without, count='t.count - 1')}"
        f" when c.action = 'move' and {here} <> {there} and {_place(there)} > 0 then {state(moved)}"
        " else t end"
    )
    return f"aggregate(clicks, {state(begin, 'page_count + 1', 'page_count')}, (t, c) -> {step}, t -> t.pages)"


def replay_clicks(clicks: DataFrame, docs: DataFrame) -> Outcome:
    """``doc_id, out_no, page_no, rotation, page_id`` of each clicked document's pages after all its clicks.

    ``clicks`` has ``doc_id, seq, action, page_id, target_id`` with the actions ``rotate`` (by 90 degrees), ``duplicate`` (the copy
    follows its page and has the next free id), ``delete`` (never the last page), ``move`` (to the place of ``target_id``) and
    ``reset``. Clicks are taken in order of ``seq``; those that share one, in order of their other columns. A click on a page that isn't
    there changes nothing. An unknown document and an unknown action are errors of the document, which then has no pages.
    """
    log = F.array_sort(F.collect_list(F.struct("seq", "action", *[F.col(c).cast("bigint").alias(c) for c in ("page_id", "target_id")])))
    logs = clicks.groupBy("doc_id").agg(log.alias("clicks"))
    checked = logs.join(docs.select("doc_id", F.col("page_count").cast("bigint").alias("page_count")), "doc_id", "left")
    names = ", ".join(f"'{a}'" for a in ACTIONS)
    strange = F.expr(f"filter(clicks.action, a -> a is null or a not in ({names}))")
    errors = present(
        F.when(F.col("page_count").isNull(), F.concat(F.lit(say.FILE_NOT_FOUND), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        F.when(F.size(strange) > 0, F.concat(F.lit(say.UNKNOWN_ACTION), F.coalesce(F.element_at(strange, 1), F.lit("null")))),
    )
    checked = checked.withColumn("errors", errors)
    stretches = each(checked.where(F.size("errors") == 0), F.expr(_fold()), "_g", "_k").select("doc_id", "_k", "_g.*")
    before = Window.partitionBy("doc_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    placed = stretches.withColumn("_start", F.coalesce(F.sum(F.expr("e - s + 1")).over(before), F.lit(0)))
    rows = expand(placed, "s", "e", "page_id", deal=("_k",)).select(
        "doc_id",
        F.expr("cast(_start + page_id - s + 1 as int)").alias("out_no"),
        F.expr("cast(page + page_id - s as int)").alias("page_no"),
        F.col("turn").alias("rotation"),
        F.col("page_id").cast("bigint").alias("page_id"),
    )
    faults = checked.where(F.size("errors") > 0).select(F.col("doc_id").cast("bigint").alias("request_id"), "doc_id", "errors")
    return Outcome(rows, faults)

"""Pieces of SQL text for nested array expressions.

Logic inside ``transform`` and ``aggregate`` is written as SQL: Spark parses it in one call, where building the same tree
from Python costs one call per node. Each step of a nested ``transform`` names its values, so that none is worked out
twice.
"""

from __future__ import annotations

from pagework.functions.messages import NO_PAGE, NO_RANGE
from pagework.functions.text import DOTNET_BLANKS, PYTHON_BLANKS, SCRIPT_BLANKS

SPANS = "array<struct<s:int,e:int>>"
LONG_SPANS = "array<struct<s:bigint,e:bigint>>"
PY = PYTHON_BLANKS
JS = SCRIPT_BLANKS
TOKENS = "array<struct<s:int,e:int,error:string>>"


def escaped(text: str) -> str:
    """Characters as they may stand inside a string literal."""
    return "".join(f"\\u{ord(c):04x}" for c in text)


def strip(x: str, blanks: str = DOTNET_BLANKS) -> str:
    return f"trim(BOTH '{escaped(blanks)}' FROM {x})"


def strict_int(x: str) -> str:
    """A 32-bit integer with a sign and outer ASCII blanks, else null."""
    return f"if({x} rlike '^[\\\\t-\\\\r ]*[+-]?[0-9]+[\\\\t-\\\\r ]*$', try_cast({x} as int), null)"


def long_int(x: str) -> str:
    """An integer of any length, pinned to the ends of bigint; ``x`` has no outer blanks."""
    pinned = f"if(startswith({x}, '-'), -9223372036854775807, 9223372036854775807)"
    return f"if({x} rlike '^[+-]?[0-9]+$', coalesce(try_cast({x} as bigint), {pinned}), null)"


def leading_digits(x: str) -> str:
    """The decimal or ``0x`` number a text starts with after blanks, as text; empty where there is none."""
    return f"regexp_extract({x}, '^[{escaped(JS)}]*([+-]?(?:0[xX][0-9a-fA-F]+|(?!0[xX])[0-9]+))', 1)"


def digits_value(d: str) -> str:
    """The value of ``leading_digits``, null where that is empty. Hex digits beyond bigint are pinned to its ends, decimal ones
    are null; no document has such a page.

    A failing ``try_cast`` costs an exception, so here as elsewhere only texts that look right reach it.
    """
    digits = f"regexp_replace(substring_index(lower({d}), 'x', -1), '^0+(?=.)', '')"
    hexed = f"if(length({digits}) > 15, '9223372036854775807', conv({digits}, 16, 10))"
    return (
        f"case when {d} = '' then null when contains(lower({d}), 'x')"
        f" then if(startswith({d}, '-'), -1, 1) * try_cast({hexed} as bigint) else try_cast({d} as bigint) end"
    )


def no_spans(kind: str = SPANS) -> str:
    return f"cast(array() as {kind})"


def whole(page_count: str = "page_count") -> str:
    """All pages."""
    return f"if({page_count} >= 1, array(named_struct('s', 1, 'e', {page_count})), {no_spans()})"


def clamp(spans: str, page_count: str = "page_count") -> str:
    """Spans of any integers cut to ``1..page_count``; null and empty ones are dropped."""
    cut = (
        f"transform({spans}, x -> named_struct('s', greatest(x.s, 1L), 'e', least(x.e, cast({page_count} as bigint)),"
        " 'ok', x.s is not null and x.e is not null))"
    )
    kept = f"filter({cut}, x -> x.ok and x.s <= x.e)"
    return f"coalesce(transform({kept}, x -> named_struct('s', cast(x.s as int), 'e', cast(x.e as int))), {no_spans()})"


# Appending copies an array, so folds that append work on stretches of this many elements: linear in the whole.
STRETCH = 256


def folded(array: str, zero: str, carried: str, fold: str) -> str:
    """The outputs of ``fold`` over stretches of ``array``, one after another.

    ``fold`` says what a stretch ``c`` gives after what was carried, ``h``; ``carried`` is the value after stretch ``c`` that
    follows ``acc.h``, and ``zero`` the first.
    """
    stretches = (
        f"transform(array({array}), v -> transform(sequence(0, greatest(0, (size(v) - 1) div {STRETCH})),"
        f" i -> slice(v, i * {STRETCH} + 1, {STRETCH})))[0]"
    )
    before = (
        f"aggregate(w, named_struct('out', array({zero}), 'h', {zero}), (acc, c) -> transform(array({carried}),"
        " n -> named_struct('out', array_append(acc.out, n), 'h', n))[0], acc -> slice(acc.out, 1, size(acc.out) - 1))"
    )
    return f"transform(array({stretches}), w -> flatten(zip_with(w, {before}, (c, h) -> {fold})))[0]"


def merge(spans: str) -> str:
    """The same pages as sorted spans that do not overlap."""
    fold = (
        f"aggregate(c, named_struct('out', {no_spans()}, 'hi', h),"
        " (s, x) -> if(x.e > s.hi,"
        " named_struct('out', array_append(s.out, named_struct('s', greatest(x.s, s.hi + 1), 'e', x.e)), 'hi', x.e),"
        " s), s -> s.out)"
    )
    return folded(f"sort_array({spans})", "0", "greatest(acc.h, coalesce(array_max(transform(c, x -> x.e)), 0))", fold)


def runs(merged: str) -> str:
    """Sorted, disjoint spans with neighbours that touch joined into one: each that opens a run meets the one that ends it."""
    opens = "filter(m, (x, i) -> i = 0 or get(m, i - 1).e <> x.s - 1)"
    ends = "filter(m, (x, i) -> i = size(m) - 1 or get(m, i + 1).s <> x.e + 1)"
    return f"transform(array({merged}), m -> zip_with({opens}, {ends}, (a, b) -> named_struct('s', a.s, 'e', b.e)))[0]"


def complement(merged: str, page_count: str = "page_count") -> str:
    """Pages of ``1..page_count`` outside sorted, disjoint spans."""
    lows = f"concat(array(1), transform({merged}, x -> x.e + 1))"
    highs = f"concat(transform({merged}, x -> x.s - 1), array({page_count}))"
    return f"filter(zip_with({lows}, {highs}, (a, b) -> named_struct('s', a, 'e', b)), x -> x.s <= x.e)"


def count(merged: str) -> str:
    return f"aggregate({merged}, 0, (n, x) -> n + x.e - x.s + 1)"


# The messages of the two strict forms below.


def split_tokens(ranges: str) -> str:
    """Ranges of the split form, strict: ``a`` or ``a-b``, as ``{s, e, error}``."""
    return f"""coalesce(transform(transform(transform({ranges},
        t -> {strip("t")}),
        t -> named_struct('t', t, 'dash', contains(t, '-'), 'p', split(t, '-'), 'one', {strict_int("t")})),
        x -> {_strict_token("x.p", "x.t", "x.one", "x.dash")}), cast(array() as {TOKENS}))"""


def _strict_token(parts: str, text: str, one: str, dash: str) -> str:
    return f"""transform(array(named_struct('a', {strict_int(strip(f"get({parts}, 0)"))},
                                            'b', {strict_int(strip(f"get({parts}, 1)"))})), v -> named_struct(
        's', if({dash}, v.a, {one}), 'e', if({dash}, v.b, {one}), 'error', case
        when {text} is null then '{NO_RANGE}'
        when not {dash} and {one} is null then concat('Invalid page number: \\'', {text}, '\\'')
        when not {dash} and {one} not between 1 and page_count
          then concat('Page number ', {one}, ' is out of range (1-', page_count, ')')
        when not {dash} then null
        when size({parts}) <> 2
          then concat('Invalid range format: \\'', {text}, '\\'. Use \\'start-end\\' or single page numbers.')
        when v.a is null or v.b is null then concat('Invalid page numbers in range: \\'', {text}, '\\'')
        when v.a < 1 then concat('Start page cannot be less than 1: \\'', {text}, '\\'')
        when v.b > page_count then concat('End page cannot exceed ', page_count, ': \\'', {text}, '\\'')
        when v.a > v.b then concat('Start page cannot be greater than end page: \\'', {text}, '\\'') end))[0]"""


def remove_tokens(pages: str, ranges: str) -> str:
    """Page list and ranges of the remove form, strict: ranges always ``a-b``, as ``{s, e, error}``."""
    listed = f"""transform({pages}, p -> named_struct('s', p, 'e', p, 'error',
        case when p is null then '{NO_PAGE}'
             when p not between 1 and page_count then concat('Page number ', p, ' is out of range (1-', page_count, ')') end))"""
    ranged = f"""transform(transform(transform({ranges},
        t -> named_struct('t', t, 'p', split(t, '-'))),
        x -> named_struct('t', x.t, 'k', size(x.p), 'a', {strict_int(strip("get(x.p, 0)"))},
                          'b', {strict_int(strip("get(x.p, 1)"))})),
        x -> named_struct('s', x.a, 'e', x.b, 'error', case
        when x.t is null then '{NO_RANGE}'
        when x.k <> 2
          then concat('Invalid page range format: ', x.t, '. Expected format: \\'start-end\\' (e.g., \\'1-5\\')')
        when x.a is null or x.b is null then concat('Invalid page numbers in range: ', x.t)
        when x.a < 1 or x.b > page_count or x.a > x.b
          then concat('Page range ', x.t, ' is out of bounds (1-', page_count, ') or invalid') end))"""
    nothing = f"cast(array() as {TOKENS})"
    return f"concat(coalesce({listed}, {nothing}), coalesce({ranged}, {nothing}))"


def _pair(first: str, last: str) -> str:
    return f"named_struct('s', cast({first} as bigint), 'e', cast({last} as bigint))"


def crop_spans(custom: str) -> str:
    """Lenient: empty pieces between dashes vanish, ``5-2`` means ``2-5``."""
    tokens = f"""transform(transform(transform(split({custom}, ','),
        t -> named_struct('t', {strip("t")}, 'p', filter(split({strip("t")}, '-'), y -> y <> ''))),
        x -> named_struct('dash', contains(x.t, '-'), 'k', size(x.p), 'one', {strict_int("x.t")},
                          'a', {strict_int("get(x.p, 0)")}, 'b', {strict_int("get(x.p, 1)")})),
        x -> case when not x.dash then {_pair("x.one", "x.one")}
                  when x.k = 2 and x.a is not null and x.b is not null then {_pair("least(x.a, x.b)", "greatest(x.a, x.b)")}
             end)"""
    return merge(clamp(tokens))


def watermark_spans(custom: str) -> str:
    """Lenient: exactly one dash per range, ``5-2`` is empty."""
    tokens = f"""transform(transform(transform(split({custom}, ','),
        t -> transform(split({strip("t", PY)}, '-'), y -> {strip("y", PY)})),
        p -> named_struct('k', size(p), 'a', {long_int("get(p, 0)")}, 'b', {long_int("get(p, 1)")})),
        x -> case x.k when 1 then {_pair("x.a", "x.a")} when 2 then {_pair("x.a", "x.b")} end)"""
    return merge(clamp(tokens))


def image_spans(pages: str, ranges: str) -> str:
    """A page list and a range list, cut at the first dash only; both empty means every page."""
    ranged = f"""transform(transform(transform({ranges},
        t -> transform(split(t, '-', 2), y -> {strip("y", PY)})),
        p -> named_struct('k', size(p), 'a', {long_int("get(p, 0)")}, 'b', {long_int("get(p, 1)")})),
        x -> if(x.k = 1, {_pair("x.a", "x.a")}, {_pair("x.a", "x.b")}))"""
    nothing = no_spans(LONG_SPANS)
    listed = f"coalesce(transform({pages}, p -> {_pair('p', 'p')}), {nothing})"
    none_given = f"coalesce(size({pages}) <= 0, true) and coalesce(size({ranges}) <= 0, true)"
    return f"if({none_given}, {whole()}, {merge(clamp(f'concat({listed}, coalesce({ranged}, {nothing}))'))})"


def form_spans(pages_text: str, ranges_text: str) -> str:
    """Two text boxes: numbers by their leading digits, and ranges that count only when wholly in bounds."""
    numbers = f"""transform(transform(split({pages_text}, ','),
        t -> {leading_digits("t")}),
        d -> {digits_value("d")})"""
    ranged = f"""transform(transform(transform(split({ranges_text}, ','),
        t -> transform(split(t, '-'), y -> {leading_digits("y")})),
        p -> named_struct('k', size(p), 'a', {digits_value("get(p, 0)")}, 'b', {digits_value("get(p, 1)")})),
        x -> if(x.k = 2 and x.a >= 1 and x.b <= page_count and x.a <= x.b, {_pair("x.a", "x.b")}, null))"""
    nothing = no_spans(LONG_SPANS)
    singles = f"coalesce(transform({numbers}, p -> {_pair('p', 'p')}), {nothing})"
    return merge(clamp(f"concat({singles}, coalesce({ranged}, {nothing}))"))


def mode_spans(mode: str, custom: str, start: str, end: str) -> str:
    """All, first, last, custom text, or start to end; end 0 is the last page, empty custom text falls to start-end."""
    last = f"if({end} > 0, least(page_count, {end}), page_count)"
    return f"""case when {mode} = 'all' then {whole()}
        when {mode} = 'first' then {clamp("array(" + _pair("1", "1") + ")")}
        when {mode} = 'last' then {clamp("array(" + _pair("page_count", "page_count") + ")")}
        when {mode} = 'custom' and {custom} <> '' then {watermark_spans(custom)}
        else {clamp("array(" + _pair(f"greatest(1, {start})", last) + ")")} end"""


def stride_hit(page_no: str = "page_no") -> str:
    """Whether a page is even, odd or on the every-Nth stride, as far as ``even, odd, nth, start`` ask for it."""
    return f"""(coalesce(even, false) and {page_no} % 2 = 0) or (coalesce(odd, false) and {page_no} % 2 = 1)
        or coalesce({page_no} >= coalesce(start, nth)
                    and pmod({page_no} - cast(coalesce(start, nth) as bigint), if(nth > 0, nth, null)) = 0, false)"""

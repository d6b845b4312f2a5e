"""The registered queries once more as DuckDB SQL, written from the rules and not from the Spark plans."""

from __future__ import annotations

from pagework.plans.fixture_sql import with_clause

ORACLES: dict[str, str] = {}


def oracle(key: str, uses: list[str], select: str, ctes: str = "") -> None:
    """Puts together the input definitions ``uses``, further expressions ``ctes``, and the final ``select``."""
    head = with_clause(uses)
    if ctes:
        head = f"{head.rstrip()},\n{ctes}\n" if head else f"with {ctes}\n"
    ORACLES[key] = head + select.strip()


BLANK = "[\\s\\x0b\\x85\\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def blank(x: str) -> str:
    return f"regexp_full_match(coalesce({x}, ''), '{BLANK}*')"


def whole_int(x: str, kind: str = "int") -> str:
    """An integer with a sign and outer blanks, else null."""
    return f"case when regexp_full_match({x}, '[\\t-\\r ]*[+-]?[0-9]+[\\t-\\r ]*') then try_cast(ltrim(trim({x}), '+') as {kind}) end"


def lead_int(x: str) -> str:
    """``parseInt``: leading digits, or 0x and hex digits."""
    return (
        f"case when regexp_matches({x}, '^\\s*0[xX][0-9a-fA-F]') then"
        f" try_cast(concat('0x', regexp_extract({x}, '^\\s*0[xX]0*([0-9a-fA-F]+)', 1)) as bigint)"
        f" when not regexp_matches({x}, '^\\s*0[xX]') then"
        f" try_cast(ltrim(regexp_extract({x}, '^\\s*([+-]?[0-9]+)', 1), '+') as bigint) end"
    )


# B1, B2: strict tokens

SPLIT_TOKENS = f"""
raw as (select r.request_id, r.doc_id, d.page_count as n, d.base, u.pos, {strip("u.t")} as t
        from split_requests r join docs d using (doc_id), unnest(r.page_ranges) with ordinality as u(t, pos)),
cut as (select *, contains(t, '-') as ranged, string_split(t, '-') as ps, {whole_int("t")} as one,
               {whole_int("split_part(t, '-', 1)")} as a, {whole_int("split_part(t, '-', 2)")} as b from raw),
tok as (select request_id, doc_id, n, base, pos, case when ranged then a else one end as s,
               case when ranged then b else one end as e,
               case when t is null then 'Page range is missing'
                    when not ranged and one is null then concat('Invalid page number: ''', t, '''')
                    when not ranged and (one < 1 or one > n) then concat('Page number ', one, ' is out of range (1-', n, ')')
                    when not ranged then null
                    when len(ps) <> 2 then concat('Invalid range format: ''', t, '''. Use ''start-end'' or single page numbers.')
                    when a is null or b is null then concat('Invalid page numbers in range: ''', t, '''')
                    when a < 1 then concat('Start page cannot be less than 1: ''', t, '''')
                    when b > n then concat('End page cannot exceed ', n, ': ''', t, '''')
                    when a > b then concat('Start page cannot be greater than end page: ''', t, '''') end as err
        from cut),
bad as (select request_id, string_agg(err, '; ' order by pos) as error from tok where err is not null group by request_id)
"""
oracle(
    "b1_spec_split",
    ["split_requests", "doc_pages"],
    """select distinct t.request_id, t.doc_id, p.page_no
       from tok t join doc_pages p on p.doc_id = t.doc_id and p.page_no between t.s and t.e
       where t.request_id not in (select request_id from bad)""",
    SPLIT_TOKENS,
)
oracle("b1_spec_split_errors", ["split_requests"], "select request_id, error from bad", SPLIT_TOKENS)

REMOVE_TOKENS = f"""
listed as (select r.request_id, r.doc_id, d.page_count as n, u.pos, u.p as s, u.p as e,
                  case when u.p is null then 'Page number is missing' when u.p < 1 or u.p > d.page_count
                       then concat('Page number ', u.p, ' is out of range (1-', d.page_count, ')') end as err
           from remove_requests r join docs d using (doc_id), unnest(r.pages) with ordinality as u(p, pos)),
cut as (select r.request_id, r.doc_id, d.page_count as n, 100000 + u.pos as pos, u.t, len(string_split(u.t, '-')) as k,
               {whole_int("split_part(u.t, '-', 1)")} as a, {whole_int("split_part(u.t, '-', 2)")} as b
        from remove_requests r join docs d using (doc_id), unnest(r.page_ranges) with ordinality as u(t, pos)),
tok as (select * from listed union all
        select request_id, doc_id, n, pos, a, b,
               case when t is null then 'Page range is missing'
                    when k <> 2 then concat('Invalid page range format: ', t, '. Expected format: ''start-end'' (e.g., ''1-5'')')
                    when a is null or b is null then concat('Invalid page numbers in range: ', t)
                    when a < 1 or b > n or a > b then concat('Page range ', t, ' is out of bounds (1-', n, ') or invalid') end
        from cut),
bad as (select request_id, string_agg(err, '; ' order by pos) as error from tok where err is not null group by request_id)
"""
oracle(
    "b2_spec_remove",
    ["remove_requests", "doc_pages"],
    """select distinct t.request_id, t.doc_id, p.page_no
       from tok t join doc_pages p on p.doc_id = t.doc_id and p.page_no between t.s and t.e
       where t.request_id not in (select request_id from bad)""",
    REMOVE_TOKENS,
)
oracle("b2_spec_remove_errors", ["remove_requests"], "select request_id, error from bad", REMOVE_TOKENS)

# B3 to B6: lenient tokens

CROP_TOKENS = f"""
raw as (select r.request_id, r.doc_id, {strip("u.t")} as t
        from spec_requests r, unnest(string_split(r.custom_pages, ',')) as u(t)),
cut as (select *, list_filter(string_split(t, '-'), lambda x: x <> '') as ps from raw),
num as (select request_id, doc_id, t, len(ps) as k, {whole_int("t")} as one, {whole_int("ps[1]")} as a,
               {whole_int("ps[2]")} as b from cut),
tok as (select request_id, doc_id, one as s, one as e from num where not contains(t, '-')
        union all select request_id, doc_id, least(a, b), greatest(a, b) from num
        where contains(t, '-') and k = 2 and a is not null and b is not null)
"""
PICKED = """select distinct t.request_id, t.doc_id, p.page_no
            from tok t join doc_pages p on p.doc_id = t.doc_id and p.page_no between t.s and t.e"""
oracle("b3_spec_crop", ["spec_requests", "doc_pages"], PICKED, CROP_TOKENS)


def watermark_tokens(table: str) -> str:
    return f"""
raw as (select r.request_id, r.doc_id, {strip("u.t")} as t
        from {table} r, unnest(string_split(r.custom_pages, ',')) as u(t)),
tok as (select request_id, doc_id, {whole_int("t", "hugeint")} as s, {whole_int("t", "hugeint")} as e from raw
        where not contains(t, '-')
        union all
        select request_id, doc_id, {whole_int("split_part(t, '-', 1)", "hugeint")},
               {whole_int("split_part(t, '-', 2)", "hugeint")} from raw
        where contains(t, '-') and len(string_split(t, '-')) = 2)
"""


oracle("b4_spec_watermark", ["spec_requests", "doc_pages"], PICKED, watermark_tokens("spec_requests"))

LIST_TOKENS = f"""
raw as (select r.request_id, r.doc_id, u.t, strpos(u.t, '-') as dash
        from list_requests r, unnest(r.page_ranges) as u(t)),
tok as (select r.request_id, r.doc_id, cast(u.p as hugeint) as s, cast(u.p as hugeint) as e
        from list_requests r, unnest(r.pages) as u(p)
        union all
        select request_id, doc_id, {whole_int("t", "hugeint")}, {whole_int("t", "hugeint")} from raw where dash = 0
        union all
        select request_id, doc_id, {whole_int("substr(t, 1, dash - 1)", "hugeint")},
               {whole_int("substr(t, dash + 1)", "hugeint")} from raw where dash > 0
        union all
        select request_id, doc_id, 1, 1000000000 from list_requests where pages is null and page_ranges is null)
"""
oracle("b5_spec_images", ["list_requests", "doc_pages"], PICKED, LIST_TOKENS)

FORM_TOKENS = f"""
numbers as (select r.request_id, r.doc_id, {lead_int("u.t")} as s
            from form_requests r, unnest(string_split(r.pages_text, ',')) as u(t)),
ranges as (select r.request_id, r.doc_id, d.page_count as n, {lead_int("split_part(u.t, '-', 1)")} as s,
                  {lead_int("split_part(u.t, '-', 2)")} as e
           from form_requests r join docs d using (doc_id), unnest(string_split(r.ranges_text, ',')) as u(t)
           where len(string_split(u.t, '-')) = 2),
tok as (select request_id, doc_id, s, s as e from numbers
        union all select request_id, doc_id, s, e from ranges where s >= 1 and e <= n and s <= e),
sel as (select distinct t.request_id, t.doc_id, p.page_no
        from tok t join doc_pages p on p.doc_id = t.doc_id and p.page_no between t.s and t.e)
"""
oracle("b6_spec_form", ["form_requests", "doc_pages"], "select request_id, doc_id, page_no from sel", FORM_TOKENS)

MODE_PAGES = (
    watermark_tokens("mode_requests")
    + """,
custom as (select distinct t.request_id, p.page_no from tok t join doc_pages p
           on p.doc_id = t.doc_id and p.page_no between t.s and t.e),
sel as (select r.request_id, r.doc_id, p.page_no, p.page_count
        from mode_requests r join doc_pages p using (doc_id)
        where case when mode = 'all' then true when mode = 'first' then page_no = 1 when mode = 'last' then page_no = page_count
                   when mode = 'custom' and custom_pages <> ''
                     then exists (select 1 from custom c where c.request_id = r.request_id and c.page_no = p.page_no)
                   else page_no >= start_page and (end_page <= 0 or page_no <= end_page) end)
"""
)
oracle("b7_select_pages", ["mode_requests", "doc_pages"], "select request_id, doc_id, page_no from sel", MODE_PAGES)

STRIDE = """
stride as (select r.request_id, r.doc_id, p.page_no from stride_requests r join doc_pages p using (doc_id)
           where (r.even and p.page_no % 2 = 0) or (r.odd and p.page_no % 2 = 1)
              or (r.nth > 0 and p.page_no in (select unnest(generate_series(coalesce(r.start, r.nth), p.page_count, r.nth)))))
"""
oracle("b8_select_stride", ["stride_requests", "doc_pages"], "select request_id, doc_id, page_no from stride", STRIDE.replace(
    "p.page_no in (select unnest(generate_series(coalesce(r.start, r.nth), p.page_count, r.nth)))",
    "list_contains(generate_series(coalesce(r.start, r.nth), p.page_count, r.nth), p.page_no)",
))
STRIDE = STRIDE.replace(
    "p.page_no in (select unnest(generate_series(coalesce(r.start, r.nth), p.page_count, r.nth)))",
    "list_contains(generate_series(coalesce(r.start, r.nth), p.page_count, r.nth), p.page_no)",
)

for _key in ("b9_invert_selection", "b9_invert_spans"):
    oracle(
        _key,
        ["spec_requests", "doc_pages"],
        """select r.request_id, r.doc_id, p.page_no from spec_requests r join doc_pages p using (doc_id)
           where not exists (select 1 from sel s where s.request_id = r.request_id and s.page_no = p.page_no)""",
        watermark_tokens("spec_requests") + f", sel as ({PICKED})",
    )

oracle(
    "b10_union_selection",
    ["spec_requests", "stride_requests", "doc_pages"],
    f"{PICKED} union select request_id, doc_id, page_no from stride",
    CROP_TOKENS + "," + STRIDE,
)

for _key in ("b11_compact_selection", "b11_compact_spans"):
  oracle(
    _key,
    ["form_requests", "doc_pages"],
    """select request_id, doc_id, 'range' as kind, s as start_page, e as end_page, concat(s, '-', e) as token
       from runs where e - s >= 2
       union all
       select sel.request_id, sel.doc_id, 'page', page_no, page_no, cast(page_no as varchar)
       from sel join runs on runs.request_id = sel.request_id and page_no between s and e where e - s < 2""",
    FORM_TOKENS
    + """, numbered as (select *, page_no - row_number() over (partition by request_id order by page_no) as g from sel),
    runs as (select request_id, doc_id, min(page_no) as s, max(page_no) as e from numbered group by request_id, doc_id, g)""",
)

for _key in ("b12_selection_summary", "b12_selected_summary"):
  oracle(
    _key,
    ["form_requests", "doc_pages"],
    """select r.request_id, r.doc_id, cast(coalesce(k, 0) as int) as selected_count,
              cast(page_count - coalesce(k, 0) as int) as remaining,
              case when k is null then 'No pages selected'
                   when k <= 10 then concat('Selected: ', pages, ' (', k, case when k > 1 then ' pages)' else ' page)' end)
                   else concat(k, ' pages selected') end as info_text
       from form_requests r join docs using (doc_id) left join sums using (request_id)""",
    FORM_TOKENS
    + """, sums as (select request_id, count(*) as k,
    array_to_string(list(cast(page_no as varchar) order by page_no), ', ') as pages from sel group by request_id)""",
)

# C: manifests

PART = "concat({base}, '_part', {k}, '_pages', {s}, '-', {e}, '.pdf')"
oracle(
    "c1_split_by_ranges",
    ["split_requests", "doc_pages"],
    f"""select t.request_id, t.doc_id, {PART.format(base="t.base", k="t.pos", s="t.s", e="t.e")} as output_name,
               cast(t.pos as int) as part_no, cast(p.page_no - t.s + 1 as int) as out_no, p.page_no
        from tok t join doc_pages p on p.doc_id = t.doc_id and p.page_no between t.s and t.e
        where t.request_id not in (select request_id from bad)""",
    SPLIT_TOKENS,
)

POINTS = """
pts as (select r.request_id, r.doc_id, d.page_count as n, d.base, r.split_points,
               len(r.split_points) as k, len(list_distinct(r.split_points)) as kd,
               list_min(r.split_points) as lo, list_max(r.split_points) as hi,
               len(list_filter(r.split_points, lambda x: x is null)) > 0 as holed
        from split_requests r join docs d using (doc_id))
"""
oracle(
    "c2_split_at_pages",
    ["split_requests", "doc_pages"],
    f"""select request_id, doc_id, {PART.format(base="base", k="part_no", s="s", e="e")} as output_name,
               cast(part_no as int) as part_no, cast(page_no - s + 1 as int) as out_no, page_no
        from (select *, min(page_no) over w as s, max(page_no) over w as e from numbered
              window w as (partition by request_id, part_no)) t""",
    POINTS
    + """, numbered as (select q.request_id, q.doc_id, q.base, p.page_no,
                               1 + (select count(*) from unnest(q.split_points) as u(x) where u.x < p.page_no) as part_no
    from pts q join doc_pages p using (doc_id) where not q.holed and q.k = q.kd and q.lo >= 1 and q.hi <= q.n - 1)""",
)
oracle(
    "c2_split_at_pages_errors",
    ["split_requests"],
    """select request_id, case when split_points is null then 'Split pages are required' when holed then 'Split page is missing'
                               else concat('Split pages must be distinct and lie between 1 and ', n - 1) end as error
       from pts where split_points is null or holed or k > kd or lo < 1 or hi > n - 1""",
    POINTS,
)

EVERY = """select {head} doc_id, concat(base, '_part', part_no, '_pages', min(page_no) over w, '-', max(page_no) over w, '.pdf')
           as output_name, cast(part_no as int) as part_no, cast(row_number() over (w order by page_no) as int) as out_no, page_no
           from (select {head} doc_id, base, page_no, (page_no - 1) // {n} + 1 as part_no from {source}) t
           window w as (partition by {head} doc_id, part_no)"""
oracle("c3_split_every_n", ["doc_pages"], EVERY.format(head="", n=5, source="doc_pages"))
oracle(
    "c3_split_every_n_requests",
    ["split_requests", "doc_pages"],
    EVERY.format(
        head="request_id,",
        n="page_interval",
        source="split_requests join doc_pages using (doc_id) where page_interval >= 1",
    ),
)
oracle(
    "a4_write_manifest",
    ["doc_pages"],
    """select doc_id, lpad(cast(doc_id * 10 + part_no as varchar), cast(greatest(5, len(cast(doc_id * 10 + part_no as varchar))) as int), '0')
              as output_name, part_no, out_no, page_no from ("""
    + EVERY.format(head="", n=5, source="doc_pages")
    + ") t",
)
oracle(
    "c4_extract_all",
    ["doc_pages"],
    """select doc_id, concat(base, '_page', page_no, '.pdf') as output_name, page_no as part_no, 1 as out_no, page_no
       from doc_pages""",
)

REMOVAL = (
    REMOVE_TOKENS
    + """,
gone as (select distinct r.request_id, p.page_no from remove_requests r join doc_pages p using (doc_id)
         where (r.even and p.page_no % 2 = 0) or (r.odd and p.page_no % 2 = 1)
            or (r.nth > 0 and list_contains(generate_series(coalesce(r.start, r.nth), p.page_count, r.nth), p.page_no))
            or exists (select 1 from tok t where t.request_id = r.request_id and p.page_no between t.s and t.e)),
sizes as (select request_id, count(*) as k from gone group by request_id),
faults as (select r.request_id,
                  case when coalesce(len(r.pages), 0) + coalesce(len(r.page_ranges), 0) = 0 and not r.even and not r.odd
                            and r.nth is null then 'At least one removal criteria must be specified.'
                       when bad.error is not null then bad.error
                       when coalesce(k, 0) >= d.page_count then 'Cannot remove all pages from the PDF' end as error
           from remove_requests r join docs d using (doc_id) left join bad using (request_id)
                left join sizes using (request_id))
"""
)
oracle(
    "c5_remove_pages",
    ["remove_requests", "doc_pages"],
    """select f.request_id, r.doc_id, concat(p.base, '_removed_pages.pdf') as output_name, 1 as part_no,
              cast(row_number() over (partition by f.request_id order by p.page_no) as int) as out_no, p.page_no
       from faults f join remove_requests r using (request_id) join doc_pages p using (doc_id)
       where f.error is null and not exists
         (select 1 from gone g where g.request_id = f.request_id and g.page_no = p.page_no)""",
    REMOVAL,
)
oracle(
    "a5_results",
    ["remove_requests", "doc_pages"],
    "select request_id, error is null as success, error from faults",
    REMOVAL,
)

ORDERS = """
steps as (select o.request_id, o.doc_id, d.base, d.page_count as n, u.pos, try_cast(split_part(u.t, ':', 1) as int) as p,
                 try_cast(split_part(u.t, ':', 2) as int) as turn
          from organize_texts o join docs d using (doc_id), unnest(string_split(o.order_text, ';')) with ordinality as u(t, pos)),
notes as (select request_id, pos as k, concat('Page number ', p, ' is out of range (1-', n, ')') as err
          from steps where p < 1 or p > n
          union all select request_id, 1000000000 + pos, concat('Rotation must be a multiple of 90 degrees. Got: ', turn)
          from steps where turn % 90 <> 0
          union all select request_id, pos - 1000000000, 'Page number is missing' from steps where p is null
          union all select request_id, 0, 'Page order is required.' from organize_texts where order_text is null),
bad as (select request_id, string_agg(err, '; ' order by k) as error from notes group by request_id)
"""
oracle(
    "c6_organize_pages",
    ["organize_texts", "doc_pages"],
    """select s.request_id, s.doc_id, concat(s.base, '_organized.pdf') as output_name, 1 as part_no,
              cast(s.pos as int) as out_no, s.p as page_no,
              cast((q.rotation + (s.turn % 360 + 360) % 360) % 360 as int) as rotation
       from steps s join doc_pages q on q.doc_id = s.doc_id and q.page_no = s.p
       where s.request_id not in (select request_id from bad)""",
    ORDERS,
)
oracle("c6_organize_pages_errors", ["organize_texts"], "select request_id, error from bad", ORDERS)

MANIFEST = """manifest as (select doc_id, concat(base, '.pdf') as output_name, page_no as out_no, page_no, rotation from doc_pages)"""
oracle(
    "c7_rotate_pages",
    ["doc_pages", "page_marks"],
    """select m.doc_id, m.output_name, m.out_no, m.page_no, cast((m.rotation + 90 * coalesce(c.k, 0)) % 360 as int) as rotation
       from manifest m left join (select doc_id, out_no, count(*) as k from page_marks group by all) c using (doc_id, out_no)""",
    MANIFEST,
)
MARKED = (
    MANIFEST
    + """, marked as (select m.*, exists (select 1 from page_marks k where k.doc_id = m.doc_id and k.out_no = m.out_no) as hit
    from manifest m)"""
)
oracle(
    "c8_duplicate_pages",
    ["doc_pages", "page_marks"],
    """select doc_id, output_name, cast(row_number() over (partition by doc_id order by out_no, copy_no) as int) as out_no,
              page_no, rotation, copy_no
       from (select *, 0 as copy_no from marked union all select *, 1 from marked where hit) t""",
    MARKED,
)
oracle(
    "c9_delete_pages",
    ["doc_pages", "page_marks"],
    """select doc_id, output_name, cast(row_number() over (partition by doc_id order by out_no) as int) as out_no, page_no, rotation
       from (select *, bool_and(hit) over (partition by doc_id) as whole, max(out_no) over (partition by doc_id) as last
             from marked) t
       where not hit or (whole and out_no = last)""",
    MARKED,
)
oracle(
    "c10_move_page",
    ["doc_pages", "page_moves"],
    """select doc_id, output_name, cast(row_number() over (partition by doc_id order by slot) as int) as out_no, page_no, rotation
       from (select m.*, case when m.out_no = v.from_no and v.to_no <= d.page_count
                              then v.to_no + case when v.to_no > v.from_no then 0.5 else -0.5 end
                              else m.out_no end as slot
             from manifest m left join moved_once v using (doc_id) join docs d using (doc_id)) t""",
    MANIFEST
    + """, moved_once as (select * from page_moves where doc_id in (select doc_id from page_moves group by doc_id having count(*) = 1))""",
)
oracle(
    "c10_move_page_errors",
    ["doc_pages", "page_moves"],
    """select doc_id as request_id, concat_ws('; ', case when doc_id not in (select doc_id from doc_pages) then concat('File not found: ', doc_id) end,
              case when count(*) > 1 then 'Only one page can be moved at a time' end) as error
       from page_moves group by doc_id having count(*) > 1 or doc_id not in (select doc_id from doc_pages)""",
)


def merge_steps(files: str) -> str:
    return f"""
steps as (select r.request_id, u.pos, u.f as file_path, d.doc_id, d.page_count
          from merge_requests r, unnest({files}) with ordinality as u(f, pos) left join docs d on d.file_path = u.f),
bad as (select request_id, string_agg(concat('File not found: ', file_path), '; ' order by pos) as error
        from steps where doc_id is null group by request_id
        union all select request_id, 'No files provided.' from merge_requests where files is null or len(files) = 0)
"""


MERGED = """select s.request_id, s.doc_id, 'merged.pdf' as output_name, 1 as part_no,
                   cast(row_number() over (partition by s.request_id order by s.pos, p.page_no) as int) as out_no, p.page_no
            from steps s join doc_pages p on p.doc_id = s.doc_id where s.request_id not in (select request_id from bad)"""
oracle("c11_merge_docs", ["merge_requests", "doc_pages"], MERGED, merge_steps("r.files"))
ONCE = "list_filter(r.files, lambda x, k: list_position(r.files, x) = k)"
oracle("c11_merge_docs_once", ["merge_requests", "doc_pages"], MERGED, merge_steps(ONCE))
oracle(
    "c11_merge_docs_errors", ["merge_requests", "docs"], "select request_id, error from bad", merge_steps("r.files")
)

# C12 to C17: layout

SHOWN = """case when rotation in (90, 270) then y2 - y1 else x2 - x1 end as w,
           case when rotation in (90, 270) then x2 - x1 else y2 - y1 end as h"""
oracle(
    "c12_number_pages",
    ["number_requests", "doc_pages"],
    """select request_id, doc_id, output_name, page_no, label,
              round(case when position like '%Left' then 20.0::double when position like '%Right' then w - tw - 20
                         else (w - tw) / 2 end, 6) as x,
              round(case when position like 'Top%' then 20 + th else h - 20 end, 6) as y
       from (select *, len(label) * font_size * 0.5::double as tw, font_size::double as th from labelled) t""",
    f"""
    counted as (select r.*, p.page_no, p.page_count, concat(p.base, '_numbered.pdf') as output_name, {SHOWN},
                       r.start_number + p.page_no - r.start_page as n
                from number_requests r join doc_pages p using (doc_id) where p.page_no >= r.start_page),
    romans as (select *, case when n between 1 and 3999 then concat(
        repeat('M', n // 1000),
        ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1],
        ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1],
        ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1]) else cast(n as varchar) end as roman
        from counted),
    labelled as (select *, case format when 'PageOfTotal' then concat('Page ', n, ' of ', page_count)
        when 'NumberWithDash' then concat('-', n, '-') when 'RomanLower' then lower(roman) when 'RomanUpper' then roman
        else cast(n as varchar) end as label from romans)""",
)

CROPPED = (
    CROP_TOKENS.replace("spec_requests r", "crop_requests r")
    + f""",
picked as ({PICKED}),
boxes as (select r.request_id, r.doc_id, p.base, p.page_no, x1 + m_left as a1, y1 + m_bottom as b1, x2 - m_right as a2,
                 y2 - m_top as b2,
                 r.pages_range = 'all' or exists (select 1 from picked k where k.request_id = r.request_id
                                                  and k.page_no = p.page_no) as wanted
          from crop_requests r join doc_pages p using (doc_id)),
final as (select *, coalesce(wanted and a2 > a1 and b2 > b1, false) as ok from boxes)
"""
)
oracle(
    "c13_crop_pages",
    ["crop_requests", "doc_pages"],
    """select request_id, doc_id, concat(base, '_cropped.pdf') as output_name, page_no, ok as is_cropped,
              case when ok then a1 end as crop_x1, case when ok then b1 end as crop_y1, case when ok then a2 end as crop_x2,
              case when ok then b2 end as crop_y2 from final""",
    CROPPED,
)
oracle(
    "c13_crop_summary",
    ["crop_requests", "doc_pages"],
    """select request_id, doc_id, count(*) as total_pages, count(*) filter (where ok) as cropped_pages from final
       group by request_id, doc_id""",
    CROPPED,
)

COLOUR = "regexp_matches(text_color, '^#[0-9a-fA-F]{6}')"
WRONG_COLOUR = f"watermark_type = 'text' and text_color like '#%' and not {COLOUR}"
STAMPS = (
    MODE_PAGES
    + f""",
flat as (select r.*, case when watermark_type = 'image' then image_width
                else trunc(len(text) * font_size * (300 / 72.0::double) + 2 * trunc(font_size * (300 / 72.0::double) * 0.8::double)) end as fw,
                case when watermark_type = 'image' then image_height
                else trunc(font_size * (300 / 72.0::double) + 2 * trunc(font_size * (300 / 72.0::double) * 0.8::double)) end as fh,
                abs(round(cos(radians(stamp_turn)), 15)) as c, abs(round(sin(radians(stamp_turn)), 15)) as s
         from stamp_requests r where not ({WRONG_COLOUR})),
turned as (select *, case when stamp_turn in (0, 180) then fw when stamp_turn in (90, 270) then fh
                     else ceil(fw / 2.0::double + (fw * c + fh * s) / 2) - floor(fw / 2.0::double - (fw * c + fh * s) / 2) end as pw,
                  case when stamp_turn in (0, 180) then fh when stamp_turn in (90, 270) then fw
                     else ceil(fh / 2.0::double + (fw * s + fh * c) / 2) - floor(fh / 2.0::double - (fw * s + fh * c) / 2) end as ph
           from flat),
sized as (select request_id, position, case when watermark_type = 'image' then pw * image_scale / 100 else pw * 72 / 300 end as sw,
                 case when watermark_type = 'image' then ph * image_scale / 100 else ph * 72 / 300 end as sh from turned),
shown as (select e.request_id, e.doc_id, e.page_no, concat(p.base, '_watermarked.pdf') as output_name, z.position, z.sw, z.sh, {SHOWN}
          from sel e join sized z using (request_id) join doc_pages p on p.doc_id = e.doc_id and p.page_no = e.page_no)
"""
)
PLACED = """select request_id, doc_id, output_name, page_no, {tile} as tile_no, round(x, 6) as left, round(y, 6) as top,
                   round(x + sw, 6) as right, round(y + sh, 6) as bottom from ({rows}) t"""
oracle(
    "c14_place_watermark",
    ["stamp_requests", "doc_pages"],
    PLACED.format(
        tile="1",
        rows="""select *, case when position like '%Left' then w * 0.05 when position like '%Right' then w - sw - w * 0.05
                       else (w - sw) / 2 end as x,
                       case when position like 'Top%' then h * 0.05 when position like 'Bottom%' then h - sh - h * 0.05
                       else (h - sh) / 2 end as y from shown where position <> 'Tiled'""",
    ).replace("as left", 'as "left"').replace("as right", 'as "right"'),
    STAMPS,
)
oracle(
    "c15_place_tiled",
    ["stamp_requests", "doc_pages"],
    PLACED.format(
        tile="tile_no",
        rows="""select *, w / 2 - sw / 2 as x, h * share / 6 - sh / 2 as y
                from shown, (values (1, 3), (2, 1), (3, 5)) as v(tile_no, share) where position = 'Tiled'""",
    ).replace("as left", 'as "left"').replace("as right", 'as "right"'),
    STAMPS,
)
oracle(
    "c14_watermark_ink",
    ["stamp_requests"],
    """select request_id,
              case when text_color not like '#%' then 52 when {ok} then try_cast(concat('0x', substr(text_color, 2, 2)) as int) end as red,
              case when text_color not like '#%' then 152 when {ok} then try_cast(concat('0x', substr(text_color, 4, 2)) as int) end as green,
              case when text_color not like '#%' then 219 when {ok} then try_cast(concat('0x', substr(text_color, 6, 2)) as int) end as blue,
              cast(255 * opacity // 100 as int) as alpha
       from stamp_requests""".replace("{ok}", COLOUR),
)
oracle(
    "c16_watermark_summary",
    ["mode_requests", "doc_pages"],
    """select r.request_id, r.doc_id, d.page_count, cast(count(sel.page_no) as int) as watermarked_pages
       from mode_requests r join docs d using (doc_id) left join sel using (request_id)
       group by r.request_id, r.doc_id, d.page_count""",
    MODE_PAGES,
)
oracle(
    "c17_render_plan",
    ["doc_pages"],
    f"""select doc_id, page_no, concat(base, '_page_', lpad(cast(page_no as varchar), cast(greatest(3, len(cast(page_no as varchar))) as int), '0'),
               '.jpg') as image_name, cast(trunc(w * 150 / 72) as int) as pixel_width, cast(trunc(h * 150 / 72) as int) as pixel_height
        from (select *, {SHOWN} from doc_pages) t""",
)

# Requests for documents that are not there

for _key, _table in [
    ("b7_select_pages", "mode_requests"), ("b8_select_stride", "stride_requests"), ("b9_invert_selection", "spec_requests"),
    ("b12_selected_summary", "form_requests"), ("c12_number_pages", "number_requests"), ("c13_crop_pages", "crop_requests"),
    ("c16_watermark_summary", "mode_requests"),
]:
    oracle(
        f"{_key}_errors",
        [_table, "docs"],
        f"select request_id, concat('File not found: ', doc_id) as error from {_table} where doc_id not in (select doc_id from docs)",
    )
for _key, _which in (("c14_place_watermark", "<>"), ("c15_place_tiled", "=")):
    oracle(
        f"{_key}_errors",
        ["stamp_requests", "docs"],
        f"""select request_id, case when doc_id not in (select doc_id from docs) then concat('File not found: ', doc_id)
                   else concat('Invalid text color: ', text_color) end as error
            from stamp_requests where position {_which} 'Tiled' and (doc_id not in (select doc_id from docs) or {WRONG_COLOUR})""",
    )
oracle(
    "c1_split_by_ranges_errors",
    ["split_requests"],
    """select request_id, error from bad union all
       select request_id, 'Page ranges are required' from split_requests where page_ranges is null""",
    SPLIT_TOKENS,
)

# D: metadata

FIELDS = ["title", "author", "subject", "keywords", "creator", "producer"]


def clean(x: str) -> str:
    return f"nullif({strip(x)}, '')"


oracle(
    "d1_read_info",
    ["raw_metadata"],
    "select doc_id, "
    + ", ".join(f"{clean(f)} as {f}" for f in FIELDS)
    + f", {clean('creation_date')} as creation_date, {clean('mod_date')} as modification_date from raw_metadata",
)


def tag(packet: str, name: str) -> str:
    """Text of a tag by pattern: the first opening, its ``>``, then as little as possible up to the closing tag."""
    found = strip(f"regexp_extract({packet}, '(?s)^.*?<{name}[^>]*>(.*?)</{name}>', 1)")
    bare = f"regexp_replace({found}, '(?s)^<!\\[CDATA\\[(.*)\\]\\]>$', '\\1')"
    return f"case when not {blank(bare)} then {bare} end"


oracle("d2_extract_tag", [], f"select page_id, {tag('html', 'title')} as value from pages")
oracle(
    "d2_extract_tag_xmp",
    ["raw_metadata"],
    f"select doc_id, {tag('xmp', 'dc:title')} as title, {tag('xmp', 'dc:creator')} as author from raw_metadata",
)

TAGS = {"title": "dc:title", "author": "dc:creator", "subject": "dc:description", "keywords": "pdf:Keywords",
        "creator": "xmp:CreatorTool", "producer": "pdf:Producer"}


def resolved(source: str) -> str:
    none = " and ".join(f"{f} is null" for f in FIELDS)
    return f"""
plain as (select doc_id, xmp, alt_authors, alt_source_application, alt_pdf_producer, page_count,
                 {clean("creation_date")} as creation_date, {clean("mod_date")} as modification_date,
                 {", ".join(f"{clean(f)} as {f}" for f in FIELDS)} from {source}),
packet as (select * exclude ({", ".join(FIELDS)}),
                  {", ".join(f"case when {none} then {tag('xmp', TAGS[f])} else {f} end as {f}" for f in FIELDS)} from plain),
found as (select doc_id, title, case when {none} then {clean("alt_authors")} else author end as author, subject, keywords,
                 case when {none} then {clean("alt_source_application")} else creator end as creator,
                 case when {none} then {clean("alt_pdf_producer")} else producer end as producer,
                 creation_date, modification_date, page_count from packet)
"""


oracle("d3_resolve_metadata", ["raw_metadata"], "select * from found", resolved("raw_metadata"))
oracle(
    "d4_apply_metadata_edits",
    ["raw_metadata", "metadata_edits"],
    "select m.doc_id, "
    + ", ".join(
        f"case when e.given then case when not {blank(f'e.{f}')} then e.{f} end else m.{f} end as {f}" for f in FIELDS
    )
    + ", m.creation_date, m.mod_date as modification_date from raw_metadata m left join edited_once e using (doc_id)",
    "edited_once as (select * from metadata_edits where doc_id in (select doc_id from metadata_edits group by doc_id having count(*) = 1))",
)
oracle(
    "d4_apply_metadata_edits_errors",
    ["docs", "metadata_edits"],
    """select doc_id as request_id, concat_ws('; ', case when doc_id not in (select doc_id from docs) then concat('File not found: ', doc_id) end,
              case when k > 1 then 'Only one edit per document is allowed' end,
              case when k = 1 and not given then 'Metadata is required for write operation' end) as error
       from (select doc_id, count(*) as k, bool_and(given) as given from metadata_edits group by doc_id) t
       where k > 1 or not given or doc_id not in (select doc_id from docs)""",
)
STRIPPED = [*FIELDS, "creation_date", "mod_date", "alt_authors", "alt_source_application", "alt_pdf_producer", "xmp"]
oracle(
    "d5_strip_metadata",
    ["raw_metadata"],
    "select * from found",
    "cleared as (select doc_id, page_count, "
    + ", ".join(f"case when coalesce(toxic, 0) <> 1 then {c} end as {c}" for c in STRIPPED)
    + " from raw_metadata left join labels using (doc_id)),"
    + resolved("cleared"),
)


def shown_date(x: str) -> str:
    return f"""case when coalesce({x}, '') = '' then 'Not set' when not starts_with({x}, 'D:') then {x}
               else concat(substr({x}, 3, 4), '-', substr({x}, 7, 2), '-', substr({x}, 9, 2), ' ', substr({x}, 11, 2), ':',
                           substr({x}, 13, 2), ':', substr({x}, 15, 2)) end"""


oracle(
    "d6_format_pdf_date",
    ["raw_metadata"],
    f"""select doc_id, {shown_date("creation_date")} as created, {shown_date("mod_date")} as modified,
               try_strptime(regexp_extract(creation_date, '^D:([0-9]{{14}})', 1), '%Y%m%d%H%M%S') as created_at
        from raw_metadata""",
)
oracle(
    "d7_metadata_completeness",
    ["raw_metadata"],
    """select doc_id, concat(case when title is null then 'title' end,
                             case when title is null and author is null then ',' end,
                             case when author is null then 'author' end) as missing,
              title is not null and author is not null as is_complete from found""",
    resolved("raw_metadata"),
)

# E: images

IMAGE_SELECTION = LIST_TOKENS + f", sel as ({PICKED})"
oracle(
    "e1_extractable_images",
    ["list_requests", "doc_pages", "page_images"],
    """select s.request_id, i.doc_id, i.page_no, i.img_index, i.xref, i.width, i.height,
              concat('page_', i.page_no, '_image_', lpad(cast(i.img_index as varchar), 4, '0'), '.png') as image_name
       from sel s join page_images i on i.doc_id = s.doc_id and i.page_no = s.page_no
       where i.n_components - cast(i.has_alpha as int) < 4""",
    IMAGE_SELECTION,
)
oracle(
    "e2_extraction_summary",
    ["list_requests", "doc_pages", "page_images"],
    """select r.request_id, r.doc_id, cast((select count(*) from sel s join page_images i using (doc_id, page_no)
                 where s.request_id = r.request_id and i.n_components - cast(i.has_alpha as int) < 4) as int) as extracted_count,
              cast((select count(*) from sel s where s.request_id = r.request_id) as int) as processed_pages
       from list_requests r join docs using (doc_id)""",
    IMAGE_SELECTION,
)
oracle(
    "e3_remove_images",
    ["list_requests", "doc_pages", "page_images"],
    """select r.request_id, i.doc_id, i.page_no, i.img_index, i.xref from list_requests r join page_images i using (doc_id)
       where not exists (select 1 from sel s join page_images o on o.doc_id = s.doc_id and o.page_no = s.page_no
                         where s.request_id = r.request_id and o.xref = i.xref)""",
    IMAGE_SELECTION,
)
oracle(
    "e3_removal_summary",
    ["list_requests", "doc_pages", "page_images"],
    """select r.request_id, r.doc_id, cast((select count(distinct i.xref) from sel s join page_images i using (doc_id, page_no)
                 where s.request_id = r.request_id) as int) as removed_count,
              cast((select count(*) from sel s where s.request_id = r.request_id) as int) as processed_pages
       from list_requests r join docs using (doc_id)""",
    IMAGE_SELECTION,
)

SHRUNK = """
asked as (select *, case doc_id % 4 when 0 then 50 when 1 then 75 when 2 then 90
                    else case when doc_id % 3 > 0 then 1 + doc_id % 60 else 75 end end as q from page_images),
tier as (select *, case when q <= 10 then 400 when q <= 30 then 600 when q <= 50 then 800 else 1024 end as lim,
                case when q <= 10 then 5 when q <= 30 then 10 when q <= 50 then 20 else greatest(30, q) end as jpeg from asked),
scale as (select *, case when width > lim or height > lim then least(lim / width::double, lim / height::double)
                    else 0.8::double end as f from tier),
plan as (select *, width * height >= 1000 as small_no,
                case when width * height >= 1000 then cast(trunc(width * f) as bigint) else width end as new_width,
                case when width * height >= 1000 then cast(trunc(height * f) as bigint) else height end as new_height from scale)
"""
oracle(
    "e4_recompress_plan",
    ["page_images"],
    """select doc_id, xref, case when small_no then 'recompress' else 'keep' end as action, new_width, new_height,
              cast(case when small_no then jpeg else 0 end as int) as jpeg_quality, min(page_no) as first_page, count(*) as uses
       from plan group by all""",
    SHRUNK,
)
oracle(
    "e5_dedupe_images",
    ["page_images"],
    """select doc_id, page_no, img_index, new_width, new_height,
              row_number() over (partition by doc_id, new_width, new_height order by page_no, img_index) > 1 as is_duplicate
       from plan""",
    SHRUNK,
)


def sized(x: str) -> str:
    step = f"(case {' '.join(f'when {x} < {1024 ** k} then {k - 1}' for k in range(1, 7))} else 6 end)"
    value = f"floor({x} / pow(1024.0::double, {step}) * 100 + 0.5::double) / 100"
    return f"""case when {x} = 0 then '0 Bytes' else concat(regexp_replace(printf('%.2f', {value}), '\\.?0+$', ''), ' ',
               ['Bytes', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB'][{step} + 1]) end"""


oracle(
    "e6_compression_outcome",
    ["compress_sizes"],
    f"""select doc_id, original_size, compressed_size, compressed_size >= original_size as kept_original, final_size,
               case when original_size = final_size then 0.0::double
                    else round_even((original_size - final_size) / original_size::double * 100 * 100, 0) / 100 end as compression_ratio,
               {sized("original_size")} as original_text, {sized("final_size")} as final_text,
               printf('%.2f', original_size / 1048576.0::double) as original_mb
        from (select *, least(original_size, compressed_size) as final_size from compress_sizes) t""",
)

# F: search index

INDEX = """
every as (select owner, file_path, count(*) as open_count, max(ts) as last_opened,
                 regexp_extract(file_path, '[^/]*$') as file_name from {opens} group by owner, file_path),
idx as (select * from every qualify row_number() over (partition by owner order by last_opened desc, file_path) <= 100)
"""
HITS = (
    INDEX.format(opens="open_events")
    + """,
hits as (select q.owner, q.query, i.file_path, i.open_count, contains(lower(i.file_name), lower(q.query)) as name_match,
                cast(row_number() over (partition by q.owner, q.query order by contains(lower(i.file_name), lower(q.query)) desc,
                                        i.last_opened desc, i.file_path) as int) as rank
         from search_queries q join idx i on i.owner = q.owner and contains(lower(i.file_path), lower(q.query))
         where trim(q.query) <> '')
"""
)
oracle(
    "f1_build_index",
    ["open_events"],
    "select owner, file_path, open_count, last_opened, file_name from every",
    INDEX.format(opens="open_events"),
)
for _key in ("f2_cap_index", "f7_stream_index", "f7_bounded_index"):
    oracle(
        _key,
        ["open_events"],
        "select owner, file_path, open_count, last_opened, file_name from idx",
        INDEX.format(opens="open_events"),
    )
oracle("f3_search_index", ["open_events", "search_queries"],
       "select owner, query, rank, file_path, open_count, name_match from hits", HITS)
oracle("f4_top_hits", ["open_events", "search_queries"],
       "select owner, query, rank, file_path from hits where rank <= 8", HITS)
oracle(
    "f5_flag_missing",
    ["open_events", "search_queries", "open_files"],
    """select owner, query, rank, file_path, coalesce(file_size, 0) = 0 as is_missing
       from hits left join open_files using (file_path) where rank <= 8""",
    HITS,
)
RECORDED = """
recorded as (select o.owner, o.file_path, o.ts from open_events o
             where coalesce((select arg_max(c.action, c.ts) from index_control c
                             where c.owner = o.owner and c.ts <= o.ts and c.action in ('enable', 'disable')), 'disable') = 'enable'
               and o.ts >= coalesce((select max(c.ts) from index_control c where c.owner = o.owner and c.action = 'clear'),
                                    timestamp '1900-01-01'))
"""
oracle("f6_effective_opens", ["open_events", "index_control"], "select owner, file_path, ts from recorded", RECORDED)
oracle(
    "f6_enabled_index",
    ["open_events", "index_control"],
    """select owner, file_path, file_name, open_count, last_opened from idx
       where owner in (select owner from index_control where action in ('enable', 'disable') group by owner
                       having arg_max(action, ts) = 'enable')""",
    RECORDED + "," + INDEX.format(opens="recorded"),
)

# A: sources

oracle(
    "a1_scan_pdf_files",
    ["file_listing"],
    """select path as file_path, name as file_name, regexp_replace(name, '\\.[^.]*$', '') as base, length as file_size
       from (select *, regexp_extract(path, '[^/\\\\]*$') as name from file_listing) t
       where regexp_matches(path, '\\.[pP][dD][fF]$')""",
)
oracle(
    "a2_classify_security",
    ["file_listing"],
    """select path as file_path, contains(body, '/Encrypt') as is_encrypted,
              case when not contains(body, '/Encrypt') then true end as can_be_processed from file_listing""",
)
PDF_FILES = "found as (select doc_id, name, body, strlen(body) as n from pdf_files where regexp_matches(lower(name), '[.]pdf$') and body <> '')"
oracle(
    "a1_scan_written_files",
    ["pdf_files"],
    """select concat('/', name) as file_path, regexp_extract(name, '[^/]*$') as file_name,
              regexp_replace(regexp_extract(name, '[^/]*$'), '[.][^.]*$', '') as base, n as file_size from found""",
    PDF_FILES,
)
oracle(
    "a2_scan_security",
    ["pdf_files"],
    """select name as file_path, contains(body, '/Encrypt') as is_encrypted, case when not contains(body, '/Encrypt') then true end as can_be_processed
       from found""",
    PDF_FILES,
)
oracle("a2_scan_security_errors", ["pdf_files"], "select name as file_path, 'File is too large to read' as error from found where n > 6000", PDF_FILES)
oracle(
    "f5_flag_missing_files",
    ["docs", "pdf_files"],
    """select d.doc_id % 9 as owner, d.file_path, f.doc_id is null as is_missing
       from docs d left join found f on d.file_path = concat('/', f.name)""",
    PDF_FILES,
)
oracle(
    "a3_read_requests",
    ["number_requests"],
    """select request_id, doc_id, case position when 'Elsewhere' then 'BottomCenter' else position end as position,
              case format when 'Other' then 'Number' else format end as format,
              case when font_size > 20 then font_size else 12 end as font_size, start_page, 1 as start_number
       from number_requests where request_id % 13 <> 5 and request_id % 17 <> 3""",
)
oracle(
    "a3_read_requests_errors",
    ["number_requests"],
    """select case when request_id % 13 = 5 then request_id end as request_id, concat('Request cannot be read: ',
              case when request_id % 13 = 5 then concat('{"request_id":', request_id, ',"font_size":"big"}') else 'not json' end) as error
       from number_requests where request_id % 13 = 5 or request_id % 17 = 3""",
)

# G: validation

VALID = f"""
t as (select r.*, d.doc_id is not null as there, d.page_count as n,
              case when tool in ('split', 'remove', 'organize', 'compress') then file_path = '' else {blank("file_path")} end as unset
       from tool_requests r left join docs d using (file_path)),
turns as (select request_id, u.pos, cast(split_part(u.x, ':', 1) as int) as p, cast(split_part(u.x, ':', 2) as int) as turn
          from t, unnest(string_split(order_text, ';')) with ordinality as u(x, pos) where tool = 'organize' and has_options),
listed as (select request_id, u.pos, u.f from t, unnest(files) with ordinality as u(f, pos)
           where tool = 'merge' and not exists (select 1 from docs d where d.file_path = u.f)),
notes as (
  select request_id, 1 as k, case when tool in ('split', 'remove', 'organize', 'compress')
         then 'Invalid request. File path is required.' else 'File path is required.' end as err
  from t where tool not in ('merge', 'images') and unset
  union all select request_id, 2, concat('File not found: ', file_path) from t
  where tool not in ('merge', 'images') and not unset and not there
  union all select request_id, 3, 'Page ranges are required' from t
  where tool = 'split' and method = 'ByPageRanges' and page_ranges is null
  union all select request_id, 3, 'Split pages are required' from t
  where tool = 'split' and method = 'AtSpecificPages' and split_points is null
  union all select request_id, 3, 'Valid page interval is required' from t
  where tool = 'split' and method = 'EveryNPages' and page_interval < 1
  union all select request_id, 3, 'Invalid split method' from t where tool = 'split' and method = 'Other'
  union all select request_id, 3, 'At least one removal criteria must be specified.' from t
  where tool = 'remove' and has_options and pages is null and page_ranges is null and not even and not odd and nth is null
  union all select request_id, 4, concat('Page number ', list_filter(pages, lambda p: p < 1 or p > n)[1], ' is out of range (1-', n, ')')
  from t where tool = 'remove' and has_options and len(list_filter(pages, lambda p: p < 1 or p > n)) > 0
  union all select request_id, 3, 'Page order is required.' from t where tool = 'organize' and has_options and order_text is null
  union all select request_id, 3, concat(case tool when 'remove' then 'Remove' else 'Organize' end, ' options are required.') from t
  where tool in ('remove', 'organize') and not has_options
  union all select request_id, 4, concat(case tool when 'lock' then 'Lock' else 'Unlock' end, ' options are required for ', tool, 'ing operation')
  from t where tool in ('lock', 'unlock') and not has_options
  union all select s.request_id, 4, concat('Page number ', arg_min(s.p, s.pos), ' is out of range (1-', any_value(t.n), ')')
  from turns s join t using (request_id) where s.p < 1 or s.p > t.n group by s.request_id
  union all select request_id, 5, concat('Rotation must be a multiple of 90 degrees. Got: ', arg_min(turn, pos))
  from turns where turn % 90 <> 0 group by request_id
  union all select request_id, 1, 'No files provided.' from t where tool = 'merge' and files is null
  union all select request_id, 2, concat('File not found: ', arg_min(f, pos)) from listed group by request_id
  union all select request_id, 3, 'Font size must be between 8 and 72.' from t
  where tool = 'numbers' and not coalesce(font_size between 8 and 72, false)
  union all select request_id, 3, 'Opacity must be between 1 and 100.' from t
  where tool in ('watermark', 'image_watermark') and opacity not between 1 and 100
  union all select request_id, 4, 'Font size must be between 8 and 144.' from t
  where tool = 'watermark' and not coalesce(font_size between 8 and 144, false)
  union all select request_id, 4, 'Image file is required for image watermarks.' from t
  where tool = 'image_watermark' and image_size = 0
  union all select request_id, 5, 'Invalid image format. Supported formats: PNG, JPG, JPEG, GIF, BMP' from t
  where tool = 'image_watermark' and image_size > 0
    and regexp_extract(lower(image_name), '\\.[^.]*$') not in ('.png', '.jpg', '.jpeg', '.gif', '.bmp')
  union all select request_id, 6, 'Image file size must be less than 10MB.' from t
  where tool = 'image_watermark' and image_size > 10485760
  union all select request_id, 3, 'DPI must be between 1 and 600.' from t where tool = 'render' and dpi not between 1 and 600
  union all select request_id, 4, 'Format must be ''jpg'' or ''png''.' from t
  where tool = 'render' and lower(image_format) not in ('jpg', 'jpeg', 'png')
  union all select request_id, 3, 'Compress options are required.' from t where tool = 'compress' and not has_options
  union all select request_id, 4, 'Custom quality must be between 1 and 100.' from t
  where tool = 'compress' and has_options and quality = 'Custom' and coalesce(custom_quality, 0) not between 1 and 100
  union all select request_id, 3, 'Operation is required (read or write).' from t where tool = 'metadata' and {blank("operation")}
  union all select request_id, 4, concat('Invalid operation: ', operation) from t
  where tool = 'metadata' and not {blank("operation")} and lower(operation) not in ('read', 'write')
  union all select request_id, 5, 'Metadata is required for write operation' from t
  where tool = 'metadata' and lower(operation) = 'write' and not has_options
  union all select request_id, 1, 'Invalid file path.' from t where tool = 'images' and not there
  union all select request_id, 2, 'Options are required.' from t where tool = 'images' and not has_options
  union all select request_id, 3, concat('Operation must be ''', tool, ''' for this endpoint.') from t
  where tool in ('lock', 'unlock') and lower(operation) <> tool
  union all select request_id, 4, case tool when 'lock' then 'Open password is required for locking PDF'
                                  else 'Password is required for unlocking PDF' end from t
  where tool in ('lock', 'unlock') and has_options and {blank("password")}
  union all select request_id, 5, 'Open password must be at least 3 characters long' from t
  where tool = 'lock' and has_options and not {blank("password")} and len(password) < 3
  union all select request_id, 3, concat('Please enter valid margin values for: ', array_to_string(unset, ', '))
  from (select request_id, list_filter([case when not regexp_matches(m_top, '^\\s*[+-]?[0-9]') then 'Top' end,
                                        case when not regexp_matches(m_right, '^\\s*[+-]?[0-9]') then 'Right' end,
                                        case when not regexp_matches(m_bottom, '^\\s*[+-]?[0-9]') then 'Bottom' end,
                                        case when not coalesce(regexp_matches(m_left, '^\\s*[+-]?[0-9]'), false) then 'Left' end],
                                       lambda x: x is not null) as unset
        from t where tool = 'crop') c where len(unset) > 0
  union all select request_id, 4, 'Please enter a custom page range or select "All Pages".' from t
  where tool = 'crop' and pages_range = 'custom' and {blank("custom_pages")}),
said as (select request_id, string_agg(err, '; ' order by k) as error from notes group by request_id)
"""
oracle(
    "g1_validate_requests",
    ["tool_requests"],
    "select t.request_id, t.tool, error is null as success, error from tool_requests t left join said using (request_id)",
    VALID,
)
oracle(
    "g1_validate_on_files",
    ["tool_requests", "pdf_files"],
    "select t.request_id, t.tool, error is null as success, error from tool_requests t left join said using (request_id)",
    PDF_FILES + ",\n" + VALID.replace("left join docs d using (file_path)", "left join present d using (file_path)")
    .replace("from docs d where d.file_path = u.f", "from present d where d.file_path = u.f")
    .replace("\nt as (", "\npresent as (select d.* from docs d join found f on d.file_path = concat('/', f.name)),\nt as (", 1).lstrip(),
)
oracle(
    "a5_result_counts",
    ["tool_requests"],
    "select count(*) as requests, count(*) filter (error is null) as succeeded, count(error) as failed from tool_requests left join said using (request_id)",
    VALID,
)
oracle(
    "a5_results_json",
    ["tool_requests"],
    "select t.request_id, error is null as success, error from tool_requests t left join said using (request_id)",
    VALID,
)

# F2, F7 with files that fall out: an open counts from the last gap in which a hundred other files were opened.
for _key in ("f2_recent_index", "f7_recent_index"):
    oracle(
        _key,
        ["open_events"],
        """select p.owner, p.file_path, cast(sum(p.times) as bigint) as open_count, max(p.ts) as last_opened,
                  regexp_extract(p.file_path, '[^/\\\\]*$') as file_name
           from placed p join starts s on s.owner = p.owner and s.file_path = p.file_path and p.place >= s.place
           group by p.owner, p.file_path
           qualify row_number() over (partition by p.owner order by max(p.ts) desc, p.file_path) <= 100""",
        """summed as (select owner, file_path, ts, count(*) as times from open_events group by owner, file_path, ts),
ordered as (select *, row_number() over (partition by owner order by ts, file_path desc) as place from summed),
placed as (select *, lag(place) over (partition by owner, file_path order by place) as prev from ordered),
fresh as (select g.owner, g.file_path, g.place from placed g join placed o
          on o.owner = g.owner and o.place > g.prev and o.place < g.place and coalesce(o.prev, 0) < g.prev
          group by g.owner, g.file_path, g.place having count(*) >= 100),
starts as (select owner, file_path, max(place) as place
           from (select owner, file_path, place from placed where prev is null union all select * from fresh) group by owner, file_path)""",
    )

# C7 to C10 click by click: the pages of a document as a list, which each click makes anew.
PAGE = "{'id': cast(i as bigint), 'page': cast(i as int), 'turn': 0}"
oracle(
    "c7_click_log",
    ["docs", "clicks"],
    """select doc_id, cast(u.place as int) as out_no, u.p.page as page_no, u.p.turn as rotation, u.p.id as page_id
       from tables_of t, unnest(t.ps) with ordinality as u(p, place) where t.step = 12""",
    f"""bad as (select distinct doc_id from clicks where action = 'fold'),
log as (select * from clicks where doc_id not in (select doc_id from bad)),
tables_of as (
  with recursive steps as (
    select doc_id, 0 as step, page_count as n, cast(page_count + 1 as bigint) as free,
           list_transform(range(1, page_count + 1), lambda i: {PAGE}) as ps
    from docs where doc_id in (select doc_id from log)
    union all
    select s.doc_id, s.step + 1, s.n,
           case when c.action = 'reset' then s.n + 1 when c.action = 'duplicate' and here > 0 then s.free + 1 else s.free end,
           case when c.action = 'reset' then list_transform(range(1, s.n + 1), lambda i: {PAGE})
                when coalesce(here, 0) = 0 then s.ps
                when c.action = 'rotate' then s.ps[1:here - 1] || [{{'id': s.ps[here].id, 'page': s.ps[here].page, 'turn': (s.ps[here].turn + 90) % 360}}] || s.ps[here + 1:]
                when c.action = 'duplicate' then s.ps[1:here] || [{{'id': s.free, 'page': s.ps[here].page, 'turn': s.ps[here].turn}}] || s.ps[here + 1:]
                when c.action = 'delete' and len(s.ps) > 1 then s.ps[1:here - 1] || s.ps[here + 1:]
                when c.action = 'move' and here <> goal and goal > 0
                  then (s.ps[1:here - 1] || s.ps[here + 1:])[1:goal - 1] || [s.ps[here]] || (s.ps[1:here - 1] || s.ps[here + 1:])[goal:]
                else s.ps end
    from steps s join log c on c.doc_id = s.doc_id and c.seq = s.step + 1,
         lateral (select list_position(list_transform(s.ps, lambda p: p.id), c.page_id) as here,
                         list_position(list_transform(s.ps, lambda p: p.id), c.target_id) as goal) as spot)
  select * from steps)""",
)
oracle(
    "c7_click_log_errors",
    ["docs", "clicks"],
    """select c.doc_id as request_id, concat_ws('; ', case when any_value(d.doc_id) is null then concat('File not found: ', c.doc_id) end,
              case when max(case when action = 'fold' then 1 else 0 end) = 1 then 'Unknown action: fold' end) as error
       from clicks c left join docs d on d.doc_id = c.doc_id group by c.doc_id
       having any_value(d.doc_id) is null or max(case when action = 'fold' then 1 else 0 end) = 1""",
)

ORACLES["d4_rewrite_metadata"] = ORACLES["d4_apply_metadata_edits"]
oracle(
    "a4_bucketed_manifest",
    ["doc_pages"],
    "select doc_id, output_name, part_no, out_no, page_no, count(*) over (partition by output_name) as output_pages from ("
    + EVERY.format(head="", n=5, source="doc_pages")
    + ") t",
)
oracle(
    "a4_manifest_by_output",
    ["doc_pages"],
    """select doc_id, concat('shelf-', doc_id % 10, '.pdf') as output_name, cast(doc_id as int) as part_no, page_no as out_no, page_no
       from doc_pages""",
)

# C12 with a font's advances; half an em for characters it lacks
EM = """(select coalesce(sum(coalesce(g.advance, 500)), 0) / 1000::double
         from (select unnest(string_split({text}, '')) as c) u left join glyphs g on g.glyph = u.c)"""
oracle("c12_measure_texts", ["docs", "glyphs"], f"""
    select text, font_size, round({EM.format(text="t.text")} * font_size, 6) as width, cast(font_size as double) as height
    from (select distinct file_name as text, doc_id % 60 + 8 as font_size from docs) t""")
_plain = ["number_requests", "doc_pages"]
ORACLES["c12_number_pages_glyphs"] = (
    ORACLES["c12_number_pages"]
    .replace(with_clause(_plain).rstrip(), with_clause([*_plain, "glyphs"]).rstrip(), 1)
    .replace("len(label) * font_size * 0.5::double as tw", EM.format(text="l.label") + " * font_size as tw")
    .replace("from labelled) t", "from labelled l) t")
)

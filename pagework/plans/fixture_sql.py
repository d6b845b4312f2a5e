"""Input tables of the registered queries, defined over the driver's tables.

Each text is SQL that Spark and DuckDB read alike; ``{name}`` stands for a table or an earlier definition. The few words
that differ are written ``@WORD@`` and listed per engine below. Every table has as many rows as the driver's table it
comes from, or more.
"""

from __future__ import annotations

import re

WORDS = {
    "spark": {
        "PAGE_NUMBERS": "explode(sequence(1, page_count))",
        "IMAGE_SLOTS": "explode(sequence(0, 2))",
        "CLICK_NUMBERS": "explode(sequence(1, 12))",
        "INTS": "array<int>",
        "NULLED": "transform(",
        "NO_FILES": "cast(array() as array<string>)",
        "TILDES": ", t -> nullif(t, '~'))",
        "REVERSED": "array_join(transform(sequence(page_count, 1, -1), i -> concat(cast(i as varchar(20)), ':90')), ';')",
        "IN_ORDER": "array_join(transform(sequence(1, page_count), i -> concat(cast(i as varchar(20)), ':0')), ';')",
    },
    "duckdb": {
        "PAGE_NUMBERS": "unnest(generate_series(1, page_count))",
        "IMAGE_SLOTS": "unnest(generate_series(0, 2))",
        "CLICK_NUMBERS": "unnest(generate_series(1, 12))",
        "INTS": "integer[]",
        "NULLED": "list_transform(",
        "NO_FILES": "cast([] as varchar[])",
        "TILDES": ", lambda t: nullif(t, '~'))",
        "REVERSED": "array_to_string(list_transform(range(page_count, 0, -1), lambda i: concat(cast(i as varchar), ':90')), ';')",
        "IN_ORDER": "array_to_string(list_transform(range(1, page_count + 1), lambda i: concat(cast(i as varchar), ':0')), ';')",
    },
}

SQL: dict[str, str] = {}

SQL["docs"] = """
select doc_id,
       concat('/corpus/', source, '/', lang, '_', cast(doc_id as varchar(20)), '.pdf') as file_path,
       concat(lang, '_', cast(doc_id as varchar(20)), '.pdf') as file_name,
       concat(lang, '_', cast(doc_id as varchar(20))) as base,
       cast(case when doc_id % 50 = 0 then 0 else n_chars end as bigint) as file_size,
       cast(ceil(n_chars / 1000.0) as int) as page_count
from {documents}
"""

SQL["doc_pages"] = """
select doc_id, cast(page_no as int) as page_no, page_count, base, cast((doc_id % 4) * 90 as int) as rotation,
       cast(0 as double) as x1, cast(0 as double) as y1,
       cast(case doc_id % 3 when 0 then 595 when 1 then 612 else 60 end as double) as x2,
       cast(case doc_id % 3 when 0 then 842 when 1 then 792 else 60 end as double) as y2
from (select doc_id, page_count, base, @PAGE_NUMBERS@ as page_no from {docs} where page_count >= 1) t
"""

SQL["page_images"] = """
select doc_id, page_no, img_index, xref,
       cast(case when xref % 77 = 0 then 0 when xref % 7 = 0 then 30 else 20 + (xref * 37) % 1500 end as bigint) as width,
       cast(case when xref % 77 = 0 then 2000 when xref % 7 = 0 then 25 else 20 + (xref * 53) % 1100 end as bigint) as height,
       case xref % 6 when 0 then 4 when 1 then 1 else 3 end as n_components,
       xref % 12 = 0 as has_alpha
from (select doc_id, page_no, cast(k as int) as img_index, doc_id * 10 + (page_no * 7 + k) % 5 as xref
      from (select doc_id, page_no, @IMAGE_SLOTS@ as k from {doc_pages}) s
      where k < (doc_id + page_no) % 4) t
"""

SQL["raw_metadata"] = """
select doc_id,
       case doc_id % 3 when 0 then concat(' Title ', cast(doc_id as varchar(20)), ' ') when 1 then '  ' end as title,
       case when doc_id % 6 = 0 then source end as author,
       case when doc_id % 12 = 0 then concat(lang, ' notes') end as subject,
       case when doc_id % 3 = 0 then lang end as keywords,
       case when doc_id % 15 = 0 then concat(chr(9), 'writer', chr(160)) end as creator,
       case when doc_id % 21 = 0 then 'press' when doc_id % 3 = 1 then chr(160) end as producer,
       case when doc_id % 2 = 0 then concat('D:20240131123059+02', chr(39), '00', chr(39))
            when doc_id % 5 = 0 then '2024' end as creation_date,
       case when doc_id % 7 = 0 then 'D:202402' when doc_id % 11 = 0 then '' end as mod_date,
       case when doc_id % 3 = 2 then concat('Alt ', source) end as alt_authors,
       case when doc_id % 9 = 2 then 'app' end as alt_source_application,
       case when doc_id % 9 = 5 then 'maker' end as alt_pdf_producer,
       case when doc_id % 3 = 1 then concat('<x><dc:title a="1"> Xmp ', cast(doc_id as varchar(20)), ' </dc:title>',
            case when doc_id % 2 = 0 then '<dc:creator><![CDATA[Ann]]></dc:creator>' else '<dc:creator>open' end,
            case when doc_id % 4 = 0 then '<dc:descriptionX>On <b>pages</b></dc:description>' else '' end,
            case when doc_id % 5 = 0 then '<xmp:CreatorTool> </xmp:CreatorTool><pdf:Producer><![CDATA[ ]]></pdf:Producer>'
                 else '<pdf:Producer>q</pdf:Producer>' end, '</x>')
            end as xmp,
       cast(ceil(n_chars / 1000.0) as int) as page_count
from {documents}
"""

SQL["metadata_edits"] = """
select case when doc_id % 41 = 7 then -doc_id when doc_id % 37 = 5 then doc_id - 1 else doc_id end as doc_id, quality = 1 or toxic = 1 as given,
       concat('Edited ', cast(quality as varchar(20)), ' ') as title,
       case when toxic = 1 then ' ' else 'Ann' end as author,
       cast(null as varchar(20)) as subject,
       case when quality = 1 then '' else 'kept' end as keywords,
       cast(null as varchar(20)) as creator,
       case when quality = 1 then 'maker' end as producer
from {labels}
"""

SQL["split_requests"] = """
select doc_id as request_id, doc_id,
       @NULLED@split(case doc_id % 9
             when 0 then '1-2;2;1-1' when 1 then '2-1' when 2 then 'x;~;1' when 3 then '0;~'
             when 4 then '1-99999; +1 '
             when 5 then concat('1-', cast(page_count as varchar(20)))
             when 6 then concat(' ', cast(page_count as varchar(20)), ' ; 1 - ', cast(page_count as varchar(20)))
             when 7 then '1-2-3;-3;99999' end, ';')@TILDES@ as page_ranges,
       cast(@NULLED@split(case doc_id % 7
             when 0 then '2;1' when 1 then '1;1' when 2 then '99999' when 3 then '1'
             when 4 then cast(page_count - 1 as varchar(20)) when 5 then '~;1' end, ';')@TILDES@ as @INTS@) as split_points,
       case doc_id % 5 when 0 then 1 when 1 then 3 when 2 then 0 when 3 then 2 end as page_interval
from {docs}
"""

SQL["remove_requests"] = """
select doc_id as request_id, doc_id,
       cast(@NULLED@split(case doc_id % 13 when 0 then '1' when 1 then '1;2;1' when 2 then '99999;~' when 9 then '2' end, ';')@TILDES@
            as @INTS@) as pages,
       @NULLED@split(case doc_id % 13
             when 1 then '2-3' when 3 then '1-1;2-4' when 4 then '2' when 5 then 'a-b;3-1;~'
             when 6 then concat('1-', cast(page_count as varchar(20)))
             when 9 then concat(' ', cast(page_count as varchar(20)), ' - ', cast(page_count as varchar(20))) end, ';')@TILDES@
           as page_ranges,
       doc_id % 13 in (7, 9) as even,
       doc_id % 13 = 8 as odd,
       case doc_id % 13 when 9 then 3 when 10 then 2 when 11 then 3 when 12 then 0 end as nth,
       case doc_id % 13 when 10 then 3 when 11 then 2 - cast(doc_id % 7 as int) end as start
from {docs}
"""

# One document in 29 is asked for under a number that no document has.
MISSING = "case when doc_id % 29 = 28 then -doc_id else doc_id end as doc_id"

SQL["spec_requests"] = f"""
select doc_id as request_id, {MISSING},
       case doc_id % 17
         when 0 then '1-5,7,9-12' when 1 then ' 3 - 1 ,2' when 2 then 'x,4,5-' when 3 then '-3' when 4 then '--2-4'
         when 5 then '' when 6 then '8' when 7 then '1-2-3' when 8 then '10-7, 7' when 9 then '1 ,, 2'
         when 10 then '3abc,2' when 11 then '2-99999999999,1' when 12 then '4-2,3-3,+1'
         when 13 then concat(cast(page_count as varchar(20)), ',1-', cast(page_count + 1 as varchar(20)))
         when 14 then concat('1-', cast(page_count as varchar(20)), ',2') when 15 then '2 -3,1- 2' else '0x2,1-0x3,0x00000000000000004,0xfffffffffffffffff' end
         as custom_pages
from {{docs}}
"""

SQL["list_requests"] = """
select doc_id as request_id, doc_id,
       cast(split(case doc_id % 6 when 0 then '1;3;99999' when 1 then '0;2' when 2 then '1' end, ';') as @INTS@) as pages,
       case when doc_id % 5 <> 4 then split(custom_pages, ',') end as page_ranges
from {spec_requests}
"""

SQL["form_requests"] = """
select doc_id as request_id, doc_id, custom_pages as pages_text,
       case when doc_id % 3 <> 2 then custom_pages else '' end as ranges_text
from {spec_requests}
"""

SQL["mode_requests"] = """
select doc_id as request_id, doc_id,
       case doc_id % 5 when 0 then 'all' when 1 then 'first' when 2 then 'last' when 3 then 'custom' else 'range' end
         as mode,
       case when doc_id % 2 = 0 then custom_pages else '' end as custom_pages,
       cast(doc_id % 8 - 2 as int) as start_page,
       cast(doc_id % 6 - 1 as int) as end_page
from {spec_requests}
"""

SQL["stride_requests"] = f"""
select doc_id as request_id, {MISSING}, doc_id % 3 = 0 as even, doc_id % 7 = 0 as odd,
       case when doc_id % 4 < 3 then cast(doc_id % 4 as int) + 1 when doc_id % 8 = 3 then 0 end as nth,
       case when doc_id % 5 < 2 then cast(doc_id % 11 as int) - 3 end as start
from {{docs}}
"""

SQL["organize_texts"] = """
select doc_id as request_id, doc_id,
       case doc_id % 8
         when 0 then @IN_ORDER@ when 1 then @REVERSED@ when 2 then '1:0;1:-90;1:450' when 3 then '1:45'
         when 4 then '99999:0;~;1:30' when 6 then concat(cast(page_count as varchar(20)), ':180;1:270') when 7 then '0:90'
       end as order_text
from {docs}
"""

SQL["merge_requests"] = """
select request_id, case when request_id % 45 = 8 then @NO_FILES@ else files_given end as files from (
select a.doc_id as request_id,
       split(case a.doc_id % 5
         when 0 then concat(a.file_path, ';', a.file_path)
         when 1 then concat(a.file_path, ';/corpus/none.pdf;', coalesce(b.file_path, '/corpus/last.pdf'))
         when 2 then coalesce(b.file_path, a.file_path)
         when 3 then concat(coalesce(b.file_path, a.file_path), ';', a.file_path, ';', coalesce(b.file_path, a.file_path))
       end, ';') as files_given
from {docs} a left join {docs} b on b.doc_id = a.doc_id + 1) t
"""

SQL["page_marks"] = """
select l_orderkey as doc_id, l_linenumber as out_no from {lineitem}
"""

SQL["page_moves"] = """
select doc_id, cast(1 + (doc_id * 7) % page_count as int) as from_no,
       cast(case when doc_id % 20 = 0 then page_count + 1 else 1 + (doc_id * 11) % page_count end as int) as to_no
from {docs} where page_count >= 1
union all select doc_id, 1, 1 from {docs} where doc_id % 31 = 30
union all select -1 - doc_id, 1, 2 from {docs} where doc_id % 97 = 5
"""

SQL["number_requests"] = f"""
select doc_id as request_id, {MISSING},
       case doc_id % 7 when 0 then 'TopLeft' when 1 then 'TopCenter' when 2 then 'TopRight' when 3 then 'BottomLeft'
            when 4 then 'BottomCenter' when 5 then 'BottomRight' else 'Elsewhere' end as position,
       case doc_id % 6 when 0 then 'Number' when 1 then 'PageOfTotal' when 2 then 'NumberWithDash'
            when 3 then 'RomanLower' when 4 then 'RomanUpper' else 'Other' end as format,
       cast(8 + doc_id % 65 as int) as font_size,
       cast(1 + doc_id % 3 as int) as start_page,
       cast((doc_id * 13) % 4100 - 20 as int) as start_number
from {{docs}}
"""

SQL["crop_requests"] = """
select doc_id as request_id, doc_id,
       case doc_id % 4 when 0 then 'all' when 1 then 'custom' when 2 then 'current' else 'custom' end as pages_range,
       case when doc_id % 4 in (1, 2) then custom_pages when doc_id % 4 = 3 then ' ' end as custom_pages,
       cast(doc_id % 40 as double) as m_top, cast(doc_id % 25 as double) as m_right,
       cast(doc_id % 35 as double) + 0.5 as m_bottom, cast(doc_id % 45 as double) as m_left
from {spec_requests}
"""

SQL["stamp_requests"] = """
select request_id, doc_id, mode, custom_pages, start_page, end_page,
       case when doc_id % 3 = 0 then 'image' else 'text' end as watermark_type,
       case when doc_id % 2 = 0 then 'CONFIDENTIAL' else concat('Copy ', cast(doc_id as varchar(20))) end as text,
       case doc_id % 7 when 0 then 'Center' when 1 then 'TopLeft' when 2 then 'TopRight' when 3 then 'BottomLeft'
            when 4 then 'BottomRight' when 5 then 'Tiled' else 'Nowhere' end as position,
       case doc_id % 5 when 0 then 45 when 1 then 0 when 2 then 90 when 3 then -30 else 180 end as stamp_turn,
       cast(8 + abs(doc_id) % 137 as int) as font_size,
       cast(1 + abs(doc_id) % 100 as int) as opacity,
       case when doc_id % 4 = 0 then 'blue' when doc_id % 13 = 1 then '#zz00ff' when doc_id % 13 = 2 then '#34' else '#34a0Db' end
         as text_color,
       cast(10 + doc_id % 300 as int) as image_width,
       cast(10 + (doc_id * 7) % 200 as int) as image_height,
       cast(10 + doc_id % 150 as int) as image_scale
from {mode_requests}
"""

# Files to be written: every document under its path, some with a suffix in other cases or that of a text, some empty.
SQL["pdf_files"] = """
select doc_id, concat(substr(file_path, 2, length(file_path) - 5),
              case doc_id % 6 when 2 then '.PDF' when 3 then '.Pdf' when 4 then '.txt' else '.pdf' end) as name,
       case when doc_id % 11 = 3 then '' else concat('%PDF-1.4 ', text,
            case when doc_id % 4 = 1 then ' trailer<</Encrypt 5 0 R>> %%EOF' else ' trailer<</Root 1 0 R>> %%EOF' end) end as body
from {docs} join (select doc_id as text_id, text from {documents}) t on doc_id = text_id
"""

# Twelve clicks on every document, some on pages that aren't there; a few logs with an unknown action or document.
SQL["clicks"] = """
select case when doc_id % 89 = 4 then -doc_id else doc_id end as doc_id, cast(k as bigint) as seq,
       case (doc_id + k) % 7 when 0 then 'rotate' when 1 then 'duplicate' when 2 then 'delete' when 5 then 'rotate'
            when 6 then case when doc_id % 4 = 0 then 'reset' when doc_id % 97 = 5 then 'fold' else 'duplicate' end else 'move' end as action,
       cast(1 + (doc_id * 3 + k * 5) % (page_count + 3) as bigint) as page_id,
       cast(1 + (doc_id + k * 2) % (page_count + 2) as bigint) as target_id
from (select doc_id, page_count, @CLICK_NUMBERS@ as k from {docs}) t
"""

# Advances of a font that lacks some of the characters of labels.
SQL["glyphs"] = """
select substr('012345689Page of-ivlcdmXLC', k + 1, 1) as glyph, cast(max(280 + 23 * k) as int) as advance
from (select cast(event_id % 26 as int) as k from {events}) t group by substr('012345689Page of-ivlcdmXLC', k + 1, 1)
"""

# The share is taken before the scale, so that no product passes 64 bits.
SQL["compress_sizes"] = """
select doc_id, case when doc_id % 50 = 0 then cast(0 as bigint) else n * scale end as original_size,
       cast(floor(n * (40 + doc_id % 70) / 100) as bigint) * scale as compressed_size
from (select doc_id, n_chars * (1 + doc_id % 3 * 1000) as n,
             cast(case when doc_id % 50 = 1 then 5000000 when doc_id % 50 = 2 then 2000000000 else 1 end as bigint) as scale
      from {documents}) t
"""

SQL["open_events"] = """
select user_id % 5 as owner,
       concat('/d', cast(user_id % 7 as varchar(20)), '/', event_type, '_', cast(event_id % 300 as varchar(20)), '.pdf')
         as file_path, ts
from {events}
"""

SQL["index_control"] = """
select user_id % 5 as owner, ts,
       case event_type when 'signup' then 'enable' when 'error' then 'disable'
            else case when value > 45 and ts < timestamp '2024-01-09 00:00:00' then 'clear' else 'none' end end as action
from {events}
"""

SQL["search_queries"] = """
select distinct user_id % 5 as owner,
       case event_id % 8 when 0 then event_type when 1 then upper(event_type) when 2 then '5' when 3 then '  '
            when 4 then concat(event_type, ' ') when 5 then concat('/D', cast(user_id % 7 as varchar(20)))
            when 6 then concat('_', cast(event_id % 30 as varchar(20))) else '' end as query
from {events}
"""

SQL["open_files"] = """
select file_path, max(n) as file_size
from (select concat('/d', cast(user_id % 7 as varchar(20)), '/', event_type, '_', cast(event_id % 300 as varchar(20)),
             '.pdf') as file_path, event_id % 300 % 4 * 100 as n
      from {events} where event_type <> 'error') t
group by file_path
"""

SQL["file_listing"] = """
select concat('/corpus/', source, case when doc_id % 4 = 0 then chr(92) else '/' end, lang, '.v_',
              cast(doc_id as varchar(20)),
              case doc_id % 5 when 0 then '.PDF' when 1 then '.txt' when 2 then '.Pdf' when 3 then '.pdf.bak'
                   else '.pdf' end) as path,
       n_chars as length,
       concat('%PDF-1.4 ', text, case when doc_id % 3 = 0 then ' trailer<</Encrypt 5 0 R>>' else '' end) as body
from {documents}
"""

SQL["tool_requests"] = """
select doc_id as request_id,
       case doc_id % 14 when 0 then 'split' when 1 then 'remove' when 2 then 'organize' when 3 then 'merge'
            when 4 then 'numbers' when 5 then 'watermark' when 6 then 'image_watermark' when 7 then 'render'
            when 8 then 'compress' when 9 then 'metadata' when 10 then 'images' when 11 then 'lock' when 12 then 'unlock'
            else 'crop' end as tool,
       case when doc_id % 11 = 0 then case when doc_id % 3 = 0 then '' else ' ' end when doc_id % 13 = 0 then '/corpus/gone.pdf' else file_path end as file_path,
       case doc_id % 5 when 0 then 'ByPageRanges' when 1 then 'AtSpecificPages' when 2 then 'EveryNPages'
            when 3 then 'ExtractAllPages' else 'Other' end as method,
       case when doc_id % 3 = 0 then split('1-2;3', ';') end as page_ranges,
       case when doc_id % 2 = 0 then cast(split('1;2', ';') as @INTS@) end as split_points,
       cast(doc_id % 4 as int) as page_interval,
       case when doc_id % 3 = 1 then cast(split('1;7', ';') as @INTS@) end as pages,
       doc_id % 9 = 0 as even, doc_id % 17 = 0 as odd, case when doc_id % 10 = 0 then 2 end as nth,
       case doc_id % 5 when 0 then '1:0' when 1 then '9:90' when 2 then '1:45;1:30' when 3 then '1:-90' end as order_text,
       case when doc_id % 4 > 0 then split(concat(file_path, case when doc_id % 3 = 0 then ';/a.pdf;/b.pdf' else '' end),
            ';') end as files,
       case when doc_id % 19 <> 0 then cast(4 + doc_id % 145 as int) end as font_size,
       cast(doc_id % 103 as int) as opacity,
       case doc_id % 4 when 0 then 'a.PNG' when 1 then 'b.tiff' when 2 then 'c.d.jpeg' else 'plain' end as image_name,
       case doc_id % 5 when 0 then cast(0 as bigint) when 1 then cast(10485760 as bigint)
            when 2 then cast(10485761 as bigint) else doc_id end as image_size,
       cast(doc_id % 700 as int) as dpi,
       case doc_id % 3 when 0 then 'JPG' when 1 then 'gif' else 'png' end as image_format,
       doc_id % 5 > 0 as has_options,
       case doc_id % 4 when 0 then 'Low' else 'Custom' end as quality,
       case when doc_id % 3 > 0 then cast(doc_id % 120 as int) end as custom_quality,
       case doc_id % 5 when 0 then 'Read' when 1 then 'write' when 2 then 'lock' when 3 then 'unlock' else ' ' end
         as operation,
       case doc_id % 4 when 0 then 'ab' when 1 then 'secret' when 2 then ' ' end as password,
       case doc_id % 3 when 0 then 'all' else 'custom' end as pages_range,
       case doc_id % 2 when 0 then '1-2' else ' ' end as custom_pages,
       case doc_id % 4 when 0 then '' when 1 then '12' else '3.5x' end as m_top,
       case doc_id % 3 when 0 then 'x' else '0' end as m_right, '10' as m_bottom,
       case when doc_id % 5 > 0 then '-4' end as m_left
from {docs}
"""


def fixture_text(name: str, engine: str) -> str:
    text = re.sub(r"@(\w+)@", lambda m: WORDS[engine][m.group(1)], SQL[name])
    return text.replace("varchar(20)", "string") if engine == "spark" else text


def needs(text: str) -> list[str]:
    """Names a definition refers to."""
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def with_clause(names: list[str]) -> str:
    """DuckDB common table expressions for the named definitions and all they build on."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done or name not in SQL:
            return
        for other in needs(SQL[name]):
            add(other)
        done.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({re.sub(r'[{](\w+)[}]', r'\1', fixture_text(n, 'duckdb')).strip()})" for n in done]
    return "with " + ",\n".join(parts) + "\n" if parts else ""

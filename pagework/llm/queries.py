"""The queries of the numbered operators, each over its whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.llm import ann, bpe, chat, collocations, hard_negatives, jaccard, langid, lm, mips, mixing, toxicity, url_rules, warc
from pagework.llm.common import read_table, run_folder, ship_package, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"


def query(build: Query) -> Query:
    @functools.wraps(build)
    def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = ready
    return ready


@query
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    ids = bpe.encode(read_table(spark, sf_dir, "documents"), path, ["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "ids",
    )
    return bpe.decode(ids, path, ["doc_id", "n_tokens", "ids_sha256"]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256")
    )


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.words("text").alias("size")), "mix-sizes")
    mixed = mixing.mix(sized, ["doc_id"], "doc_id", size=F.col("size"))
    return (
        mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.get("mix.positions", F.lit(0)).alias("position"))
        .repartitionByRange("position", "doc_id")
        .sortWithinPartitions("position", "doc_id")
    )


# The words before a reading are whole passes, earlier buckets and the bucket's own; SQL takes them in one window. The
# schedules' times are roots of (1.5 t - t^2 / 2), (2 t) and (2 t + t^2), each as a share of its integral.
ORACLES["op9_mix_sources"] = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
         (row_number() over (order by source asc nulls last) - 1) % 3 as schedule
  from sized group by source),
ranked as (
  select *, cast(schedule + 1 as double) as weight, source_size * 3 as most,
         cast(source_size * 3 as double) / (schedule + 1) as ratio from sources),
levels as (
  select *, cast(sum(source_size) over () - coalesce(sum(most) over before, 0) as double)
         / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from ranked
  window before as (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding)),
wanted as (
  select source, source_size, schedule,
         least(cast(most as double), weight * (select arg_min(level, ratio) from levels where ratio >= level)) as target
  from levels),
placed as (
  select doc_id, size, source_size, target, schedule,
         coalesce(sum(size) over (partition by s.source order by md5(cast(doc_id as varchar)), size
                  rows between unbounded preceding and 1 preceding), 0) + size / 2 as middle
  from sized s join wanted w on s.source is not distinct from w.source),
taken as (
  select *, case when size > 0 then cast(middle <= target as int) + cast(middle + source_size <= target as int)
         + cast(middle + 2 * source_size <= target as int) else 0 end as n
  from placed),
shared as (select *, case when n > 0 then cast(middle as double) / target end as u from taken)
select doc_id, size, source_size, target, cast(size * n as bigint) as taken,
       case schedule when 0 then 0.0 + 2.0 * u / (1.5 + sqrt(2.25 - 2.0 * u))
                     when 1 then 0.0 + 2.0 * (u * 2.0) / (2.0 + sqrt(4.0))
                     else 0.0 + 2.0 * (u * 3.0) / (2.0 + sqrt(4.0 + 4.0 * (u * 3.0))) end as position
from shared
"""


# The explicit rules of the query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages"), ["page_id"], URL_RULES)


@query
def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    folder = run_folder(spark, "warc")
    captures = warc.write_archives(pages, folder, "page_id", "url", "html")
    index = warc.build_index(captures, folder)
    found = warc.lookup(index, folder, pages.select(warc.url_key("url").alias("capture")))
    return warc.read_captures(found, folder, payloads=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLES["op1_warc_index"] = """
with base as (select page_id, encode(coalesce(html, '')) as payload from pages),
sized as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from base),
tops as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes)
            else page_id end as top from sized)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when top = page_id then 'response' else 'revisit' end as record_type,
       case when top <> page_id then top end as refers_to
from tops
"""


def remainder(key: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(by))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.filter(remainder("doc_id", 4) != 2), "doc_id")


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_model(docs), ["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs.filter(remainder("doc_id", 5) != 0), labels.filter(remainder("doc_id", 5) != 0))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digests(chat.format_chats(turns))


# A text's length in the template: 19 + role + 19 + text + 10 characters. A control string costs one character more, and
# so does each backslash that stands before one or at the end.
ORACLES["op4_chat_format"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped as (
  select *, regexp_replace(regexp_replace(text,
      '(\\*)(<\|start_header_id\|>|<\|end_header_id\|>|<\|eot_id\|>|<\|begin_of_text\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\])',
      '\1\1\\\2', 'g'), '(\\+)\z', '\1\1') as shown
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(shown) + length(role) + 48) as bigint) as formatted_chars
from escaped group by conv_id
"""


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents"))


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.top_k(read_table(spark, sf_dir, "embeddings"), 5, lambda x: F.floor(256 * x), every=50)


ORACLES["op2_exact_top_k"] = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from usable q join usable c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
"""


@query
def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), 5, every=50)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), lambda x: F.floor(256 * x), every=100, label=label)


ORACLES["op12_hard_negatives"] = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score
  from usable a join usable c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from scored where same)
  where n <= 5),
banded as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from positives p join scored s using (anchor_id)
  where not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score
from banded where rank <= 10
"""


@query
def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    return lm.score(docs, ~F.coalesce("held_out", F.lit(False)), ["doc_id", "held_out"])


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), least=100, top=2000)


ORACLES["op11_collocations"] = r"""
with base as (
  select row_number() over () as row, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select row, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from base),
numbered as (select row_number() over () as piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
words as (select lang, piece_id, unnest(ws) as w, generate_subscripts(ws, 1) as place from numbered),
totals as (select lang, cast(count(*) as bigint) as n from words group by lang),
runs as (
  select lang, w as w1, lead(w, 1) over p as w2, lead(w, 2) over p as w3, lead(w, 3) over p as w4, lead(w, 4) over p as w5
  from words window p as (partition by piece_id order by place)),
phrases as (
  select lang, 1 as words, w1 as phrase from runs
  union all select lang, 2, concat_ws(' ', w1, w2) from runs where w2 is not null
  union all select lang, 3, concat_ws(' ', w1, w2, w3) from runs where w3 is not null
  union all select lang, 4, concat_ws(' ', w1, w2, w3, w4) from runs where w4 is not null
  union all select lang, 5, concat_ws(' ', w1, w2, w3, w4, w5) from runs where w5 is not null),
freq as (select lang, words, phrase, cast(count(*) as bigint) as f from phrases group by lang, words, phrase having count(*) >= 100),
cuts as (
  select lang, phrase, f as a, words, string_split(phrase, ' ') as ws, unnest(range(1, words)) as k from freq where words > 1),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, t.n,
         cast(cast(1000 as hugeint) * c.a * t.n // (cast(x.f as hugeint) * y.f) as bigint) as score
  from cuts c join totals t using (lang)
  join freq x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:c.k], ' ')
  join freq y on y.lang = c.lang and y.phrase = array_to_string(c.ws[c.k + 1:], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
  select * from best b where not exists (
    select 1 from freq o where o.lang = b.lang and o.words > len(string_split(b.phrase, ' ')) and 100 * o.f >= 100 * b.a
      and contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from .test_jaccard import brute as near_copies
from .test_mixing import brute as mix

ROOTS = {"aa": ["kor", "tul", "meb", "zan"], "bb": ["wiss", "shto", "prell", "och"]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    numbers = random.Random(21)
    docs, toxic = [], set()
    for i in range(900):
        lang = numbers.choice(list(ROOTS))
        words = ["".join(numbers.choices(ROOTS[lang], k=numbers.randrange(1, 5))) for _ in range(numbers.randrange(20, 60))]
        if i % 9 == 0:
            toxic.add(i)
            words[3:3] = ["vilest", "scumbag"]
        docs.append((i, " ".join(words), lang if i % 10 else None, f"s{i % 4}", 0))
    clean = [d for d in docs if d[0] not in toxic]
    docs += [(1000 + i, clean[0][1], "aa", "s1", 0) for i in range(20)]
    docs += [(1100 + i, clean[5][1] + f" end{i}", "aa", None, 0) for i in range(20)]
    docs += [(1200, None, "aa", "s1", 0), (1201, "12 -- 34", "bb", "s1", 0), (1202, "", None, None, None), (None, "kor tul meb zan", "aa", "s2", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(900)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, toxic


def test_stages_and_run(spark, tables):
    folder, rows, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {"all": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = kept[name] = spark.createDataFrame(docs.collect(), docs.schema)
    ids = {name: [r["doc_id"] for r in df.collect()] for name, df in kept.items()}
    text = {i: t for i, t, *_ in rows}
    assert set(ids["all"]) - set(ids["language ID"]) == {1200, 1201, 1202}
    assert set(ids["language ID"]) - set(ids["toxicity"]) == toxic
    classes = near_copies([(i, text[i]) for i in ids["toxicity"]])
    assert sorted(map(str, ids["n-gram Jaccard join"])) == sorted(map(str, {c for c, _, _ in classes.values()} | {None}))
    reads = ids["mixing sources to target weights"]
    assert set(reads) <= set(ids["n-gram Jaccard join"]) and max(map(reads.count, set(reads))) <= 3
    final = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in final) == sorted(map(str, reads))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in final:
        assert r["round_trip"] and r["ids"] == library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["ids"]) and r["lang"] in ROOTS


def test_the_mix_of_the_third_stages_documents(spark, tables):
    folder, rows, _ = tables
    some = [(i, t, s) for i, t, _, s, _ in rows if i is not None]
    df = spark.createDataFrame([(i, t, "aa", s, 0) for i, t, s in some], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    reads = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, df, folder).collect()]
    expected = mix(some)
    assert {i: reads.count(i) * expected[i][0] for i in expected} == {i: e[3] for i, e in expected.items()}


def test_rows_that_share_an_id_stay_if_their_texts_differ(spark):
    words = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, words["a"]), (1, words["b"]), (1, words["b"]), (2, words["b"]), (2, words["c"]), (3, words["c"] + " end"), (3, words["d"]), (None, words["a"])]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "a")]


def test_empty_documents(spark, tables):
    folder, _, _ = tables
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_random_letters_go_and_short_clean_texts_stay(spark, tables):
    folder, rows, _ = tables
    numbers = random.Random(4)
    junk = [(5000 + i, "".join(numbers.choices("abcdefghijklmnopqrstuvwxyz ", k=n)), None, "s1", 0) for i, n in enumerate([40, 90, 300, 2000] * 10)]
    short = [(6000 + i, text, None, "s1", 0) for i, text in enumerate(["kor tul", "meb", "wissshto", "och prell och"])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < 900] + junk + short, schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, folder).collect()}
    assert kept == {*range(900), *range(6000, 6004)}


def test_the_pipeline_keeps_clean_documents_of_small_tables(spark):
    """Of the documents confirmed as clean, whatever the table's size, the filtering stages keep nearly all."""
    for sf in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{sf}"
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:2]:
            kept = stage(spark, kept, folder)
        ids = {r["doc_id"] for r in kept.collect()}
        for toxic, least, most in ((0, 0.97, 1.0), (1, 0.0, 0.55)):
            marked = [i in ids for i, t in labels.items() if t == toxic]
            assert least <= sum(marked) / len(marked) <= most, (sf, toxic)
        assert len(corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()) > 0.5 * docs.count()


def test_texts_cross_the_network_once_a_stage_and_once_to_be_ordered(spark):
    """Also where no side of a join is small enough to be broadcast, as in large tables."""
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, f"some words of text {i}", "aa", f"s{i % 2}", 0) for i in range(20)], columns)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plans = [stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString() for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.mix_sources)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    once, mixed = ([line for line in plan.split("\n") if " Exchange " in line] for plan in plans)
    assert len(once) == 2 and all("doc_id" in line or "__kept" in line for line in once)
    assert not [line for line in mixed if "coalesce(source" in line and "bucket" in line]  # the join asks for no other dealing than the window

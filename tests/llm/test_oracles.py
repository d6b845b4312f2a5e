"""The numbered queries against their SQL twins, over whole tables; those without one are tested by brute force elsewhere."""

import duckdb
import pytest

from pagework.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations"
WITHOUT_TWIN = {"op3_bpe_round_trip", "op5_language", "op6_jaccard_join", "op7_toxicity", "op8_learned_partitions", "op10_url_filter", "op13_lm_scores"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def test_queries():
    assert len(QUERIES) == 13 and set(QUERIES) - set(ORACLES) == WITHOUT_TWIN


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows(spark, duck, key):
    ours = QUERIES[key](spark, SF_DIR)
    columns = sorted(ours.columns)
    relation = duck.sql(ORACLES[key])
    assert columns == sorted(relation.columns)
    want = relation.select(", ".join(columns)).fetchall()
    got = [tuple(r) for r in ours.select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def rows_of(spark, key):
    return QUERIES[key](spark, SF_DIR).collect()


def test_round_trip_of_whole_texts(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows_of(spark, "op3_bpe_round_trip"):
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_links_of_the_documents(spark):
    from .test_jaccard import brute

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in rows_of(spark, "op6_jaccard_join")} == brute(docs)


def test_held_out_language_and_toxicity(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in found if docs[r["doc_id"]]["lang"]]
    assert sum(right) / len(right) >= 0.98


@pytest.mark.parametrize("sf,recall", [("sf0.001", 0.4), ("sf0.01", 0.6), ("sf0.1", 0.88)])
def test_toxicity_at_every_size(spark, sf, recall):
    """Clean and toxic rates apart. Of some toxic texts of sf0.001 and sf0.01 no training text shares a mark, so all are counted."""
    folder = f"/root/testdata/{sf}"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scored = QUERIES["op7_toxicity"](spark, folder).collect()
    held = [r["predicted"] for r in scored if r["held_out"] and labels.get(r["doc_id"]) == 0]
    assert 1 - sum(held) / len(held) >= 0.97
    known = [(labels[r["doc_id"]], r["predicted"]) for r in scored if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in known) / len(known) >= 0.97
    caught = [r["predicted"] for r in scored if labels.get(r["doc_id"]) == 1 and (sf != "sf0.1" or r["held_out"])]
    assert sum(caught) / len(caught) >= recall

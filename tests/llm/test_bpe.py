import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagework.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as file:
        return bpe.ByteBpe(file.read())


@pytest.fixture(scope="module")
def decoder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Decoder(file.read())


def ids_of(model, texts):
    return [memoryview(x).cast("i").tolist() for x in model.encode_all(texts)]


SAMPLES = [
    "", " ", "\n\n  \t x", "don't y'all'd  've", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "ab" * 3000, "é" * 500,
    "\x1c\x1d a\x85b\u3000c\u2028", "½ ² 12³ ٣", "日本語のテキスト 한국어", "😀😀 👩‍👩‍👧", "\x00\x01", " " * 5000 + "a", "x" * 100_000,
]


def test_ids_and_texts_equal_the_library(model, decoder, library):
    for text, ids in zip(SAMPLES, ids_of(model, SAMPLES)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected, text[:40]
        assert decoder.decode(ids) == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_any_text(model, decoder, library, text):
    [ids] = ids_of(model, [text])
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert decoder.decode(ids) == text


def test_any_ids_decode_like_the_library(decoder, library):
    numbers = random.Random(5)
    for _ in range(50):
        ids = [numbers.randrange(50_257) for _ in range(40)]
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert decoder.decode([72, None, 10**9, -3]) == decoder.decode([72])


def test_lists_of_ids_without_a_scalar_an_id():
    lists = pa.array([[9], [1, 2, 3], [], [4], [5, 6], [7]], pa.list_(pa.int32()))
    for column in (lists, lists.slice(1, 4), lists.slice(2, 1), lists.slice(0, 0), pa.array([[1, None], []], pa.list_(pa.int32())),
                   pa.array([[1, 2], None, [2**40]], pa.list_(pa.int64()))):
        assert bpe.id_lists(column) == column.to_pylist()


def test_one_tree_and_many_trees_agree(model):
    numbers = random.Random(9)
    pieces = [bytes(numbers.choice(b"abrethin nd") for _ in range(numbers.randrange(1, 60))) for _ in range(500)]
    together = [memoryview(x).cast("i").tolist() for x in model.merge_short(pieces)]
    assert together == [model.merge(p) for p in pieces]


def test_the_store_of_pieces_stays_small(model, monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    texts = [f"word{i} other{i * 7}" for i in range(400)]
    assert ids_of(model, texts) == [library.encode(t).ids for t in texts]
    assert len(model.kept) <= 1600


def test_table_with_nulls_repeats_and_other_columns(spark, long_text, library):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (4, "a b", "z"), (4, "a b", "z"), (None, "c", "q"), (5, long_text, "")]
    df = spark.createDataFrame(rows, "id int, text string, ids string")
    found = bpe.encode(df, PATH, ["id", "ids"], into="tokens")
    assert found.columns == ["id", "ids", "tokens"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(((i, x, library.encode(t or "").ids) for i, t, x in rows), key=str)
    told = bpe.encode(df, PATH, ["id"], into="tokens", round_trip="same").collect()
    assert all(r["same"] for r in told) and len(told) == len(rows)
    back = bpe.decode(found, PATH, ["id"], "tokens")
    assert sorted(map(str, back.collect())) == sorted(map(str, spark.createDataFrame([(i, t or "") for i, t, _ in rows], back.schema).collect()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert bpe.decode(bpe.encode(df, PATH, ["id"]), PATH, ["id"]).collect() == []

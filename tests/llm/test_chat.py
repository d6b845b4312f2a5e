import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagework.llm import chat
from pagework.llm.common import slices_by_bytes

BITS = [*chat.CONTROLS, "\\", "\\\\", "a", "é😀", "\n", "<", "|>", "[", "", " "]
said = st.lists(st.sampled_from(BITS), max_size=12).map("".join)


@given(st.lists(st.tuples(said, said), max_size=6))
def test_any_turns_read_back(turns):
    role, text = (chat.escaped(pa.array(list(c), pa.string())) for c in (zip(*turns) if turns else ((), ())))
    assert [chat.unescaped(t) for t in text.to_pylist()] == [t for _, t in turns]
    buffer, _ = chat.assemble([chat.HEAD, role, chat.MIDDLE, text, chat.END])
    assert chat.read_turns(buffer.tobytes().decode()) == turns


def expected(turns):
    roles = [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))]
    loss = "".join(t for r, t in roles if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in roles)
    return len(roles), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("block", [1024, 3])
def test_conversations(spark, long_text, block):
    numbers = random.Random(2)
    talk = {c: [(t, numbers.choice(["user", "assistant", "sys\ntem", "<s>"]), "".join(numbers.choices(BITS, k=5))) for t in range(c * 4)] for c in range(1, 5)}
    talk[9] = [(0, "assistant", long_text), (0, "assistant", long_text), (1, None, None), (None, "user", "first")]
    talk[None] = [(0, "assistant", "x"), (1, "user", "")]
    rows = [(c, t, r, x, "clash") for c, turns in talk.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part string")
    formatted = chat.format_chats(df, block=block)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
    assert got == {c: expected(turns) for c, turns in talk.items()}
    lengths = {r["conv_id"]: r["formatted_chars"] for r in chat.digests(formatted).collect()}
    assert lengths == dict(formatted.selectExpr("conv_id", "length(text) as n").groupBy("conv_id").sum("n").collect())
    assert formatted.filter("conv_id = 4").count() == (1 if block > 16 else 6)


def test_loss_covers_assistant_texts_only(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "one </s>"), (1, 2, "assistant", "\\"), (1, 3, "assistant", "")]
    [part] = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [part["text"][s["start"] : s["end"]] for s in part["loss"]] == ["one \\</s>", "\\\\", ""]
    assert part["turns"] == 4


def test_more_turns_than_a_batch_holds(spark):
    turns = spark.range(5000).selectExpr("id % 2 as conv_id", "id as turn", "'assistant' as role", "cast(id as string) as text")
    found = {r["conv_id"]: r for r in chat.digests(chat.format_chats(turns)).collect()}
    whole = "".join(str(i) for i in range(0, 5000, 2))
    assert found[0]["loss_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and found[0]["n_turns"] == 2500


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.format_chats(df)).collect() == []


def test_repeated_turns_are_written_in_bounded_pieces(spark):
    turns = spark.range(30_000).selectExpr("cast(null as bigint) as conv_id", "id % 3 as turn", "'assistant' as role", "lpad(cast(id as string), 6, '0') as text")
    formatted = chat.format_chats(turns.coalesce(2)).cache()
    sizes = [r["turns"] for r in formatted.select("turns").collect()]
    assert sum(sizes) == 30_000 and max(sizes) <= 2 * chat.TURN_BLOCK and len(sizes) > 10
    assert formatted.select("part", "piece").distinct().count() == len(sizes)
    [found] = chat.digests(formatted).collect()
    whole = "".join(f"{i:06d}" for turn in range(3) for i in range(turn, 30_000, 3))
    assert found["loss_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and found["n_turns"] == 30_000


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 500, "", "c" * 60, "d" * 60], pa.string())})
    assert [s.num_rows for s in slices_by_bytes([batch], 4, 100)] == [2, 1, 2, 1]
    assert [s.num_rows for s in slices_by_bytes([batch, batch], 2, 10_000)] == [2] * 6

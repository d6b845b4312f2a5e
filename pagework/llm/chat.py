"""Chat formatting by columnar byte assembly.

A turn is a header with the role, the text and an end mark. Roles and texts are escaped, so that control strings inside them
read back as text: backslashes before a control string, or at the end, are doubled, and the control string gets one more. A
control string after an even number of backslashes is thus a real one.

A batch of turns is laid out at once: the byte lengths of all segments give cumulative offsets, the offsets give scatter
indices, and headers and contents are copied into one preallocated buffer that becomes the Arrow column. Turns are dealt by
(conversation, block of turns), so a conversation of any length is many parts of bounded size; an ordinary one is one part.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import SLICE, slices_by_bytes

# The template's own marks.
HEAD, MIDDLE, END = "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"
# Control strings of common chat templates; texts that hold them are escaped. None has "<" or "[" inside.
CONTROLS = [
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|begin_of_text|>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
]
ANY_CONTROL = "(" + "|".join(map(re.escape, CONTROLS)) + ")"
MARK = re.compile(r"(\\*)" + ANY_CONTROL)
LAST = re.compile(r"\\+\Z")
TURN_BLOCK = 1024
PIECE_BYTES = 16 << 20  # of text in one buffer
LEARNED = "assistant"  # the role whose texts count for the loss

PART = "part bigint, piece bigint, text string, turns bigint, loss array<struct<start:bigint,end:bigint>>"


def escaped(texts: pa.Array) -> pa.Array:
    """Texts with their control strings escaped."""
    marked = pc.replace_substring_regex(texts, r"(\\*)" + ANY_CONTROL, r"\1\1\\\2")
    return pc.replace_substring_regex(marked, r"(\\+)\z", r"\1\1")


def unescaped(text: str) -> str:
    """The text that was escaped: the part before a real control string, or all up to the end."""
    plain = MARK.sub(lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2], text)
    end = LAST.search(plain)
    return plain[: end.start() + (end.end() - end.start()) // 2] if end else plain


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and its offsets from 0."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(segments: list[pa.Array | str]) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the segments one after another: one buffer, and the offset of each row. A string is the same in each row."""
    rows = next(len(s) for s in segments if not isinstance(s, str))
    columns = [s.encode() if isinstance(s, str) else bytes_of(s) for s in segments]
    lengths = np.stack([np.full(rows, len(c)) if isinstance(c, bytes) else np.diff(c[1]) for c in columns])
    ends = np.concatenate([[0], np.cumsum(lengths.sum(axis=0))])
    out = np.empty(ends[-1], dtype=np.uint8)
    starts = ends[:-1] + np.cumsum(lengths, axis=0) - lengths  # of each segment of each row
    for column, start, length in zip(columns, starts, lengths):
        if isinstance(column, bytes):
            out[start[:, None] + np.arange(len(column))] = np.frombuffer(column, dtype=np.uint8)
        else:
            data, offsets = column
            out[np.repeat(start - offsets[:-1], length) + np.arange(len(data))] = data
    return out, ends


def format_rows(table: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Texts, numbers of turns and loss spans of the runs of equal (conversation, block) in a table in order."""
    role, text = (escaped(pc.fill_null(table[c].combine_chunks(), "")) for c in ("role", "text"))
    buffer, ends = assemble([HEAD, role, MIDDLE, text, END])
    first = np.array(runs(table))
    rows = table.num_rows
    text_starts = len(HEAD) + pc.utf8_length(role).to_numpy() + len(MIDDLE)
    text_chars = pc.utf8_length(text).to_numpy().astype(np.int64)
    chars = np.concatenate([[0], np.cumsum(text_starts + text_chars + len(END))])
    run = np.searchsorted(first, np.arange(rows), side="right") - 1
    start = chars[:-1] - chars[first][run] + text_starts
    learned = np.array([r == LEARNED for r in table["role"].to_pylist()], dtype=bool)
    spans = pa.StructArray.from_arrays(
        [pa.array(start[learned], pa.int64()), pa.array((start + text_chars)[learned], pa.int64())], names=["start", "end"]
    )
    span_ends = np.concatenate([[0], np.cumsum(learned)])[np.append(first, rows)]
    offsets = pa.py_buffer(ends[np.append(first, rows)].astype(np.int32).tobytes())
    texts = pa.StringArray.from_buffers(len(first), offsets, pa.py_buffer(buffer))
    loss = pa.ListArray.from_arrays(pa.array(span_ends, pa.int32()), spans)
    return texts, pa.array(np.diff(np.append(first, rows)), pa.int64()), loss


def runs(table: pa.Table) -> list[int]:
    """The first row of each run of equal (conversation, part)."""
    keys = list(zip(table["conv"].to_pylist(), table["part"].to_pylist()))
    return [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = TURN_BLOCK
) -> DataFrame:
    """Parts of formatted conversations: the conversation's id, part, piece, text, turns, and loss spans (code points of the text
    that hold an assistant's text). A conversation's texts in order of part and piece are the whole; one of fewer than ``block``
    turns, counted from 0, is one part. Parts go by turn number. Where turn numbers repeat or are null, a part may have any number
    of rows: it is then written in pieces of bounded rows and bytes, so that memory and time follow the rows.

    Rows go by turn, then role and text; equal rows stay repeated; a null turn stands first. Null roles and texts are empty.
    Rows with a null conversation are one conversation. An empty table gives an empty one; other columns are not read."""
    rows = df.select(
        F.col(conv).alias("conv"),
        F.coalesce(F.floor(F.col(turn) / block), F.lit(0)).cast("bigint").alias("part"),
        F.col(turn).cast("bigint").alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )

    def run(batches):
        held, key, piece = None, None, 0  # rows of the last run, its key, and how many pieces of it went out
        for few in slices_by_bytes(batches, SLICE * 4, PIECE_BYTES):
            table = pa.Table.from_batches([few])
            if held is not None:
                table = pa.concat_tables([held, table])
            firsts = runs(table)
            if key_of(table, 0) != key:
                piece = 0
            cut = firsts[-1]  # the last run may go on in what follows
            if cut:
                yield from parts(table.slice(0, cut), piece)
                piece = 0
            held, key = table.slice(cut), key_of(table, cut)
            if held.num_rows >= block or held.nbytes >= PIECE_BYTES:
                yield from parts(held, piece)
                held, piece = None, piece + 1
        if held is not None and held.num_rows:
            yield from parts(held, piece)

    def key_of(table, row):
        return table["conv"][row].as_py(), table["part"][row].as_py()

    def parts(table, piece):
        table = table.combine_chunks()
        texts, turns, loss = format_rows(table)
        first = pa.array(runs(table))
        pieces = pa.array([piece] + [0] * (len(first) - 1), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [table["conv"].take(first).combine_chunks(), table["part"].take(first).combine_chunks(), pieces, texts, turns, loss],
            names=[conv, "part", "piece", "text", "turns", "loss"],
        )

    kind = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "turn", "role", "text")
    return ordered.select("conv", "part", "role", "text").mapInArrow(run, f"{conv} {kind}, {PART}")


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns, role, at = [], "", 0
    for mark in MARK.finditer(text):
        if len(mark[1]) % 2:
            continue
        before = unescaped(text[at : mark.start(2)])
        if mark[2] == HEAD:
            pass
        elif mark[2] == MIDDLE.rstrip("\n"):
            role = before
        elif mark[2] == END:
            turns.append((role, before))
        else:
            raise ValueError(f"{mark[2]} stands unescaped")
        at = mark.end(2) + (2 if mark[2] == MIDDLE.rstrip("\n") else 0)
    return turns


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Of each conversation, read back from its parts: turns, digest of roles and texts, code points and digest of what the
    loss covers, code points of the formatted text. A digest goes through a conversation in order, so its parts stream by in
    one task, one part at a time."""
    kind = formatted.schema[conv].dataType.simpleString()
    schema = f"{conv} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for key, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != now:
                    if state is not None:
                        done.append(ended(now, state))
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescaped(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield batch_of(done, batch.schema.field(0).type)
        if state is not None:
            yield batch_of([ended(now, state)], batch.schema.field(0).type)

    def ended(key, state):
        return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def batch_of(rows, key_type):
        types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*rows) if rows else [[]] * len(types)
        names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    ordered = formatted.select(conv, "part", "piece", "text", "loss").repartition(conv).sortWithinPartitions(conv, "part", "piece")
    return ordered.select(conv, "text", "loss").mapInArrow(run, schema)

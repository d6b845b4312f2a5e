"""Byte-level BPE encoding and decoding.

A piece of text (a "word" of the pretokenizer) starts as one symbol for each of its bytes. A segment tree over the adjacent
pairs holds, at each leaf, the rank of the pair that starts there; an inner node holds the smaller of its two children. The
root therefore names the lowest rank, and among equal ranks the leftmost place. A merge changes three leaves, each in
logarithmic time. The piece is done when the root holds no rank, so a run of n letters without a break costs n log n.

Rows are independent: no shuffle. The model is one file of fixed size, sent to the executors once.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import give_back, slices, slices_by_bytes

# Fixed value: the pretokenizer's pattern of byte-level BPE vocabularies, with white space by its Unicode property.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The same pieces for texts that hold only letters, digits and blanks on which ``re`` and the pattern above agree.
PLAIN = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\u024f]")
# Pieces kept with their ids by a worker: only short ones, and the store is emptied when full.
KEPT_PIECES, KEPT_LENGTH = 1 << 18, 48
SLICE_ROWS, SLICE_BYTES = 1024, 2 << 20  # texts that are cut into pieces together: new pieces are merged side by side
# Bytes of the longest piece that is merged side by side with others, and how many go together.
SHORT, TOGETHER = 64, 1 << 14
NO_PAIR = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class PairTree:
    """Segment tree of minima over the pairs (i, next symbol), one leaf for each symbol."""

    def __init__(self, keys: list[int]):
        self.leaves = 1 << max(1, (len(keys) - 1).bit_length())
        self.nodes = [NO_PAIR] * self.leaves + keys + [NO_PAIR] * (self.leaves - len(keys))
        nodes = self.nodes
        for i in range(self.leaves - 1, 0, -1):
            nodes[i] = min(nodes[2 * i], nodes[2 * i + 1])

    def root(self) -> int:
        return self.nodes[1]

    def put(self, leaf: int, key: int) -> None:
        nodes, i = self.nodes, self.leaves + leaf
        nodes[i] = key
        while i > 1:
            low = min(nodes[i], nodes[i ^ 1])
            i >>= 1
            if nodes[i] == low:
                return
            nodes[i] = low


class Decoder:
    """Ids of a vocabulary file of the ``tokenizers`` library (byte-level BPE) to text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids: dict[str, int] = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token in spec["added_tokens"]:
            self.bytes_of[token["id"]] = token["content"].encode()

    def decode(self, ids: list[int | None]) -> str:
        """Text of ids; ids outside the vocabulary say nothing, bytes that are no UTF-8 become replacement characters."""
        known, size = self.bytes_of, len(self.bytes_of)
        try:
            joined = b"".join(map(known.__getitem__, ids)) if not ids or min(ids) >= 0 else None
        except (IndexError, TypeError):
            joined = None
        if joined is None:
            joined = b"".join(known[i] for i in ids if i is not None and 0 <= i < size)
        return joined.decode("utf-8", "replace")


class ByteBpe:
    """Text to ids of a vocabulary file of the ``tokenizers`` library (byte-level BPE)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.byte_ids = [ids[c] for c in letters]
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pairs[ids[left], ids[right]] = rank
            self.merged.append(ids[left + right])
        self.merged_ids = np.array([*self.merged, -1], dtype=np.int64)
        self.size = 1 + max(ids.values())
        codes = np.array([a * self.size + b for a, b in self.pairs], dtype=np.int64)
        self.order = np.argsort(codes)
        self.codes = np.append(codes[self.order], NO_PAIR)
        self.ranks = np.append(self.order, -1)  # the pairs were added in rank order
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        found = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(found) + ")").split if found else lambda text: [text]
        self.kept = _Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        symbols: list[int] = [self.byte_ids[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return symbols
        pairs, merged = self.pairs, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(i: int) -> int:
            """Rank first, then place, as one number."""
            j = after[i]
            rank = pairs.get((symbols[i], symbols[j])) if j < n else None
            return NO_PAIR if rank is None else rank * n + i

        tree = PairTree([key(i) for i in range(n)])
        gone = bytearray(n)
        while (low := tree.root()) != NO_PAIR:
            rank, i = divmod(low, n)
            j = after[i]
            symbols[i], after[i], gone[j] = merged[rank], after[j], 1
            if after[j] < n:
                before[after[j]] = i
            tree.put(j, NO_PAIR)
            tree.put(i, key(i))
            if before[i] >= 0:
                tree.put(before[i], key(before[i]))
        return [s for s, g in zip(symbols, gone) if not g]

    def rank_keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, leaves: int) -> np.ndarray:
        """Rank first, then place, as one number, of many pairs; a symbol below 0 pairs with nothing."""
        code = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        found = np.searchsorted(self.codes, code)
        return np.where(self.codes[found] == code, self.ranks[found] * leaves + at, NO_PAIR)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of at most ``SHORT`` bytes, as 32-bit integers: one tree a row, one merge a row at each step."""
        rows, leaves = len(pieces), 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
        place = np.arange(leaves)
        here = place < lengths[:, None]
        symbols = np.full((rows, leaves + 1), -1, dtype=np.int64)  # the last column stands for "no symbol"
        symbols[:, :-1][here] = np.array(self.byte_ids)[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.where(place + 1 < lengths[:, None], place + 1, leaves)
        before = np.tile(np.append(np.where(place > 0, place - 1, leaves), leaves), (rows, 1))
        nodes = np.full((rows, 2 * leaves), NO_PAIR, dtype=np.int64)
        nodes[:, leaves:] = self.rank_keys(symbols[:, :-1], symbols[:, 1:], place, leaves)
        for i in range(leaves - 1, 0, -1):
            nodes[:, i] = np.minimum(nodes[:, 2 * i], nodes[:, 2 * i + 1])
        while len(w := np.flatnonzero(nodes[:, 1] != NO_PAIR)):
            rank, i = np.divmod(nodes[w, 1], leaves)
            j = after[w, i]
            k, p = after[w, j], before[w, i]
            symbols[w, i], symbols[w, j] = self.merged_ids[rank], -1
            after[w, i], before[w, k] = k, i
            nodes[w, leaves + j] = NO_PAIR
            nodes[w, leaves + i] = self.rank_keys(symbols[w, i], symbols[w, k], i, leaves)
            held = p < leaves
            v, q = w[held], p[held]
            nodes[v, leaves + q] = self.rank_keys(symbols[v, q], symbols[v, i[held]], q, leaves)
            for row, leaf in ((w, j), (w, i), (v, q)):
                node = (leaf + leaves) >> 1
                while node[:1].any():
                    nodes[row, node] = np.minimum(nodes[row, 2 * node], nodes[row, 2 * node + 1])
                    node = node >> 1
        left = symbols[:, :-1]
        ids = left[left >= 0].astype(np.int32).tobytes()
        ends = np.cumsum((left >= 0).sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, pieces: set[str]) -> None:
        """Keep the ids of new short pieces."""
        new = [(x, p) for p in pieces.difference(self.kept, self.added) if len(p) <= KEPT_LENGTH and len(x := p.encode()) <= SHORT]
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept.clear()
        new.sort(key=lambda x: len(x[0]))
        for start in range(0, len(new), TOGETHER):
            some = new[start : start + TOGETHER]
            self.kept.update(zip((p for _, p in some), self.merge_short([x for x, _ in some])))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each as 32-bit integers."""
        cut = [self.pieces(text) for text in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.kept.__getitem__, pieces)) for pieces in cut]

    def pieces(self, text: str) -> list[str]:
        found = []
        for part in self.split(text):
            if part in self.added:
                found.append(part)
            elif part:
                found.extend((PATTERN if NOT_PLAIN.search(part) else PLAIN).findall(part))
        return found


class _Pieces(dict):
    def __init__(self, model: ByteBpe):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        added = self.model.added.get(piece)
        ids = np.array(self.model.merge(piece.encode()) if added is None else [added], dtype=np.int32).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_LOADED: dict[tuple[type, str], ByteBpe | Decoder] = {}


def _model(kind: type, text: str) -> ByteBpe | Decoder:
    """The part of a vocabulary that is asked for, built once in each worker."""
    key = kind, hashlib.sha1(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = kind(text)
    return _LOADED[key]


def id_lists(lists: pa.ListArray) -> list[list[int | None]]:
    """Each list as a Python list; without null ids by way of one array, not an Arrow scalar an id."""
    values = lists.flatten()
    if values.null_count or lists.null_count:
        return lists.to_pylist()
    numbers, ends = values.to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
    return [numbers[a:b].tolist() for a, b in zip(ends, ends[1:])]


def _vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())  # one file, as large for any input


def encode(
    df: DataFrame, path: str, keep: list[str], text: str = "text", into: str = "ids", round_trip: str | None = None
) -> DataFrame:
    """The columns ``keep`` and the ids of each whole text, without special tokens added; such a token's own string in a
    text is that token. ``round_trip`` names a further column: whether the ids decode to the text, told by the same worker. A
    null or empty text has no ids. Repeated rows stay repeated, an empty table gives an empty one, and
    other columns are not read."""
    source = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    shared = _vocabulary(df, path)

    def run(batches):
        model = _model(ByteBpe, shared.value)
        for batch in slices_by_bytes(batches, SLICE_ROWS, SLICE_BYTES):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = model.encode_all(texts)
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            more = []
            if round_trip:
                back = _model(Decoder, shared.value)
                same = (back.decode(np.frombuffer(x, np.int32).tolist()) == t for x, t in zip(found, texts))
                more = [pa.array(list(same), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, *more], names=[*keep, into, *told])
        model.kept.clear()  # the worker lives on
        give_back()

    told = [round_trip] if round_trip else []
    made = [F.lit(None).cast("array<int>").alias(into), *(F.lit(True).alias(name) for name in told)]
    return source.mapInArrow(run, source.select(*[F.col(c) for c in keep], *made).schema)


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids", into: str = "text") -> DataFrame:
    """The columns ``keep`` and the text of each list of ids; a null list is an empty text."""
    source = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
    shared = _vocabulary(df, path)

    def run(batches):
        model = _model(Decoder, shared.value)
        for batch in slices(batches):
            texts = [model.decode(x) for x in id_lists(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, into])

    return source.mapInArrow(run, source.select(*[F.col(c) for c in keep], F.lit("").alias(into)).schema)

"""Language identification by a string kernel.

A text is the set of its letter n-grams for n from 1 to 3 (blended spectrum, presence only, white space and signs as one
break). The kernel of two texts is the number of n-grams they share over the root of the product of their numbers. A bounded
number of training texts are landmarks; the Nyström map takes a text to its kernels with the landmarks times the inverse root
of the landmarks' own kernel matrix, and kernel ridge regression learns one output for each language against the rest.

An n-gram is a number made of its letters, whatever their script, so none shares another's place. Scoring needs no shuffle: the
distinct n-grams of a batch are sorted numbers, those that landmarks have make a presence matrix, and two matrix products give
all outputs.
The training rows are a sample of bounded size; their kernels, not their texts, go to the driver.

A text's known share is that of its n-grams which any landmark has. Text in a language that was learned has most of them; random
letters have few. ``Model.least_known`` is the border drawn from the sample's own shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagework.llm.common import bounded_sample, slices, spread_key, written

UNKNOWN = "und"
BITS = 18  # of a symbol: 0 is a break, letters count from 1 in the order of their code points
ROWS = 64  # texts of one presence matrix
PIECE, PART = 1 << 19, 1 << 14  # symbols that are sorted, and n-grams of one presence matrix

SAMPLE, LANDMARKS, LANDMARK_CHARS, RIDGE, SHARPNESS = 4000, 96, 200, 1e-3, 6.0
# A text is strange whose known share is below this part of that of the sample's least known texts, one in so many.
KNOWN_PART, KNOWN_TAIL = 0.75, 200

_SYMBOLS: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """For each code point its symbol: each letter has its own."""
    if not _SYMBOLS:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        _SYMBOLS.append(np.where(letter, np.cumsum(letter), 0).astype(np.int32))
    return _SYMBOLS[0]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    codes.sort()
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of at most ``ROWS`` texts, as (text, n-gram) in order, and whether each text has letters."""
    low = [f" {t.lower()} " for t in texts]
    row = np.repeat(np.arange(len(low), dtype=np.int8), list(map(len, low)))
    symbol = symbols()[code_points(low)]
    held = np.append(True, (symbol[1:] > 0) | (symbol[:-1] > 0) | (row[1:] != row[:-1]))  # a run of breaks counts once
    symbol, row = symbol[held], row[held]
    lettered = np.bincount(row, weights=symbol > 0, minlength=len(low)) > 0
    pieces = []
    for start in range(0, len(symbol), PIECE):  # pieces share two symbols, so that no n-gram is missed
        part = symbol[start : start + PIECE + 2].astype(np.int64) + 1  # no digit is 0, so lengths differ
        text = row[start : start + PIECE + 2].astype(np.int64)
        place = text << 3 * BITS
        pair = (part[:-1] << BITS) | part[1:]
        triple = (pair[:-1] << BITS) | part[2:]
        two, three = text[:-1] == text[1:], text[:-2] == text[2:]
        pieces.append(distinct(np.concatenate([place | part, (place[:-1] | pair)[two], (place[:-2] | triple)[three]])))
    codes = pieces[0] if len(pieces) == 1 else distinct(np.concatenate(pieces))
    return codes >> 3 * BITS, codes & ((1 << 3 * BITS) - 1), lettered


@dataclass
class Landmarks:
    grams: np.ndarray  # the n-grams that any landmark has, sorted
    held: np.ndarray  # (n-gram, landmark) as bits
    sizes: np.ndarray  # number of n-grams of each landmark

    @property
    def table(self) -> np.ndarray:
        return symbols()

    def kernels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, landmark) kernels of whole texts, and whether each text has letters."""
        return self.compare(texts)[:2]

    def compare(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and the share of each text's n-grams that landmarks have."""
        found, lettered, shares = [], [], []
        for start in range(0, len(texts), ROWS):
            row, gram, some = ngrams(texts[start : start + ROWS])
            lettered.append(some)
            size = np.bincount(row, minlength=len(some))
            place = np.searchsorted(self.grams, gram)
            place[place == len(self.grams)] = 0
            known = self.grams[place] == gram
            row, place = row[known], place[known]
            shares.append(np.bincount(row, minlength=len(some)) / size)
            used = np.zeros(len(self.grams), dtype=bool)
            used[place] = True
            used = np.flatnonzero(used)
            column = np.empty(len(self.grams), dtype=np.int32)
            column[used] = np.arange(len(used))
            column = column[place]
            common = np.zeros((len(some), len(self.sizes)), dtype=np.float32)
            for first in range(0, len(used), PART):
                few = used[first : first + PART]
                inside = slice(None) if len(used) <= PART else (column >= first) & (column < first + PART)
                seen = np.zeros((len(some), len(few)), dtype=np.float32)
                seen[row[inside], column[inside] - first] = 1
                common += seen @ np.unpackbits(self.held[few], axis=1, count=len(self.sizes)).astype(np.float32)
            found.append(common / np.sqrt(size[:, None] * self.sizes[None, :].astype(np.float64)).astype(np.float32))
        return np.concatenate(found), np.concatenate(lettered), np.concatenate(shares)


def landmarks(texts: list[str]) -> Landmarks:
    rows = [ngrams([text])[1] for text in texts]
    grams = distinct(np.concatenate(rows))
    held = np.zeros((len(grams), -(-len(texts) // 8)), dtype=np.uint8)
    for i, row in enumerate(rows):
        held[np.searchsorted(grams, row), i // 8] |= np.uint8(128 >> i % 8)
    return Landmarks(grams, held, np.array(list(map(len, rows))))


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray  # (landmark, language)
    languages: list[str]
    least_known: float = 0.0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and known shares. Without a language to tell, all texts are unknown."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        kernels, lettered, shares = self.landmarks.compare(texts)
        outputs = SHARPNESS * (kernels.astype(np.float64) @ self.weights)
        odds = np.exp(outputs - outputs.max(axis=1, keepdims=True))
        best = outputs.argmax(axis=1)
        score = np.where(lettered, odds[np.arange(len(best)), best] / odds.sum(axis=1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score, np.where(lettered, shares, 0.0)


def pick(rows: list[tuple[str, str]], count: int) -> list[str]:
    """Landmark texts from (language, text): languages in turn, in the given order within each; of one language at least one
    where there are fewer languages than landmarks."""
    by = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    turns = [(i, lang, t) for lang in sorted(by) for i, t in enumerate(by[lang])]
    return [t for _, _, t in sorted(turns, key=lambda x: x[:2])[:count]]


def fit(labelled: DataFrame, key: str, text: str = "text", lang: str = "lang", sample: int = SAMPLE, count: int = LANDMARKS) -> Model:
    """Learns from at most ``sample`` rows with a text that has letters and a language.

    ``count`` of them, the languages in turn, are landmarks; texts of ``LANDMARK_CHARS`` and more come first. ``key`` only
    orders the rows. Without any labelled row there is nothing to learn, and the model finds every text unknown."""
    usable = labelled.select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), spread_key(key).alias("order")
    ).filter(r"lang is not null and text rlike '\\p{L}'")
    rows = written(bounded_sample(usable, "order", sample), "langid-sample")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.length("text") < LANDMARK_CHARS, "order", "text"))
    first = rows.withColumn("turn", turn).filter(F.col("turn") <= count)
    chosen = first.orderBy("turn", "lang").limit(count).select("lang", "text").collect()
    if not chosen:
        return Model(Landmarks(np.zeros(0, np.int64), np.zeros((0, 0), np.uint8), np.zeros(0)), np.zeros((0, 0)), [])
    marks = landmarks(pick([(r["lang"], r["text"]) for r in chosen], count))
    shared = rows.sparkSession.sparkContext.broadcast(marks)  # as large as the landmarks allow, for any input

    def kernels(batches):
        for batch in slices(batches):
            found, _, share = shared.value.compare(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(list(found), pa.list_(pa.float32())), pa.array(share)], names=["lang", "kernels", "share"]
            )

    found = rows.select("text", "lang").mapInArrow(kernels, "lang string, kernels array<float>, share double").toPandas()
    languages = sorted(set(found["lang"]))
    k = np.stack(found["kernels"]).astype(np.float64)
    target = np.where(found["lang"].to_numpy()[:, None] == np.array(languages), 1.0, -1.0)
    own, _ = marks.kernels(pick([(r["lang"], r["text"]) for r in chosen], count))
    values, vectors = np.linalg.eigh((own + own.T).astype(np.float64) / 2)
    root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
    mapped = k @ root
    learned = np.linalg.solve(mapped.T @ mapped + RIDGE * len(k) * np.eye(len(root)), mapped.T @ target)
    # A landmark knows itself whole, so the share is that of the others, where there are any.
    others = np.sort(found["share"].to_numpy()[k.max(axis=1) < 1 - 1e-4])
    least = KNOWN_PART * float(others[len(others) // KNOWN_TAIL]) if len(others) else 0.0
    return Model(marks, root @ learned, languages, least)


def predict(df: DataFrame, model: Model, keep: list[str], text: str = "text", into: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep``, the language of each whole text and a score from 0 to 1; with a third name ``into``, also the share of its
    n-grams that landmarks have. A null text, or one without letters, is ``und`` with score 0, and so is every text for a model
    that found nothing to learn from. Equal texts get equal answers; other columns are not read."""
    source = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            lang, *numbers = shared.value.judge(batch.column(batch.num_columns - 1).to_pylist())
            made = [pa.array(lang, pa.string()), *(pa.array(n, pa.float64()) for n in numbers)][: len(into)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*keep, *into])

    return source.mapInArrow(run, source.select(*keep, F.lit("").alias(into[0]), *[F.lit(0.0).alias(c) for c in into[1:]]).schema)

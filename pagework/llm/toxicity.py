"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts count as labelled; all other training texts are unlabelled and hold toxic ones at the rate of a
class prior. The risk of a linear classifier is that of the positives as positive, weighted by the prior, plus that of the
unlabelled as negative less what the positives among them add; the second part is an average loss and never below zero, so
where its estimate falls below zero, the gradient goes the other way until it is not. Where to stop is chosen by the same
correction on training rows held out from the steps. A text without any feature never scores above the prior.

A text is its words' five-letter pieces and its whole words; each is a feature where it stands once, and another where it
stands twice or more. A feature marks toxic text if, by the prior, at least half of the texts with it are toxic, and positives
hold it so much more often than other texts that of all features chosen at most a twentieth is expected to be chance
(false discovery rate, so small and large samples are treated alike). At most ``FEATURES`` are kept. Both samples have bounds;
scoring covers every whole text without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import bounded_sample, slices, spread_key, written

WORD = re.compile(r"\w+")
PIECE = 5
POSITIVES, UNLABELLED, FEATURES = 4000, 12000, 512
LEAST_ODDS, BY_CHANCE = 0.5, 0.05
STEPS, RATE, DECAY, BACK = 600, 0.02, 1e-4, 1.0
HELD_OUT, EVERY = 4, 10  # one training row in so many chooses where to stop, at multiples of this
KEPT_WORDS, KEPT_LENGTH = 1 << 17, 48
TWICE = "+"


def parts(word: str) -> set[str]:
    """A word, as ``=word``, and its five-letter pieces; both ends of the word count as letters."""
    marked = f"^{word}$"
    return {f"={word}", *(marked[i : i + PIECE] for i in range(len(marked) - PIECE + 1))}


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def features_of(text: str) -> list[str]:
    """Every part of the text's words, and with ``TWICE`` behind it again if it stands in two words or more."""
    counts: Counter = Counter()
    for word, n in words_of(text).items():
        for part in parts(word):
            counts[part] += n
    return [*counts, *(part + TWICE for part, n in counts.items() if n > 1)]


class WordFeatures(dict):
    """The parts of a word that features are made of, as numbers; short words are kept, and the store is emptied when full."""

    def __init__(self, features: list[str]):
        numbers = {f: i for i, f in enumerate(features)}
        bases = sorted({f.removesuffix(TWICE) for f in features})
        self.number = {b: i for i, b in enumerate(bases)}
        self.once, self.twice = [numbers.get(b) for b in bases], [numbers.get(b + TWICE) for b in bases]

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.number[p] for p in parts(word) if p in self.number)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> list[int]:
        counts: dict[int, int] = {}
        for word, n in words_of(text).items():
            for base in self[word]:
                counts[base] = counts.get(base, 0) + n
        found = [self.once[base] for base in counts] + [self.twice[base] for base, n in counts.items() if n > 1]
        return sorted(f for f in found if f is not None)


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str], words: WordFeatures) -> np.ndarray:
        outputs = np.array([self.bias + self.weights[words.of(t)].sum() for t in texts])
        return 1 / (1 + np.exp(-outputs))


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])


def risk_parts(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """The logistic risk of the positives as positive, and of the negatives as negative, the latter as the unlabelled less
    the positives among them. ``w`` ends with the bias, which meets the last column of ones."""
    fp, fu = xp @ w, xu @ w
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def corrected_risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> float:
    positive, negative = risk_parts(w, xp, xu, prior)
    return float(positive + max(0.0, negative))


def gradients(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The negatives' risk, and the gradients of both parts of the risk."""
    narrow = w.astype(xp.dtype)  # else every step would widen the whole matrix
    fp, fu = xp @ narrow, xu @ narrow
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    as_positive = -prior * (xp.T @ (1 - sp)) / len(xp)
    as_negative = (xu.T @ su) / len(xu) - prior * (xp.T @ sp) / len(xp)
    return float(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()), as_positive, as_negative


def descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int):
    """Weights after each step of the corrected risk's descent; the bias stays at or below the prior's."""
    highest = np.log(prior / (1 - prior))
    w, m, v = (np.zeros(xp.shape[1]) for _ in range(3))
    w[-1] = highest
    for step in range(1, steps + 1):
        negative, as_positive, as_negative = gradients(w, xp, xu, prior)
        gradient = as_positive + as_negative if negative >= 0 else -BACK * as_negative
        gradient[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[-1] = min(w[-1], highest)
        yield w


def corrected_mistakes(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> float:
    """The corrected risk with a loss of 1 for each mistake."""
    caught = (xp @ w > 0).mean()
    return float(prior * (1 - caught) + max(0.0, (xu @ w > 0).mean() - prior * caught))


def nonnegative_pu(x: np.ndarray, positive: np.ndarray, prior: float, held: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier. With ``held`` rows of both kinds, the others are learned from, and of the
    weights on the way those count that make the fewest corrected mistakes on the held rows, then those of least corrected risk,
    then the first. Else all rows are learned from to the end."""
    x = with_bias(x)
    if held is None or not all(rows.any() for rows in (held & positive, held & ~positive, ~held & positive, ~held & ~positive)):
        *_, w = descend(x[positive], x[~positive], prior, STEPS)
        return w[:-1], float(w[-1])
    vp, vu = x[held & positive], x[held & ~positive]
    best, chosen = None, None
    for step, w in enumerate(descend(x[~held & positive], x[~held & ~positive], prior, STEPS), 1):
        if step % EVERY == 0:
            found = tuple(round(f(w, vp, vu, prior), 9) for f in (corrected_mistakes, corrected_risk))
            if best is None or found < best:
                best, chosen = found, w
    return chosen[:-1], float(chosen[-1])


def standing_out(evidence: list[float], tested: int, by_chance: float = BY_CHANCE) -> int:
    """How many of the features (evidence falling, as minus the log of a bound on chance) to take, so that at most the share
    ``by_chance`` of them is expected to be chance among ``tested``."""
    held = [i for i, e in enumerate(evidence, 1) if -e <= math.log(by_chance * i / max(1, tested))]
    return max(held, default=0)


def choose_features(sample: DataFrame, prior: float, limit: int) -> list[str]:
    """The features that stand out; ``sample`` has text, positive, and known: whether an unlabelled text is a confirmed one.

    With rates p among positives and u among unlabelled texts, prior * p / u is the share of toxic texts among those with the
    feature. The evidence is the Chernoff bound on so many positives at the rate of unlabelled texts not confirmed. A feature
    of one positive can never stand out, so it isn't counted as tested."""

    def count(batches):
        counts: dict[tuple[bool, bool], Counter] = {}
        for batch in slices(batches):
            for text, *kind in zip(*(batch.column(c).to_pylist() for c in ("text", "positive", "known"))):
                counts.setdefault(tuple(kind), Counter()).update(features_of(text))
        for (positive, known), found in counts.items():
            kinds = [pa.array([k] * len(found), pa.bool_()) for k in (positive, known)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), *kinds, pa.array(found.values(), pa.int64())],
                names=["feature", "positive", "known", "n"],
            )

    totals = {(r["positive"], r["known"]): r["count"] for r in sample.groupBy("positive", "known").count().collect()}
    others = totals.get((False, False), 0)
    p, u = totals.get((True, False), 0), others + totals.get((False, True), 0)
    counted = (
        sample.mapInArrow(count, "feature string, positive boolean, known boolean, n bigint")
        .groupBy("feature")
        .agg(
            F.sum(F.expr("if(positive, n, 0)")).alias("p"),
            F.sum(F.expr("if(positive, 0, n)")).alias("u"),
            F.sum(F.expr("if(positive or known, 0, n)")).alias("other"),
        )
        .filter("p >= 2")
    )
    counted = written(counted, "toxicity-counts")  # bounded as the samples are
    rate_p, rate_u = F.col("p") / F.lit(max(1, p)), (F.col("u") + 1) / F.lit(u + 1)
    expected = p * (F.col("other") + 1) / F.lit(others + 1)
    evidence = F.round(F.col("p") * F.log(F.col("p") / expected) - F.col("p") + expected, 9)
    best = (
        counted.filter((prior * rate_p >= LEAST_ODDS * rate_u) & (F.col("p") > expected))
        .select("feature", evidence.alias("evidence"))
        .orderBy(F.desc("evidence"), "feature")
        .limit(limit)
        .collect()
    )
    return [r["feature"] for r in best[: standing_out([r["evidence"] for r in best], counted.count())]]


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES,
) -> Model:
    """Learns from ``docs`` and ``labels`` (both with ``key``), which hold training rows only.

    At most ``positives`` confirmed toxic texts and ``unlabelled`` other texts are read. The prior is the share of toxic rows
    among all labelled ones. Null labels and null keys count as no label. Without a toxic row, or with nothing else, no feature
    stands out and every text gets the prior."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter("key is not null and label is not null")
    toxic, known = marked.agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.count(F.lit(1))).first()
    prior = min(0.9, max(1e-3, (toxic or 0) / known if known else 0.0))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), spread_key(key).alias("order"))
    toxic_keys = marked.filter("label = 1").select("key", spread_key("key").alias("order")).distinct()
    confirmed = bounded_sample(toxic_keys, "order", positives).select("key")
    # one hot key may stand for many texts, so the texts are sampled once more
    certain = bounded_sample(texts.join(F.broadcast(confirmed), "key", "left_semi"), "order", positives)
    other = written(bounded_sample(texts, "order", unlabelled), "toxicity-others")
    among = toxic_keys.join(F.broadcast(other.select("key").distinct()), "key", "left_semi").select("key", F.lit(True).alias("known"))
    held = F.pmod(F.xxhash64("key", F.lit("held")), F.lit(HELD_OUT)) == 0
    sample = written(
        certain.select("text", F.lit(True).alias("positive"), F.lit(False).alias("known"), held.alias("held"))
        .union(other.join(F.broadcast(among), "key", "left").select(
            "text", F.lit(False).alias("positive"), F.coalesce("known", F.lit(False)).alias("known"), held.alias("held"))),
        "toxicity-sample",
    )
    chosen = choose_features(sample, prior, features)

    def rows(batches):
        words = WordFeatures(chosen)
        for batch in slices(batches):
            found = [words.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), batch.column("held"), pa.array(found, pa.list_(pa.int32()))], names=["positive", "held", "numbers"]
            )

    found = sample.mapInArrow(rows, "positive boolean, held boolean, numbers array<int>").toPandas()
    positive = found["positive"].to_numpy(dtype=bool)
    if not chosen or positive.all() or not positive.any():
        return Model([], np.zeros(0), float(np.log(prior / (1 - prior))))
    x = np.zeros((len(found), len(chosen)), dtype=np.float32)
    for i, numbers in enumerate(found["numbers"]):
        x[i, numbers] = 1
    held_rows = found["held"].to_numpy(dtype=bool)
    order = np.lexsort([*x.T[:8], held_rows, positive])  # sums in one order, however the rows came
    weights, bias = nonnegative_pu(x[order], positive[order], prior, held_rows[order])
    return Model(chosen, weights, bias)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of each whole text, 0 to 1. Null and empty texts have no feature and get the score of
    the bias, which is the prior at most. Equal texts get equal scores; other columns are not read."""
    source = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most FEATURES short strings and numbers

    def run(batches):
        words = WordFeatures(shared.value.features)
        for batch in slices(batches):
            found = shared.value.scores(batch.column(batch.num_columns - 1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*keep, into])

    return source.mapInArrow(run, source.select(*keep, F.lit(0.0).alias(into)).schema)

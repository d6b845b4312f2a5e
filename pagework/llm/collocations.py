"""Phrase collocations by Rabin-Karp fingerprints.

Every phrase of one to ``LONGEST`` words gets a fingerprint from prefix polynomials: with prefix sums of word codes times powers of an
inverse base, the polynomial of any span is one difference times one power, modulo 2^64. Word codes are polynomials over bytes, made
the same way. A language has its own start value, so phrases of two languages have different fingerprints.

1. Words are counted by fingerprint, then pairs, then longer phrases. A phrase is counted only if its words, and its pairs, can be
   frequent: a table of bits of fixed size says so, with errors on the safe side only. Fingerprints that collide add up, so no
   frequent phrase is lost.
2. Once more over the texts: each task groups the occurrences of fingerprints that can be frequent by their exact words, and gives
   (fingerprint, digest of language and text, count, pointer to one occurrence), packed by bucket of fingerprints. A shuffle adds them
   up, so phrases that share a fingerprint part, and keeps the first pointer; where the sum is large enough, it is followed into the texts.

So only frequent phrases ever stand as text, and their counts are exact. Cuts and longer phrases are joins on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.llm.common import slices, written

LONGEST = 5
BREAK = b"\xff"  # no byte of UTF-8
_BREAKS = bytes.maketrans(b".,;:!?\n\v\f\r", BREAK * 10)
UNKNOWN = "und"

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)
SLOTS = 1 << 26  # bits of a table, 8 MB
COUNTED = 44  # bits of a fingerprint while only counting: shorter rows, and a sum that may be too large, never too small
TOGETHER, KEPT, KEPT_WORDS = 1 << 17, 1 << 21, 1 << 19
BUCKET_BYTES = 8 << 20  # of text for each bucket of fingerprints


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased words, and ``BREAK`` wherever a piece ends."""
    return text.encode().lower().translate(_BREAKS).replace(BREAK, b" \xff ").split()  # splits at blanks and tabs: no other is left


class _Powers:
    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, 1 << 16), self.base, dtype=np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps, dtype=np.uint64)
        return self.known[:n]


_UP, _DOWN = _Powers(BASE), _Powers(INVERSE)


def prefixes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the values times falling powers; whole numbers modulo 2^64."""
    found = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _DOWN.upto(len(values)), out=found[1:])
    return found


def spans(prefix: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """The polynomial of each span of values: the last value counts once, the one before ``BASE`` times, and so on."""
    end = start + size
    return (prefix[end] - prefix[start]) * _UP.upto(len(prefix))[np.maximum(end - 1, 0)]


def mixed(x: np.ndarray) -> np.ndarray:
    """The same numbers with their bits spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes_of(words: list[bytes]) -> np.ndarray:
    sizes = np.array(list(map(len, words)), dtype=np.int64)
    letters = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return mixed(spans(prefixes(letters), np.cumsum(sizes) - sizes, sizes) + sizes.astype(np.uint64))


class Words(dict):
    """Numbers of words, from 1; 0 is a break."""

    def __init__(self):
        super().__init__({BREAK: 0})
        self.words: list[bytes] = [BREAK]
        self.new: list[bytes] = []
        self.codes = np.zeros(1, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.words.append(word)
        self.new.append(word)
        return number

    def settle(self) -> None:
        if self.new:
            self.codes = np.concatenate([self.codes, codes_of(self.new)])
            self.new = []


def listed(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slot = prints & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


class Stretch:
    """Texts of one language behind each other, a break before each and one at the end."""

    def __init__(self, lang: str, texts: list[tuple[int, list[int]]], words: Words, bits: int = 64):
        words.settle()
        self.mask = np.uint64((1 << bits) - 1)
        self.rows = np.array([row for row, _ in texts], dtype=np.int64)
        sizes = np.array([len(numbers) + 1 for _, numbers in texts], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.words = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
        inside = np.ones(len(self.words), dtype=bool)
        inside[self.starts] = inside[-1] = False
        self.words[inside] = np.fromiter((n for _, numbers in texts for n in numbers), np.int64)
        self.prefix = prefixes(words.codes[self.words])
        self.seed = codes_of([lang.encode()])  # an array, so that products may wrap

    def prints(self, at: np.ndarray, size: int) -> np.ndarray:
        return mixed(spans(self.prefix, at, size) + self.seed * np.uint64(2 * size + 1)) & self.mask

    def phrases(self, tables: dict[int, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of phrases of ``size`` words that can be frequent by the ``tables`` of shorter ones, and their fingerprints."""
        if size == 1:
            at = np.flatnonzero(self.words)
            return at, self.prints(at, 1)
        if not hasattr(self, "links"):
            single = np.zeros(len(self.words) + 1, dtype=bool)
            at, found = self.phrases(tables, 1)
            single[at] = listed(tables[1], found)
            self.pairs = np.flatnonzero(single[:-1] & single[1:])
            self.of_pairs = self.prints(self.pairs, 2)
            self.links = np.zeros(len(self.words), dtype=bool)
            if 2 in tables:
                self.links[self.pairs] = listed(tables[2], self.of_pairs)
        if size == 2:
            return self.pairs, self.of_pairs
        whole = self.links.copy()
        for step in range(1, size - 1):
            whole[:-step] &= self.links[step:]
        at = np.flatnonzero(whole)
        return at, self.prints(at, size)

    def pointers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place in the row's tokens."""
        text = np.searchsorted(self.starts, at, side="right") - 1
        return self.rows[text], at - self.starts[text] - 1


def stretches(batches, words: Words, flush, bits: int):
    """Stretches of about ``TOGETHER`` words from batches of (row, lang, text). ``flush`` is called where the words start anew."""
    waiting: dict[str, list] = {}
    held: dict[str, int] = {}
    for batch in slices(batches):
        for row, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            numbers = list(map(words.__getitem__, tokens_of(text)))
            waiting.setdefault(lang, []).append((row, numbers))
            held[lang] = held.get(lang, 0) + len(numbers)
            if held[lang] >= TOGETHER:
                yield lang, Stretch(lang, waiting.pop(lang), words, bits)
                del held[lang]
        if sum(held.values()) >= 8 * TOGETHER or len(words) > KEPT_WORDS:
            for lang in list(waiting):
                yield lang, Stretch(lang, waiting.pop(lang), words, bits)
            held.clear()
        if len(words) > KEPT_WORDS:
            yield from flush()
            words.clear()
            words.__init__()
    for lang in list(waiting):
        yield lang, Stretch(lang, waiting.pop(lang), words, bits)


def summed(prints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(prints), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


def count_prints(rows: DataFrame, sizes: list[int], tables, bits: int = 64) -> DataFrame:
    """(print, n): how often each fingerprint stands in all texts, for phrases of these sizes that can be frequent."""

    def run(batches):
        prints, counts, held = [], [], 0
        known = {n: table.value for n, table in tables.items()}
        for item in stretches(batches, Words(), lambda: [None], bits):
            if item is None:
                continue
            for size in sizes:
                found, times = np.unique(item[1].phrases(known, size)[1] & np.uint64((1 << COUNTED) - 1), return_counts=True)
                prints.append(found)
                counts.append(times)
                held += len(found)
            if held > KEPT:
                found, times = summed(prints, counts)
                prints, counts, held = [found], [times], len(found)
                if held > KEPT // 2:
                    yield batch_of(found, times)
                    prints, counts, held = [], [], 0
        if prints:
            yield batch_of(*summed(prints, counts))

    def batch_of(found, times):
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["print", "n"])

    return rows.mapInArrow(run, "print bigint, n bigint").groupBy("print").agg(F.sum("n").alias("n"))


def bit_table(prints: DataFrame) -> np.ndarray:
    """A bit for each fingerprint's slot; ``SLOTS`` bits, whatever the number of rows."""
    slot = F.col("print").bitwiseAND(F.lit(SLOTS - 1))
    numbers = prints.groupBy(F.shiftright(slot, 6).alias("number")).agg(F.bit_or(F.expr("shiftleft(1L, cast(print & 63 as int))")).alias("bits"))
    found = numbers.toArrow()
    bits = np.zeros(SLOTS // 64, dtype=np.uint64)
    bits[found["number"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


class Groups:
    """Occurrences of phrases of one size, by fingerprint and exact words: count, and a pointer to the first."""

    def __init__(self, size: int):
        self.size, self.parts, self.held = size, [], 0

    def add(self, *part: np.ndarray) -> None:
        """Fingerprints, (occurrence, language and words), counts, rows, places."""
        self.parts.append(self.grouped(*part))
        self.held += len(self.parts[-1][0])
        if self.held > KEPT // 2:
            self.parts = [self.grouped(*map(np.concatenate, zip(*self.parts)))]
            self.held = len(self.parts[0][0])

    @staticmethod
    def grouped(prints, words, counts, rows, places):
        """Neighbours in the order of fingerprints are one group if all their words agree as well."""
        order = np.argsort(prints, kind="stable")
        prints, words = prints[order], words[order]
        new = np.append(True, (prints[1:] != prints[:-1]) | (words[1:] != words[:-1]).any(axis=1))[: len(prints)]
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], first) if len(first) else counts
        return prints[first], words[first], total, rows[order][first], places[order][first]

    def out(self, words: list[bytes], langs: list[str]) -> tuple[np.ndarray, ...] | None:
        """Sizes, fingerprints, digests of language and text, counts, rows, places of the groups so far."""
        if not self.parts:
            return None
        prints, numbers, counts, rows, places = self.grouped(*map(np.concatenate, zip(*self.parts)))
        self.parts, self.held = [], 0
        names = [lang.encode() + BREAK for lang in langs]
        texts = (names[row[0]] + b" ".join([words[i] for i in row[1:]]) for row in numbers.tolist())
        digests = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(prints))
        return np.full(len(prints), self.size, np.int32), prints.view(np.int64), digests.view(np.int64), counts, rows, places.astype(np.int32)


COLUMNS = ["size", "print", "digest", "n", "row", "at"]
KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
PACKED = "bucket bigint, lang string, total bigint, " + ", ".join(f"{c} array<{'int' if k == pa.int32() else 'bigint'}>" for c, k in zip(COLUMNS, KINDS))


def packed(columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Groups by bucket of their fingerprint, a row for each bucket that has some."""
    bucket = (columns[1].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    ends = pa.array(np.append(first, len(order)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(c[order], k)) for c, k in zip(columns, KINDS)]
    none = [pa.nulls(len(found), pa.string()), pa.nulls(len(found), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(found), *none, *lists], names=["bucket", "lang", "total", *COLUMNS])


def point(rows: DataFrame, tables, longest: int, buckets: int, bits: int = 64) -> DataFrame:
    """The groups of each task, those of one bucket packed in a row, and a row (without bucket) for the words of each of its languages."""

    def run(batches):
        words, totals, numbers = Words(), {}, {}
        groups = [Groups(size) for size in range(1, longest + 1)]
        known = {n: table.value for n, table in tables.items()}

        def out():
            found = [x for x in (group.out(words.words, list(numbers)) for group in groups) if x]
            if found:
                yield packed([np.concatenate(c) for c in zip(*found)], buckets)

        for item in stretches(batches, words, out, bits):
            if isinstance(item, pa.RecordBatch):
                yield item
                continue
            lang, stretch = item
            totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(stretch.words))
            number = numbers.setdefault(lang, len(numbers))
            for group in groups:
                at, prints = stretch.phrases(known, group.size)
                held = listed(known[group.size], prints)
                at, prints = at[held], prints[held]
                exact = np.stack([np.full(len(at), number), *(stretch.words[at + i] for i in range(group.size))], axis=1)
                group.add(prints, exact, np.ones(len(at), np.int64), *stretch.pointers(at))
            if max(group.held for group in groups) > KEPT // 2:
                yield from out()
        yield from out()
        n = len(totals)
        lists = [pa.nulls(n, pa.list_(k)) for k in KINDS]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64()), *lists],
            names=["bucket", "lang", "total", *COLUMNS],
        )

    return rows.mapInArrow(run, PACKED)


def add_up(pointers: DataFrame, least: int) -> DataFrame:
    """(size, n, row, at) of the phrases that stand ``least`` times and more: counts of equal fingerprint and digest added up over all
    tasks, with the first pointer. A bucket is a bounded stretch of fingerprints."""

    def run(table: pa.Table) -> pa.Table:
        columns = [np.concatenate([x.values.to_numpy() for x in table[c]]) for c in COLUMNS]
        order = np.lexsort([columns[i] for i in (5, 4, 2, 1, 0)])
        size, print_, digest, n, row, at = (c[order] for c in columns)
        new = np.append(True, (size[1:] != size[:-1]) | (print_[1:] != print_[:-1]) | (digest[1:] != digest[:-1]))
        first = np.flatnonzero(new)
        total = np.add.reduceat(n, first)
        kept = total >= least
        first, total = first[kept], total[kept]
        return pa.table([pa.array(size[first]), pa.array(total), pa.array(row[first]), pa.array(at[first])], names=["size", "n", "row", "at"])

    return pointers.filter("bucket is not null").groupBy("bucket").applyInArrow(run, "size int, n bigint, row bigint, at int")


def follow(pointers: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, phrase, words, n): the counts of the pointers, added up by the text they lead to."""
    wanted = pointers.groupBy("row").agg(F.collect_list(F.struct("size", "at", "n")).alias("wanted"))  # at most the row's phrases

    def run(batches):
        for batch in slices(batches):
            found = []
            for lang, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = tokens_of(text)
                found += [(lang, b" ".join(tokens[w["at"] : w["at"] + w["size"]]), w["size"], w["n"]) for w in wanted]
            columns = list(zip(*found)) or [()] * 4
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.string()), *columns[2:]], names=["lang", "phrase", "words", "n"])

    texts = rows.join(wanted, "row").select("lang", "text", "wanted")
    return texts.mapInArrow(run, "lang string, phrase string, words int, n bigint").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def frequent_phrases(
    docs: DataFrame, least: int, longest: int = LONGEST, text: str = "text", lang: str = "lang", bits: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases that stand ``least`` times and more, counts exact; and (lang, total) words. Fewer
    ``bits`` of a fingerprint make more of them collide and more pointers to follow; the result is the same."""
    rows = written(
        docs.select(
            F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).select(F.monotonically_increasing_id().alias("row"), "lang", "text"),
        "phrase-rows",
    )  # written, so that pointers keep their meaning
    context, tables = docs.sparkSession.sparkContext, {}
    for sizes in ([1], [2], list(range(3, longest + 1))):
        if sizes and sizes[0] <= longest:
            table = context.broadcast(bit_table(count_prints(rows, sizes, tables, bits).filter(F.col("n") >= least)))
            tables |= {size: table for size in sizes if size <= longest}
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pointers = written(point(rows, tables, longest, 1 + length // BUCKET_BYTES, bits), "phrase-pointers")
    exact = follow(add_up(pointers, least), rows).filter(F.col("n") >= least)
    totals = pointers.filter("bucket is null").groupBy("lang").agg(F.sum("total").alias("total"))
    return written(exact, "phrases"), written(totals, "phrase-totals")


def part(first: Column | int, size: Column | int) -> Column:
    whole = F.split("phrase", " ")
    return F.array_join(F.slice(whole, first, size), " ")


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST, kept_percent: int = 100, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, n the words of the language. The score is the least, over all cuts of the phrase in two, of
    floor(1000 a n / (l r)) with the counts l and r of the parts; of equal cuts the first counts. A phrase inside a longer one that has
    ``kept_percent`` of its count and more is left out. Order: score, a (both falling), phrase in byte order.

    A null text is empty and a null language ``und``. Texts and words of any length are read whole; repeated rows count each; other
    columns are not read. An empty table gives an empty result."""
    found, totals = frequent_phrases(docs, least, longest, text, lang)
    several = found.filter("words > 1")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    counted = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(1000 * {whole('a')} as decimal(19,0)) * {whole('total')} div ({whole('l')} * {whole('r')})")
    best = counted.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = several.filter("words > 2").select("lang", "n", "phrase", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "n", F.explode(F.expr("transform(sequence(1, words - size + 1), i -> array_join(slice(split(phrase, ' '), i, size), ' '))")).alias("phrase"))
    outer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("outer"))
    open_ones = best.join(outer, ["lang", "phrase"], "left").filter(
        F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * kept_percent)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    return (
        open_ones.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
    )

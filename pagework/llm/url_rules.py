"""URL filters: explicit rules, and association rules mined by FP-growth for the URLs that no explicit rule fits.

A URL is a set of tokens: its scheme, host labels, path segments (digits as one mark) and query parameter names. The URLs
with a label are transactions of their tokens and that label. FP-growth finds the frequent combinations; those that imply a
label with enough support and confidence are rules. Rules are matched by an inverted index from token to rule: a rule
holds where as many of its tokens are found as it has. Everything is DataFrame and Spark ML work.

Matching works on distinct token sets, so a host or token with a third of all rows is one set, not many rows. Tokens that
stand in exactly the same labelled URLs are one token to the miner, so a URL that is repeated often gives few combinations.
A URL with any of them has that token: each combination of them has the same support and confidence, so the rules that hold
are those of FP-growth over all tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label:"  # no token of a URL starts like this

Rules = list[tuple[str, str, str]]  # (verdict, host, path)


def _rest(url: str) -> Column:
    """What follows the first "://"; null without one."""
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substr(F.col(url), at + 3))


def host_of(url: str) -> Column:
    """Host in ASCII lower case; empty for null and for texts without "://"."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: Rules, host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``rule``, a struct (rule, verdict): the longest rule that fits, null if none does. A rule fits its host and all
    subdomains where the path starts with the rule's. Of rules of one length the one with the longer host wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:], r[0]))
    fits = [
        F.when(
            ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in ordered
    ]
    return df.withColumn("rule", F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>")))


def tokens_of(url: str, host: str, path: str) -> Column:
    """Distinct tokens of a URL, sorted; none for null."""
    text = F.coalesce(F.col(url), F.lit(""))
    marked = [
        F.transform(
            F.filter(found, lambda x: x != ""), lambda x, mark=mark: F.concat(F.lit(mark), F.regexp_replace(x, r"[0-9]+", "0"))
        )
        for mark, found in (
            ("scheme:", F.array(F.regexp_extract(text, r"^([^:/?#]*)://", 1))),
            ("host:", F.split(F.col(host), r"\.")),
            ("path:", F.split(F.col(path), "/")),
            ("query:", F.regexp_extract_all(F.regexp_extract(text, r"\?([^#]*)", 1), F.lit(r"([^&=]+)(=[^&]*)?"), F.lit(1))),
        )
    ]
    return F.array_sort(F.array_distinct(F.concat(*marked)))


def frequent_tokens(sets: DataFrame, support: float) -> dict[str, str]:
    """Tokens in at least that share of the sets, each with the first of the tokens that stand in the same sets, which stands
    for it. A token of share s uses up s of the mean set size, so there are at most (mean set size / support) of them."""
    rows = sets.count()
    counted = (
        sets.select(F.explode("tokens").alias("token"), F.xxhash64("row").cast("decimal(20,0)").alias("mark"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("mark"))
        .filter(F.col("n") >= support * rows)
    )
    groups = {}
    for token, *same in sorted(tuple(r) for r in counted.select("token", "n", "mark").collect()):
        groups.setdefault(tuple(same), []).append(token)
    return {token: group[0] for group in groups.values() for token in group}


def among(tokens: str, wanted: dict[str, str]) -> Column:
    """What stands for the frequent tokens, sorted."""
    common = lambda some: F.array_intersect(F.col(tokens), F.array(*map(F.lit, some)).cast("array<string>"))
    found = common([t for t in wanted if wanted[t] == t])
    if others := [t for t in wanted if wanted[t] != t]:
        first = F.create_map(*[F.lit(x) for t in others for x in (t, wanted[t])])
        found = F.array_distinct(F.concat(found, F.transform(common(others), lambda x: F.element_at(first, x))))
    return F.array_sort(found)


def mine(labelled: DataFrame, support: float, confidence: float) -> tuple[DataFrame, dict[str, str]]:
    """Rules (rule_id, verdict, antecedent, confidence, support) from ``labelled`` (row, tokens, verdict), and the frequent
    tokens with those that stand for them in rules. ``row`` tells URLs apart. Support is a share of the labelled rows. No labelled row gives no rule."""
    wanted = frequent_tokens(labelled, support)
    transactions = labelled.select(
        F.concat(among("tokens", wanted), F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(transactions)
    rules = model.associationRules.select(
        F.xxhash64(F.array_sort("antecedent"), "consequent").alias("rule_id"),
        F.element_at("consequent", 1).alias("verdict"),
        F.array_sort("antecedent").alias("antecedent"),
        "confidence",
        "support",
    ).filter(F.startswith("verdict", F.lit(LABEL)) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(LABEL))))
    return written(rules.withColumn("verdict", F.expr(f"substring(verdict, {len(LABEL) + 1})")), "url-rules"), wanted


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct ``items`` of ``sets``, the verdict of the rule that holds with the highest confidence, then support,
    then most tokens, then in text order. Sets that no rule fits are missing."""
    index = rules.select(
        F.explode("antecedent").alias("token"), "rule_id", "verdict", "antecedent", "confidence", "support"
    )
    hits = sets.select("items", F.explode("items").alias("token")).join(index, "token")
    held = (
        hits.groupBy("items", "rule_id")
        .agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("verdict", "antecedent", "confidence", "support")])
        .filter(F.col("n") == F.size("antecedent"))
    )
    best = F.max(
        F.struct("confidence", "support", F.size("antecedent"), F.array_join("antecedent", " "), "verdict")
    ).alias("best")
    return held.groupBy("items").agg(best).select("items", F.col("best.verdict").alias("mined"))


def judge(
    df: DataFrame, keep: list[str], rules: Rules, url: str = "url", support: float = 0.01, confidence: float = 0.9,
    otherwise: str = "allow",
) -> DataFrame:
    """The columns ``keep`` with host, path, rule and verdict.

    URLs that an explicit rule fits are the labelled ones; all others get the verdict of the best mined rule that holds, or
    ``otherwise``. Null, empty and malformed URLs have an empty host and path and get ``otherwise``. Repeated rows get
    equal verdicts; an empty table gives an empty one; other columns are not read."""
    split = df.select(
        F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(url).alias("url"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    ruled = with_rule(split, rules).withColumn("tokens", tokens_of("url", "host", "path"))
    labelled = ruled.filter("rule is not null").select(F.col("url").alias("row"), "tokens", "rule.verdict")
    found, wanted = mine(labelled, support, confidence)
    items = ruled.withColumn("items", among("tokens", wanted))
    # A written table, so that Spark knows its size, and can split a set that many URLs have where it does not broadcast it.
    verdicts = written(matched(items.filter("rule is null").select("items").distinct(), found), "url-verdicts")
    return items.join(verdicts, "items", "left").select(
        "kept.*", "host", "path", F.col("rule.rule").alias("rule"),
        F.coalesce("rule.verdict", "mined", F.lit(otherwise)).alias("verdict"),
    )

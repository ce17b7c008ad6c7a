"""Learned decision lists over text statistics, as Spark conditional expressions.

:func:`features` computes each text's statistics with built-in functions.  :func:`learn` runs
sequential covering on the statistics of labelled rows: a rule (a conjunction of thresholds) grows
by information gain until it covers no good text, is pruned on rows held back, and takes the rows
it covers with it; the list ends when a new rule is no better than chance on the held-back rows.
:meth:`DecisionList.verdict` is the ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import SPACE, drop_head, labelled_texts, let, take_head, words

#: Labelled rows that a list is learned from, at most: those with the least hash of their id.
MAX_LABELLED = 20_000
#: Statistics a rule may test, each with the value that texts without words get (0).
FEATURES = ("mean_word", "symbol_share", "bang_share", "bar_share", "repeat_share", "dup_line_share", "stop_share")
#: Words up to which a window's place fits into 12 bits.
SHORT = 4096
#: Rows labelled 0 that a rule must cover among those held back.
LEAST_BAD = 3


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    Words are runs of characters other than ASCII white space.  A repeated word lies in a 3-word
    window that occurs twice or more in the text.  Windows are compared by 64-bit hashes of their
    words, inside one text only.  Null and empty texts: all 0.  Columns of ``docs`` with these
    names are replaced.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    parts = words(body)
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE[1:]}")))
    return (
        docs.withColumn("_words", parts)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
        .withColumn("n_repeat_words", repeated_words(F.col("_words")))
        .drop("_words")
    )


def repeated_words(parts: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the array of words.

    Up to SHORT words, hash and place of a window share a long (51 bits and 12), which sorts
    without boxing; longer texts sort pairs of a 64-bit hash and the place.
    """
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def window(h: Column, x: Column, i: Column) -> Column:
        return F.xxhash64(x, h[i + 1], h[i + 2])

    def packed(h: Column) -> Column:
        high = F.lit((1 << 63) - SHORT)
        return F.sort_array(F.transform(take_head(h, F.size(h) - 2), lambda x, i: window(h, x, i).bitwiseAND(high).bitwiseOR(i.cast("long"))))

    def packed_again(s: Column) -> Column:
        near = lambda x, j: x.bitwiseXOR(F.get(s, j)) < SHORT
        return F.sort_array(F.transform(F.filter(s, lambda x, i: near(x, i + 1) | near(x, i - 1)), lambda x: x.bitwiseAND(F.lit(SHORT - 1)).cast("int")))

    def pairs(h: Column) -> Column:
        return F.sort_array(F.transform(take_head(h, F.size(h) - 2), lambda x, i: F.struct(window(h, x, i).alias("h"), i.alias("i"))))

    def pairs_again(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        """Windows of 3 from sorted places: each covers 3 words less those of the next."""
        gaps = F.zip_with(take_head(at, F.size(at) - 1), drop_head(at, 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda n, g: n + g))

    short = let(let(hashes, packed), packed_again)
    long = let(let(hashes, pairs), pairs_again)
    return F.when(F.size(parts) < 4, F.lit(0)).when(F.size(parts) <= SHORT, let(short, covered)).otherwise(let(long, covered)).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with :func:`base_statistics` and FEATURES (double)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = base_statistics(docs, text)
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    count = lambda what: F.length(body) - F.length(F.replace(body, F.lit(what), F.lit("")))
    n_lines = 1 + count("\n")
    return df.withColumns(
        {
            "mean_word": F.col("word_chars") / n,
            "symbol_share": F.col("n_symbols") / chars,
            "bang_share": count("!") / n,
            "bar_share": count("|") / n,
            "repeat_share": F.col("n_repeat_words") / n,
            "dup_line_share": F.col("n_dup_lines") / n_lines,
            "stop_share": (count(".") + count(",")) / n,
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature >= cut`` (above) or ``feature < cut``."""

    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.cut) == self.above

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.cut) if self.above else value < F.lit(self.cut)

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut!r}"


@dataclass(frozen=True)
class DecisionList:
    """Rules, in order, each of which rejects; a text that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule_number(self) -> Column:
        """1 for the first rule that covers the row, and so on; 0 where none does."""
        case = None
        for i, rule in enumerate(self.rules, 1):
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            case = F.when(test, F.lit(i)) if case is None else case.when(test, F.lit(i))
        return F.lit(0) if case is None else case.otherwise(F.lit(0))

    def verdict(self) -> Column:
        return self.rule_number() == 0

    def rejects(self, row: dict) -> bool:
        return any(all(c.holds(row) for c in rule) for rule in self.rules)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(c.sql() for c in rule) for rule in self.rules) or "keep all"


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[dict]:
    """Statistics and label of the labelled rows with the least hash of their id, ``limit`` at most.

    Rows that fail the base are left out: the list judges only what the base lets through.
    Repeated labels of one id count once (the least), as do repeated rows; labels without a row, and
    null labels, don't.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    few = marks.orderBy(order, "doc_id").limit(limit)
    # `limit` rows: kept before their statistics are computed, lest Spark computes those of all documents
    picked = labelled_texts(docs, few)
    rows = features(picked).where(~base_failed()).select("doc_id", "_label", *FEATURES).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: tuple(r))]


def learn(rows: list[dict], max_rules: int = 12, max_terms: int = 3) -> DecisionList:
    """A list that rejects rows labelled 0.  Rows need ``_label`` and FEATURES; none: keep all.

    Every third row is held back.  A rule is grown on the others and pruned on those held back; it joins
    the list if it covers LEAST_BAD of them that are labelled 0, and right three times in four.
    """
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    bad = np.array([r["_label"] == 0 for r in rows], bool)
    back, left = np.arange(len(rows)) % 3 == 0, np.ones(len(rows), bool)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules:
        hold = left & back
        rule = _prune(_grow(x[left & ~back], bad[left & ~back], max_terms), x[hold], bad[hold])
        hit = _covers(rule, x)
        n_bad, n_good = int((hit & hold & bad).sum()), int((hit & hold & ~bad).sum())
        if not rule or n_bad < LEAST_BAD or n_bad <= 3 * n_good:
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(tuple(rules))


def _covers(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= (x[:, FEATURES.index(c.feature)] >= c.cut) == c.above
    return out


def _grow(x: np.ndarray, bad: np.ndarray, max_terms: int) -> tuple[Condition, ...]:
    """Conditions one by one, each of the most information gain over the rows that are left; cuts lie halfway between neighbouring values."""
    rule: tuple[Condition, ...] = ()
    while len(rule) < max_terms and bad.any() and not bad.all():
        n_bad, n_good = bad.sum(), (~bad).sum()
        base, best, most = math.log2(n_bad / len(bad)), None, 1e-9
        for j, feature in enumerate(FEATURES):
            order = np.argsort(x[:, j], kind="stable")
            v, below = x[order, j], np.cumsum(bad[order])
            edge = np.flatnonzero(v[1:] > v[:-1])
            p_low = below[edge]
            for above, p, n in ((False, p_low, edge + 1), (True, n_bad - p_low, len(bad) - edge - 1)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - base), -1.0)
                if len(gain) and gain.max() > most:
                    k = int(gain.argmax())
                    most, best = float(gain[k]), Condition(feature, above, float((v[edge[k]] + v[edge[k] + 1]) / 2))
        if best is None:
            break
        rule += (best,)
        held = _covers((best,), x)
        x, bad = x[held], bad[held]
    return rule


def _prune(rule: tuple[Condition, ...], x: np.ndarray, bad: np.ndarray) -> tuple[Condition, ...]:
    """The rule without the conditions that are worth nothing on rows held back, taken off one by one, the least useful first."""

    def worth(terms: tuple[Condition, ...]) -> float:
        hit = _covers(terms, x)
        return float((2 * (hit & bad).sum() - hit.sum()) / hit.sum()) if hit.any() else -2.0

    while len(rule) > 1:
        shorter = max((rule[:k] + rule[k + 1 :] for k in range(len(rule))), key=worth)
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


def apply_rules(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with the statistics, base_failed, rule and kept.

    Null and empty texts fail the base.  Without labels the base alone decides.
    """
    rules = learn(labelled_sample(docs, labels, limit))
    return (
        features(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(F.col("base_failed"), F.lit(-1)).otherwise(rules.rule_number()).cast("int"))
        .withColumn("kept", F.col("rule") == 0)
    )

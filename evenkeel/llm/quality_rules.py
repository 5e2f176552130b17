"""Quality rules learned by sequential covering.

From the statistics of labelled documents the learner grows conjunctions of thresholds that single out low quality,
prunes each on held-back rows, and goes on with what is not yet covered.  The ordered list becomes one
conditional expression of Spark; statistics and verdicts are built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import whole_rows

#: The base limits: words, and words in repeated windows for each hundred words.
LEAST_WORDS, MOST_REPEATED = 50, 50
_WS = r"[ \t\n\x0B\f\r]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "upper_share", "mark_share", "digit_share", "stop_rate", "word_length", "dup_line_share", "repeat_share")
_SPLIT = 31  # bits of a word's position, enough for any array; the rest of a packed number is hash


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more.  Hashes only choose the windows that are compared."""
    low = (1 << _SPLIT) - 1
    high = lambda x: F.shiftright(x, _SPLIT)

    def covered(q):
        gaps = F.transform(q, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(q, k + 1), p + 3) - p))
        return F.aggregate(gaps, F.lit(0).cast("int"), lambda a, b: a + b)

    def exact(w, c):
        at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
        named = F.sort_array(
            F.transform(c, lambda x: F.struct(F.concat_ws(" ", F.get(w, at(x)), F.get(w, at(x) + 1), F.get(w, at(x) + 2)).alias("g"), at(x).alias("p")))
        )
        same = lambda g: F.filter(g, lambda y, k: (y["g"] == F.get(g, k - 1)["g"]) | (y["g"] == F.get(g, k + 1)["g"]))
        return _let(named, lambda g: _let(F.sort_array(F.transform(same(g), lambda y: y["p"])), covered))

    def of(w):
        packed = F.sort_array(
            F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                lambda x, i: F.shiftleft(high(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), _SPLIT).bitwiseOR(i.cast("long")),
            )
        )
        met = lambda p: F.filter(p, lambda x, k: (high(x) == high(F.get(p, k - 1))) | (high(x) == high(F.get(p, k + 1))))
        return _let(packed, lambda p: _let(met(p), lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(exact(w, c))))

    return _let(words, of)


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def with_statistics(docs: DataFrame, text: Column) -> DataFrame:
    """Add the base counts and the features of a text; a null text counts as empty."""
    out = docs.withColumn("_t", F.coalesce(text.cast("string"), F.lit("")))
    words = F.filter(F.split("_t", f"{_WS}+"), lambda x: x != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    out = out.withColumn("_w", F.struct(words.alias("w"), lines.alias("l")))
    out = out.select(
        *[F.col(c) for c in docs.columns], "_t",
        F.size("_w.w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", f"{_WS}+", "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
        F.size("_w.l").cast("long").alias("n_lines"),
        (F.size("_w.l") - F.size(F.array_distinct("_w.l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w.w")).cast("long").alias("n_repeat_words"),
        _count(F.col("_t"), r"\p{Lu}").alias("_upper"), _count(F.col("_t"), "!?").alias("_marks"),
        _count(F.col("_t"), "0-9").alias("_digits"), _count(F.col("_t"), ".,").alias("_stops"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(
        *docs.columns, *BASE,
        per("n_symbols", "word_chars").alias("symbol_share"), per("_upper", "word_chars").alias("upper_share"), per("_marks", "word_chars").alias("mark_share"),
        per("_digits", "word_chars").alias("digit_share"), per("_stops", "n_words").alias("stop_rate"), per("word_chars", "n_words").alias("word_length"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"), per("n_repeat_words", "n_words").alias("repeat_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4, cuts: int = 48) -> Rule:
    """Add the condition of greatest information gain until only low quality is covered, `most` at most.

    Thresholds lie half way between neighbouring values; where there are more than `cuts` of them, they are `cuts` quantiles
    of either kind of row instead."""
    chosen: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(chosen) < most and (bad[inside] == False).any():  # noqa: E712
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        best, gain = None, 1e-9
        for f in FEATURES:
            v = x[f]
            values = np.unique(np.concatenate([v[inside & bad], v[inside & ~bad]]))
            if len(values) < 2:
                continue
            mids = (values[:-1] + values[1:]) / 2
            if len(mids) > cuts:
                mids = np.unique(np.concatenate([np.quantile(v[inside & bad], np.linspace(0, 1, cuts)), np.quantile(v[inside & ~bad], np.linspace(0, 1, cuts))]))
            for t in mids.tolist():
                for above in (True, False):
                    hit = (v > t if above else v <= t) & inside
                    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(f, above, t), g
        if best is None:
            break
        chosen.append(best)
        inside &= best.holds(x)
    return Rule(tuple(chosen))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop final conditions while that does no harm on held-back rows."""

    def worth(r: Rule) -> float:
        hit = r.holds(x)
        return (int((hit & bad).sum()) - int((hit & ~bad).sum())) / max(1, int(hit.sum()))

    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:k])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, most: int = 12, precision: float = 0.97, support: int = 3) -> list[Rule]:
    """Ordered rules for rows of low quality, `most` at most.  `held` are the rows kept back for pruning; a rule must be right
    on both parts at least that often, and cover `support` of those rows that earlier rules left.  These bounds shape the
    list that is learned; they leave out no document when it is applied."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    sub = lambda mask: ({f: v[mask] for f, v in x.items()}, bad[mask])
    while len(rules) < most and (bad & left & ~held).sum() >= support:
        rule = _prune(_grow(*sub(left & ~held)), *sub(left & held)) if (left & held).any() else _grow(*sub(left & ~held))
        if not rule.conditions:
            break
        hit = rule.holds(x) & left
        if hit.sum() < support or any(m.sum() and bad[m].mean() < precision for m in (hit & ~held, hit & held)):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> list[Rule]:
    """Learn from documents (doc_id, text) with a label (doc_id, quality 0 or 1), of those that pass the base limits: 12 rules
    of 4 conditions at most.

    `most` bounds the labels that are used: those with the smallest hashes of their id, over the
    whole table.  Null ids and labels are left out; without labels of both kinds there is no rule.
    """
    rows = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id")  # `most` rows at most
    # the base limits are applied here: as a filter they would be pushed below the join and computed for every document
    found = with_statistics(src.select("doc_id", "quality", "text"), F.col("text")).select("doc_id", "quality", "n_words", "n_repeat_words", *FEATURES)
    found = [r for r in found.collect() if r["n_words"] >= LEAST_WORDS and 100 * r["n_repeat_words"] <= MOST_REPEATED * r["n_words"]]
    found.sort(key=lambda r: (r["doc_id"], r["quality"]))
    if not found:
        return []
    x = {f: np.array([r[f] for r in found], dtype=np.float64) for f in FEATURES}
    bad = np.array([r["quality"] == 0 for r in found])
    held = np.array([r["doc_id"] * 2654435761 % 3 == 0 for r in found])
    return learn_rules(x, bad, held) if bad.any() and not bad.all() else []


def decision(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = rule.conditions[0].column()
        for c in rule.conditions[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(str(rule))).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def quality_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the rule that decided, for each row.

    A null or empty text has no words and fails.  Rows are judged by themselves, repeated ones and null ids included.  Only the
    id and text columns are read, so that others may have any name; an empty table gives no rows.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = with_statistics(src, F.col("text")).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base limits and no rule, columns unchanged.

    Null and empty texts go.  Rows are judged by themselves, repeated ones and null ids included.  Whole rows travel in one
    column, so that theirs may have any name; an empty table gives no rows, and without labels only the base limits hold.
    """
    rules = fit(docs, labels)
    kept = with_statistics(docs.select(whole_rows(docs).alias("row"), F.col("text").alias("t")), F.col("t"))
    return kept.where(~base_failed() & decision(rules).isNull()).select("row.*")

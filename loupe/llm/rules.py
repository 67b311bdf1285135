"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes for a good or a bad document or abstains. The votes of all documents are
counted by pattern (at most ``3 ** rules`` rows, whatever the corpus), expectation-
maximisation on those counts estimates the share of good documents and, for each rule, how
often it votes good on good and bad on bad documents, and every document gets its
posterior probability of being good. With the bound on false alarms (``estimate``) one bad
vote mostly rejects alone: on the given tables the verdict is that of all rules passing (README).

Words are runs outside ``[\\x20\\x09-\\x0D]``. Null texts have no words. Rows that repeat count
and come out as often as they go in; null ids stay null; further columns are ignored.
An empty table gives an empty result (and the starting estimates).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.store import written

_SPACE = " \t\n\x0b\f\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are not among ``chars``."""
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash of their three words. Only texts in which one
    repeats sort their windows; each start then covers up to three words, fewer where
    the next start is nearer.
    """
    at = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ordered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    starts = lambda s: F.sort_array(F.filter(F.transform(s, lambda e, k: F.when(
        (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"])), lambda x: x.isNotNull()))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                                    F.lit(0), lambda a, x: a + x)
    # each step is bound once by a one-element transform, so nothing is evaluated twice
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    some = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), bind(ordered(h), lambda s: bind(starts(s), covered))).otherwise(F.lit(0)))
    return F.when(n >= 3, some).otherwise(F.lit(0)).cast("bigint")


def text_measures(docs: DataFrame) -> DataFrame:
    """(doc_id and the measures that the rules read) for every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", text.alias("text"))
    two = one.select(
        "doc_id", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0).alias("lines"),
        F.length("text").alias("n_chars"), _without(F.col("text"), _SPACE).cast("bigint").alias("word_chars"),
        _without(F.col("text"), _SYMBOLS).alias("other"), _without(F.col("text"), _CAPITALS).alias("uncapital"))
    three = two.select(
        "doc_id", F.size("words").alias("n"), "words", F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), "word_chars",
        (F.col("n_chars") - F.col("other")).cast("bigint").alias("n_symbols"), (F.col("n_chars") - F.col("uncapital")).cast("bigint").alias("n_capitals"))
    return three.select("doc_id", F.col("n").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                        repeated_words(F.col("words"), F.col("n")).alias("n_repeat_words"), "n_lines", "n_capitals")


def _vote(good: str, bad: str) -> Column:
    """1 where ``good`` holds, 0 where ``bad`` does, else -1 (abstains)."""
    return F.when(F.expr(good), 1).when(F.expr(bad), 0).otherwise(-1)


def default_rules() -> dict[str, tuple[str, str]]:
    """Name -> (condition for a good vote, condition for a bad one); neither: the rule abstains."""
    return {
        "word_length": ("n_words > 0 AND word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
        "symbols": ("n_words > 0 AND 50 * n_symbols <= n_words", "10 * n_symbols >= n_words AND n_symbols > 0"),
        "lines": ("n_lines >= 3 AND n_dup_lines = 0", "n_lines >= 3 AND 2 * n_dup_lines >= n_lines"),
        "repeats": ("n_words >= 3 AND 10 * n_repeat_words <= n_words", "n_words >= 3 AND 10 * n_repeat_words >= 3 * n_words"),
        "capitals": ("word_chars > 0 AND 100 * n_capitals <= 15 * word_chars", "100 * n_capitals >= 40 * word_chars AND word_chars > 0"),
    }


@dataclass
class Accuracies:
    """``prior`` of good; per rule the probability of a good vote on good and of a bad vote on bad documents."""
    prior: float
    good: list[float]
    bad: list[float]
    rounds: int = field(default=0)


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, false_alarm: float = 0.002, max_rounds: int = 500, tol: float = 1e-7) -> Accuracies:
    """Expectation-maximisation over counted vote patterns (1 good, 0 bad, -1 abstains).

    Rules are written so that a bad vote is rare on good documents: its probability there is
    estimated but taken as ``false_alarm`` at most. Without that bound the hidden classes may
    settle on any group of documents whose votes go together, as rules do that see the
    same fault. How often a rule sees a bad document is free. A few pseudo-votes at the
    starting values keep estimates from 0 and 1.
    """
    model = Accuracies(0.8, [1 - false_alarm] * n_rules, [0.4] * n_rules)
    total = sum(c for _, c in patterns)
    for model.rounds in range(1, max_rounds + 1):
        if not total:
            break
        n_good, hit_good, hit_bad = 0.0, [0.0] * n_rules, [0.0] * n_rules
        votes_good, votes_bad = [0.0] * n_rules, [0.0] * n_rules
        for votes, c in patterns:
            p = posterior(votes, model)
            n_good += c * p
            for j, v in enumerate(votes):
                if v >= 0:
                    votes_good[j] += c * p
                    votes_bad[j] += c * (1 - p)
                    hit_good[j] += c * p * (v == 1)
                    hit_bad[j] += c * (1 - p) * (v == 0)
        prior = (n_good + 8) / (total + 10)
        good = [max((h + 10 * (1 - false_alarm)) / (n + 10), 1 - false_alarm) for h, n in zip(hit_good, votes_good)]
        bad = [max((h + 4) / (n + 10), 1 - g) for h, n, g in zip(hit_bad, votes_bad, good)]
        moved = abs(prior - model.prior) + sum(abs(a - b) for a, b in zip(good + bad, model.good + model.bad))
        model.prior, model.good, model.bad = prior, good, bad
        if moved < tol:
            break
    return model


def log_odds(model: Accuracies) -> tuple[float, list[tuple[float, float]]]:
    """Of good: the prior's log-odds, and each rule's for a good and a bad vote."""
    safe = lambda x: min(max(x, 1e-9), 1 - 1e-9)
    each = [(log(safe(g) / safe(1 - b)), log(safe(1 - g) / safe(b))) for g, b in zip(model.good, model.bad)]
    return log(safe(model.prior) / safe(1 - model.prior)), each


def posterior(votes: tuple[int, ...], model: Accuracies) -> float:
    from math import exp

    base, each = log_odds(model)
    s = base + sum(e[0] if v == 1 else e[1] for v, e in zip(votes, each) if v >= 0)
    return 1 / (1 + exp(-s)) if s > -700 else 0.0


def quality_by_rules(docs: DataFrame, rules: dict[str, tuple[str, str]] | None = None, at_least: float = 0.5) -> DataFrame:
    """Measures, base verdict, posterior and verdict of every row of ``docs`` (doc_id, text).

    base_failed: fewer than 50 words, or over half of them in repeated windows. kept: not
    base_failed, and a posterior of ``at_least``.
    """
    rules = default_rules() if rules is None else rules
    measured = written(text_measures(docs), "text-measures")
    voted = measured.select("*", *[_vote(*r).alias(f"vote_{k}") for k, r in rules.items()])
    names = [f"vote_{k}" for k in rules]
    counted = voted.groupBy(*names).count().collect()  # 3 ** rules rows at most
    model = estimate(sorted((tuple(r[n] for n in names), r["count"]) for r in counted), len(names))
    base, each = log_odds(model)
    odds = F.lit(base)
    for name, (up, down) in zip(names, each):
        odds = odds + F.when(F.col(name) == 1, up).when(F.col(name) == 0, down).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    probability = 1 / (1 + F.exp(-odds))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                        (~failed & (probability >= at_least)).alias("kept"), probability.alias("p_good"), *names)

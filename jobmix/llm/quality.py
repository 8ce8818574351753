"""Quality rules as weak supervision: rules vote or abstain, their accuracies are estimated by EM.

Every rule looks at one measure of a document and votes good, bad, or not at
all.  No rule decides alone: an expectation-maximisation over the vote
patterns of *all* documents estimates how often each rule votes which way on good
and on bad documents, and a document's verdict is the posterior probability
that it is good.  All work on texts is built-in column expressions; what
reaches the driver is the number of documents per vote pattern, at most
3 to the power of the number of rules, whatever the corpus size.

Results for odd input: a null or empty text has no words, fails the base
rules and is not kept; a null ``doc_id`` stays null; repeated rows count and
are judged each; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix.llm.common import materialize, table

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5

GOOD, BAD, ABSTAIN = 1, 0, 2


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, as a lambda's argument.

    The optimizer may move a column's definition into a lambda that refers to
    it, which would compute it again for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """The words of a text: what stands between ASCII white space."""
    core = F.btrim(text, F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN))


def repeated_words(words: Column) -> Column:
    """Words lying in a window of five words that is found twice or more.

    Windows are compared as 64-bit hashes.  Texts without a repeated window
    are done after one set of hashes; in the others, windows are sorted by
    hash, and the union of the repeated ones is measured from their places.
    """
    def covered(windows: Column) -> Column:
        size = F.size(windows)
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(z: Column) -> Column:
            places = F.transform(z, lambda x, k: F.when(
                ((k > 0) & (F.get(z, k - 1)["h"] == x["h"]))
                | ((k < size - 1) & (F.get(z, k + 1)["h"] == x["h"])), x["i"]))
            return F.sort_array(F.filter(places, lambda p: p.isNotNull()))

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(
                F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(by_hash, repeated), length)

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
        return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures the rules look at, from whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"),
                        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
                        repeated_words(words).cast("bigint").alias("n_repeat_words"))

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        let(words_of(text), counts).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("bigint").alias("n_capitals"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[0-9]+", ""))).cast("bigint").alias("n_digits"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[!?]+", ""))).cast("bigint").alias("n_shouts"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[.,;:]+", ""))).cast("bigint").alias("n_stops"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[!-/:-@\[-`{-~]+", ""))).cast("bigint").alias("n_marks"),
    ).select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
             "l.n_lines", "n_capitals", "n_digits", "n_shouts", "n_stops", "n_marks")


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains; NULL is "does not hold"."""

    name: str
    bad: Column | None = None
    good: Column | None = None

    def vote(self) -> Column:
        never = F.lit(False)
        return (F.when(never if self.bad is None else self.bad, F.lit(BAD))
                .when(never if self.good is None else self.good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN)))


def default_rules() -> list[Rule]:
    """Rules that vote both ways: bad beyond a bound, good where a measure is plainly that of prose, else not at all."""
    words = F.col("n_words")
    per_word = lambda c: F.try_divide(F.col(c), words)
    per_char = lambda c: F.try_divide(F.col(c), F.col("word_chars"))
    lines = F.try_divide(F.col("n_dup_lines"), F.col("n_lines"))
    return [
        Rule("number of words", bad=words < 10, good=words.between(50, 100_000)),
        Rule("word length", bad=(per_word("word_chars") < 2) | (per_word("word_chars") > 12),
             good=per_word("word_chars").between(3.5, 9)),
        Rule("symbols by word", bad=per_word("n_symbols") >= 0.1, good=per_word("n_symbols") < 0.01),
        Rule("symbols by character", bad=per_char("n_symbols") >= 0.03, good=per_char("n_symbols") < 0.003),
        Rule("letters", bad=per_char("n_marks") >= 0.12, good=per_char("n_marks") < 0.06),
        Rule("repeated lines", bad=lines >= 0.3, good=(F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 5)),
        Rule("repeated windows", bad=per_word("n_repeat_words") >= 0.2,
             good=(F.col("n_repeat_words") == 0) & (words >= 50)),
        Rule("capitals", bad=per_char("n_capitals") >= 0.3, good=per_char("n_capitals").between(0.005, 0.1)),
        Rule("shouting", bad=per_word("n_shouts") >= 0.3, good=per_word("n_shouts") < 0.03),
        Rule("digits", bad=per_char("n_digits") >= 0.3, good=per_char("n_digits") < 0.05),
        Rule("punctuation", bad=(per_word("n_stops") < 0.005) | (per_word("n_stops") > 0.4),
             good=per_word("n_stops").between(0.05, 0.4)),
    ]


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents and, by rule, the odds of each vote where it votes: on good to on bad documents.

    Abstaining says nothing: it tells of the measure, not of the document.
    """

    prior: float
    odds: tuple[dict[int, float], ...]

    def log_odds(self, votes: list[Column]) -> Column:
        """Log odds that a document with these votes is good."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, odds in zip(votes, self.odds):
            total = total + (F.when(v == GOOD, math.log(odds[GOOD])).when(v == BAD, math.log(odds[BAD]))
                             .otherwise(0.0))
        return total

    def belief(self, pattern: tuple[int, ...]) -> float:
        odds = math.log(self.prior / (1 - self.prior)) + sum(
            math.log(o[v]) for o, v in zip(self.odds, pattern) if v != ABSTAIN)
        return 1 / (1 + math.exp(-max(min(odds, 500.0), -500.0)))


def fit(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 500) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    The share of good documents and, by rule, how often its votes are good on
    good and on bad documents, are all estimated; nothing is held fixed or
    kept within bounds, so a rule that the others contradict loses its weight
    or speaks the other way.  Which of the two classes is the good one is
    settled by the start alone: a document's share of good votes.  Counts are
    smoothed by one document for each vote.
    """
    counted = sorted(patterns.items())
    total = sum(n for _, n in counted)
    if not total:
        return VoteModel(0.5, ({GOOD: 1.0, BAD: 1.0},) * n_rules)
    belief = {p: (p.count(GOOD) + 1) / (p.count(GOOD) + p.count(BAD) + 2) for p, _ in counted}
    for _ in range(rounds):
        rules = []
        for j in range(n_rules):
            on_good, on_bad = {GOOD: 1.0, BAD: 1.0}, {GOOD: 1.0, BAD: 1.0}
            for p, n in counted:
                if p[j] != ABSTAIN:
                    on_good[p[j]] += n * belief[p]
                    on_bad[p[j]] += n * (1 - belief[p])
            voted_good, voted_bad = sum(on_good.values()), sum(on_bad.values())
            rules.append({v: (on_good[v] / voted_good) / (on_bad[v] / voted_bad) for v in (GOOD, BAD)})
        good = sum(n * belief[p] for p, n in counted)
        model = VoteModel((good + 1) / (total + 2), tuple(rules))
        new = {p: model.belief(p) for p, _ in counted}
        change = max(abs(new[p] - belief[p]) for p in new)
        belief = new
        if change < 1e-9:
            break
    return model


def judge(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """Measures, base verdict, ``quality`` (posterior) and ``kept`` of every document.

    The measures are computed once and written to the shared folder (ten
    numbers a document); the votes are counted and judged from there.
    """
    rules = default_rules() if rules is None else rules
    found = materialize(measures(docs))
    voted = found.withColumns({f"_v{j}": r.vote() for j, r in enumerate(rules)})
    names = [f"_v{j}" for j in range(len(rules))]
    patterns = {tuple(r[n] for n in names): r["n"]
                for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit(patterns, len(rules))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-model.log_odds([F.col(n) for n in names])))
    return (voted.withColumn("base_failed", failed).withColumn("quality", quality)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*names))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "quality")

"""Quality rules by weak supervision. DataFrame only.

Every rule votes good or bad or abstains. Votes are counted per pattern over
all documents; expectation-maximisation on these counts (at most ``3**rules``
numbers, whatever the size of the corpus) estimates how often each rule gives
each vote on good and on bad documents.

Documents are bad in different ways, and the rules for one way agree with each
other and not with the rest: with a single class of bad documents the commonest
way would be learnt as "bad" and all others as good. So there is one kind of bad
document per rule. A first model of two classes says which patterns are bad at
all; then the frequency and the votes of every kind are estimated, where a rule
votes bad on no more than ``FALSE_ALARM`` of the good documents, as rules are
written to. The posterior that a document is good is applied as a column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import SPACE_CLASS, stage, whole, words_of
from newsloom.operators.scale import pin

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
GOOD, BAD, ABSTAIN = 1, 0, 2
FALSE_ALARM = 0.01
OWN = 0.9  # of a kind, where its rule votes bad


def _repeated_words(words: Column, size: int) -> Column:
    """Words inside windows found twice or more. Windows are compared by a
    64-bit hash; equal ones meet by sorting, in n log n for any text."""
    last = F.size(words) - size
    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) < size, F.lit(None)).otherwise(hashes)


def _covered(hashes: Column, size: int) -> Column:
    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def from_sorted(rows: Column) -> Column:
        twice = F.filter(rows, lambda r, k: (F.get(rows, k - 1)["h"] == r["h"]) | (F.get(rows, k + 1)["h"] == r["h"]))
        return F.sort_array(F.transform(twice, lambda r: r["i"]))

    starts = F.get(F.transform(F.array(tagged), from_sorted), F.lit(0))
    reach = F.get(F.transform(F.array(starts), lambda p: F.aggregate(
        F.transform(p, lambda s, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - s, F.lit(size)))),
        F.lit(0), lambda total, x: total + x)), F.lit(0))
    return F.coalesce(reach, F.lit(0))


def text_facts(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the counts the rules need; the whole text is read."""
    split = pin(docs.select("doc_id", whole().alias("text")), words=words_of(F.col("text")), lines=F.filter(
        F.split("text", "\n"), lambda line: F.regexp_replace(line, SPACE_CLASS + "+", "") != ""))
    hashed = pin(split, hashes=_repeated_words(F.col("words"), WINDOW))
    letters = F.array_join("words", "")
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return hashed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(letters).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("hashes"), WINDOW)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length(letters) - F.length(F.regexp_replace(letters, "[A-Z]", ""))).cast("long").alias("n_upper"),
        (F.length(letters) - F.length(F.regexp_replace(letters, "[!?]", ""))).cast("long").alias("n_marks"),
    )


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, 2 abstain. Each leaves a doubtful range open."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(F.col("n_words") == 0, BAD).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    symbols, repeat = F.col("n_symbols") / n, F.col("n_repeat_words") / n
    upper, marks = F.col("n_upper") / chars, F.col("n_marks") / n
    mean, distinct = chars / n, F.col("n_distinct") / F.pow(n, F.lit(0.75))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "length": vote(n, n >= 60, n < 20),
        "symbols": vote(symbols, symbols <= 0.02, symbols > 0.2),
        "repeats": vote(repeat, repeat <= 0.05, repeat > 0.3),
        "upper": vote(upper, upper <= 0.15, upper > 0.5),
        "marks": vote(marks, marks <= 0.02, marks > 0.3),
        "word_length": vote(mean, mean.between(3.2, 9.0), (mean < 2.5) | (mean > 14.0)),
        "variety": vote(distinct, distinct >= 1.0, distinct < 0.6),
        "lines": vote(dup, dup <= 0.05, dup > 0.4),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[list[list[float]]]]:
    """Prior of good, and for every rule the probability of each vote on bad
    and on good documents. ``patterns``: votes and how many documents have them.

    Two anchors keep the classes apart: the start is the share of good votes,
    and no rule may vote good more often on bad documents than on good ones."""
    count = sum(n for _, n in patterns)
    width = len(patterns[0][0]) if patterns else 0
    if not count:
        return 0.5, []
    belief = []
    for votes, _ in patterns:
        good, bad = votes.count(GOOD), votes.count(BAD)
        belief.append((good + 1) / (good + 4 * bad + 2))
    prior, table = 0.5, []
    for _ in range(rounds):
        mass = [sum(n * (1 - b) for (_, n), b in zip(patterns, belief)), sum(n * b for (_, n), b in zip(patterns, belief))]
        prior = min(0.999, max(0.001, mass[1] / count))
        table = []
        for rule in range(width):
            seen = [[1.0, 0.5, 0.5], [0.5, 1.0, 0.5]]  # by class: votes bad, good, abstain; one false vote in four to begin with
            for (votes, n), b in zip(patterns, belief):
                seen[0][votes[rule]] += n * (1 - b)
                seen[1][votes[rule]] += n * b
            share = [[x / sum(row) for x in row] for row in seen]
            if share[0][BAD] < share[1][BAD]:
                share[0][BAD] = share[1][BAD] = (share[0][BAD] + share[1][BAD]) / 2
            if share[1][GOOD] < share[0][GOOD]:
                share[0][GOOD] = share[1][GOOD] = (share[0][GOOD] + share[1][GOOD]) / 2
            table.append(share)
        belief = [1 / (1 + math.exp(-max(-700.0, min(700.0, _odds(prior, table, votes))))) for votes, _ in patterns]
    return prior, table


def _odds(prior: float, table: list[list[list[float]]], votes: tuple[int, ...]) -> float:
    return math.log(prior / (1 - prior)) + sum(math.log(t[1][v] / t[0][v]) for t, v in zip(table, votes))


def estimate_kinds(
    patterns: list[tuple[tuple[int, ...], int]], false_alarm: float = FALSE_ALARM, rounds: int = 60,
) -> tuple[list[float], list[list[list[float]]]]:
    """Frequency of good documents and of each rule's kind of bad ones, and per
    class and rule the probability of a bad and of a good vote, if it votes. To
    abstain is no evidence (1 for each class).

    A kind begins with the patterns in which its rule votes bad, shared with the
    other rules that do, earlier ones first, as two rules that always agree would
    else stay undecided; its rule votes bad on ``OWN`` of it or more."""
    count = sum(n for _, n in patterns)
    width = len(patterns[0][0]) if patterns else 0
    if not count:
        return [1.0], []
    prior, table = estimate(patterns, rounds)
    beliefs = []
    for votes, _ in patterns:
        weights = [1 / (rule + 1) if v == BAD else 0.0 for rule, v in enumerate(votes)]
        bad = 1 / (1 + math.exp(max(-700.0, min(700.0, _odds(prior, table, votes)))))
        share = max(bad, 0.5) if any(weights) else 0.0
        beliefs.append([1 - share, *[share * w / (sum(weights) or 1) for w in weights]])
    frequency, votes_of = [], []
    for _ in range(rounds):
        mass = [sum(n * b[c] for (_, n), b in zip(patterns, beliefs)) for c in range(width + 1)]
        frequency = [(m + 0.5) / (count + 0.5 * (width + 1)) for m in mass]
        votes_of = []
        for c in range(width + 1):
            rows = []
            for rule in range(width):
                seen = [0.5, 0.5]
                for (votes, n), b in zip(patterns, beliefs):
                    if votes[rule] != ABSTAIN:
                        seen[votes[rule]] += n * b[c]
                bad = seen[BAD] / sum(seen)
                bad = min(bad, false_alarm) if c == 0 else max(bad, OWN) if c == rule + 1 else bad
                share = [bad, 1 - bad, 1.0]
                rows.append(share)
            votes_of.append(rows)
        beliefs = []
        for votes, _ in patterns:
            logs = [math.log(f) + sum(math.log(rows[r][v]) for r, v in enumerate(votes)) for f, rows in zip(frequency, votes_of)]
            parts = [math.exp(x - max(logs)) for x in logs]
            beliefs.append([x / sum(parts) for x in parts])
    return frequency, votes_of


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the facts, ``base_failed``, ``posterior`` and ``kept`` per row
    of ``docs`` (``doc_id, text``; other columns are ignored).

    Null and empty texts have no words: all counts 0, failed, not kept.
    Repeated rows are judged each; an empty table gives an empty result."""
    names = list(rules())
    facts = stage(text_facts(docs).withColumns(rules()), "quality-facts")
    counted = facts.groupBy(*names).count().collect()  # at most 3 ** rules rows
    frequency, votes_of = estimate_kinds(sorted((tuple(r[n] for n in names), r["count"]) for r in counted))
    against = F.lit(0.0)  # odds that the document is bad, summed over the kinds
    for share, rows in zip(frequency[1:], votes_of[1:]):
        log_odds = F.lit(math.log(share / frequency[0]))
        for name, kind, good in zip(names, rows, votes_of[0]):
            log_odds = log_odds + F.get(F.array(*[F.lit(math.log(kind[v] / good[v])) for v in (BAD, GOOD, ABSTAIN)]), F.col(name))
        against = against + F.exp(log_odds)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return facts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (1 / (1 + against)).alias("posterior"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))

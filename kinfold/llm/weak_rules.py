"""Document quality by weak supervision: rules vote or abstain, and a latent-class model weighs them.

Each rule looks at one measure of the text and votes good (1), bad (0) or not at all (null). Expectation
maximisation over all documents estimates, for each rule, how often it votes good, bad or not at all on good and on
bad documents, and the share of good ones; the posterior probability of "good" replaces a filter that every rule must
pass. A rule that seldom errs weighs much, one that says good of everything weighs little; a vote never counts
against itself, and an abstention counts for nothing. Equal vote patterns are one row of a table that the number of rules bounds (3^rules), so each round of the
estimation is one aggregate over that table.

Everything is DataFrame expressions; texts are scanned once, into a written table of measures. Repeated word windows
are found inside the row: a document's windows are sorted, neighbours compared.

Defined cases: null text has no words; measures of a text without words are 0 and its rules abstain; a null doc_id
is kept; equal rows get equal answers; without documents the result is empty; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.session import staged

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 50
REPEAT_PERCENT = 50
ROUNDS = 20
LEAST_POSTERIOR = 0.5
START = {"good": (0.7, 0.02), "bad": (0.5, 0.3)}  # chances of a vote 1 and 0 by class, before the first round
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _vote(measure: Column, good: Column, bad: Column) -> Column:
    return F.when(measure.isNull(), None).when(bad, F.lit(0)).when(good, F.lit(1))


def rules() -> dict[str, Column]:
    """Votes on the measures of a document."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    chars = F.when(F.col("word_chars") > 0, F.col("word_chars"))
    lines = F.when(F.col("n_lines") > 0, F.col("n_lines"))
    letters = F.when(F.col("n_letters") > 0, F.col("n_letters"))
    length, symbols = chars / words, F.col("n_symbols") / words
    dup, repeat = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words
    lettered, capitals, closed = F.col("n_letters") / chars, F.col("n_capitals") / letters, F.col("n_closed") / lines
    return {
        "enough_words": _vote(words, F.col("n_words") >= 2 * LEAST_WORDS, F.col("n_words") < LEAST_WORDS),
        "word_length": _vote(length, length.between(3, 10), (length < 2) | (length > 15)),
        "few_symbols": _vote(symbols, symbols < 0.02, symbols > 0.1),
        "new_lines": _vote(dup, dup < 0.1, dup > 0.3),
        "new_windows": _vote(repeat, repeat < 0.2, repeat > 0.4),
        "letters": _vote(lettered, lettered > 0.85, lettered < 0.75),
        "small_letters": _vote(capitals, capitals < 0.2, capitals > 0.4),
        "closed_lines": _vote(closed, closed > 0.5, closed < 0.25),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each text, as a written table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("lines", lines)
    word = F.col("words")
    windows = F.when(F.size("words") > 2, F.transform(
        F.sequence(F.lit(1), F.size("words") - 2),
        lambda i: F.struct(F.concat_ws(" ", F.get(word, i - 1), F.get(word, i), F.get(word, i + 1)).alias("w"), i.alias("i"))))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r'[.!?:;"”»)][\x20\x09-\x0D]*$'))).alias("n_closed"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", ""))).alias("n_letters"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_capitals"),
        F.sort_array(F.coalesce(windows, F.expr("CAST(array() AS array<struct<w:string,i:int>>)"))).alias("sorted"))
    near = F.col("sorted")
    twice = F.filter(near, lambda x, k: (F.get(near, k - 1)["w"] == x["w"]) | F.coalesce(F.get(near, k + 1)["w"] == x["w"], F.lit(False)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("sorted")
    start = F.col("starts")
    # a repeated window covers three words, or as many as there are up to the next one
    covered = F.aggregate(F.transform(start, lambda x, k: F.least(F.coalesce(F.get(start, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b)
    return staged(rows.withColumn("n_repeat_words", covered.cast("long")).drop("starts"), "measures")


def posterior(names: list[str], share: float, weights: dict[str, tuple[float, float]]) -> Column:
    """Probability of "good" given the votes in the named columns; weights[name]: log odds of a vote 1 and of a vote 0."""
    odds = F.lit(math.log(share / (1 - share)))
    for name in names:
        odds = odds + F.when(F.col(name) == 1, weights[name][0]).when(F.col(name) == 0, weights[name][1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, tuple[float, float]]]:
    """Share of good documents and the log odds of each rule's votes, by expectation maximisation."""
    patterns = staged(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "patterns")

    def odds(good: tuple[float, float], bad: tuple[float, float]) -> tuple[float, float]:
        return max(0.0, math.log(good[0] / bad[0])), min(0.0, math.log(good[1] / bad[1]))

    share, weights = 0.8, {name: odds(START["good"], START["bad"]) for name in names}
    for _ in range(rounds):
        mass = {"good": F.col("n") * F.col("p"), "bad": F.col("n") * (1 - F.col("p"))}
        sums = [F.sum(m).alias(kind) for kind, m in mass.items()]
        sums += [F.sum(F.when(F.col(name) == vote, m)).alias(f"{name}_{vote}_{kind}") for name in names for vote in (1, 0) for kind, m in mass.items()]
        got = patterns.withColumn("p", posterior(names, share, weights)).agg(*sums).first()
        if got["good"] is None:
            break
        share = min(0.99, max(0.01, got["good"] / (got["good"] + got["bad"])))
        chance = {kind: {name: tuple(((got[f"{name}_{vote}_{kind}"] or 0.0) + START[kind][1 - vote]) / (got[kind] + 1) for vote in (1, 0)) for name in names} for kind in mass}
        weights = {name: odds(chance["good"][name], chance["bad"][name]) for name in names}
    return share, weights


def judged(docs: DataFrame, least: float = LEAST_POSTERIOR) -> DataFrame:
    """doc_id, measures, base_failed, kept and the posterior probability of good quality."""
    votes = rules()
    rows = measured(docs)
    voted = rows.select("*", *[vote.alias(f"vote_{name}") for name, vote in votes.items()])
    names = [f"vote_{name}" for name in votes]
    share, weights = estimate(voted, names)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    quality = F.round(posterior(names, share, weights), 6)
    return voted.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & (quality >= least)).alias("kept"), quality.alias("posterior"))

"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). The true quality is not known; expectation
maximisation finds the share of good documents and how often each rule is right about either kind, from
the numbers of documents with each pattern of votes. A document stays if its posterior probability of
being good is one half or more, and no base rule fails it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.session import checkpointed

_BLANKS = " \t\n\u000b\f\r"
WINDOW = 5
#: Bounds that keep good and bad from changing places. The thresholds are set so that at most one good
#: document in 500 is called bad by a rule; of bad ones a rule knows up to nine in ten, and it says
#: bad of a bad one at least so many times as often as of a good one.
LEAST_RIGHT_ON_GOOD, MOST_RIGHT_ON_BAD, LEAST_LIFT, MOST_GOOD = 0.998, 0.9, 1.5, 0.95
START_GOOD, START_RIGHT = 0.85, (0.998, 0.4)
ROUNDS = 25


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_stops``.

    Words are runs of other characters than space, tab and line ends. ``n_repeat_words`` counts the
    words in windows of five that are found twice or more in the text, the first ones included. A null
    text has no words; columns with these names are replaced; all rows stay in their place.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_stops"]
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    trimmed = F.btrim(t, F.lit(_BLANKS))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    words = F.when(trimmed != "", F.split(trimmed, "[\\x09-\\x0D\\x20]+", -1)).otherwise(F.array().cast("array<string>"))
    # Each step is used twice or more by the next one, so it is computed once and not folded into lambdas.
    step = docs.select(
        *kept,
        words.alias("__words"),
        lines.alias("__lines"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[.!?]")).cast("long").alias("n_stops"),
    )
    hashed = F.transform("__words", lambda w: F.xxhash64(w))
    step = step.select(
        *[F.col(f"`{c}`") for c in names],
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        "n_stops",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        hashed.alias("__h"),
    )
    runs = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
            lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)]),
        ),
    )
    step = step.withColumn("__runs", runs).drop("__h")
    # Hashes only tell whether a text can repeat a window at all; what repeats is found on the words.
    may = F.size(F.array_distinct("__runs")) < F.size("__runs")
    spelled = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
            lambda i: F.struct(F.array_join(F.slice("__words", i + 1, WINDOW), " ").alias("w"), i.alias("i")),
        )
    )
    step = step.withColumn("__sorted", F.when(may, spelled)).drop("__runs", "__words")
    alike = lambda x, k: (x["w"] == F.get("__sorted", k - 1)["w"]) | (x["w"] == F.get("__sorted", k + 1)["w"])
    places = F.array_sort(F.filter(F.transform("__sorted", lambda x, k: F.when(alike(x, k), x["i"])), lambda i: i.isNotNull()))
    step = step.withColumn("__at", places).drop("__sorted")
    gaps = F.transform("__at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", k + 1) - p, F.lit(WINDOW))))
    n_repeat = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g), F.lit(0).cast("long"))
    return step.withColumn("n_repeat_words", n_repeat).select(*[F.col(f"`{c}`") for c in names], *added)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules over the measures; each depends on counts alone, so equal texts get equal votes."""
    n, per_word = F.col("n_words"), lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    long_word = per_word("word_chars")
    return {
        "symbols": _vote(per_word("n_symbols") <= 0.05, per_word("n_symbols") > 0.2),
        "lines": _vote((F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0), (F.col("n_dup_lines") > 1) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines"))),
        "repeats": _vote((n >= WINDOW) & (F.col("n_repeat_words") * 20 <= n), F.col("n_repeat_words") * 5 > n),
        "length": _vote(n >= 30, n < 10),
        "word_length": _vote(long_word.between(3, 10), ~long_word.between(2, 15)),
        "capitals": _vote(F.col("n_upper") <= 0.25 * F.col("word_chars"), F.col("n_upper") > 0.5 * F.col("word_chars")),
        "stops": _vote((n >= 10) & per_word("n_stops").between(0.01, 0.3), per_word("n_stops") > 0.6),
    }


def fit(measured: DataFrame, rules: dict[str, Column] | None = None) -> tuple[float, dict[str, tuple[float, float]]]:
    """The share of good documents, and how often each rule is right about good and about bad ones when it votes.

    All documents are counted, by pattern of votes: at most 3 to the number of rules rows, summed
    before they are shuffled. Every round is one aggregation of these rows. A rule that never votes
    keeps its starting values, as all do on an empty table.
    """
    rules = votes() if rules is None else rules
    patterns = checkpointed(
        measured.select(*[v.alias(k) for k, v in rules.items()]).groupBy(*rules).agg(F.count("*").cast("double").alias("n")).coalesce(1).sortWithinPartitions(*rules)
    )
    good, right = START_GOOD, dict.fromkeys(rules, START_RIGHT)
    for _ in range(ROUNDS):
        p = posterior(good, right, {k: F.col(k) for k in rules})
        sums = [F.sum("n").alias("all"), F.sum(p * F.col("n")).alias("good")]
        for k in rules:
            for vote, name in ((1, "yes"), (-1, "no")):
                held = F.col(k) == vote
                sums += [F.sum(F.when(held, p * F.col("n")).otherwise(0.0)).alias(f"{k}_{name}_good"), F.sum(F.when(held, (1 - p) * F.col("n")).otherwise(0.0)).alias(f"{k}_{name}_bad")]
        row = patterns.agg(*sums).first()
        if not row["all"]:
            break
        new = min(max(row["good"] / row["all"], 1 - MOST_GOOD), MOST_GOOD)
        moved, good = abs(new - good), new
        for k in rules:
            # one vote more of each kind, so that no rule is held to be never wrong
            yes_good, no_good, yes_bad, no_bad = (row[f"{k}_{v}"] for v in ("yes_good", "no_good", "yes_bad", "no_bad"))
            if yes_good + no_good + yes_bad + no_bad == 0:
                continue
            on_good = max((yes_good + 1) / (yes_good + no_good + 2), LEAST_RIGHT_ON_GOOD)
            on_bad = min(max((no_bad + 1) / (no_bad + yes_bad + 2), (1 - on_good) * LEAST_LIFT), MOST_RIGHT_ON_BAD)
            moved = max(moved, abs(on_good - right[k][0]), abs(on_bad - right[k][1]))
            right[k] = (on_good, on_bad)
        if moved < 1e-5:
            break
    return good, right


def posterior(good: float, right: dict[str, tuple[float, float]], vote: dict[str, Column]) -> Column:
    """Probability that a document is good, given its votes; without any vote it is the prior."""
    odds = F.lit(math.log(good / (1 - good)))
    for k, (on_good, on_bad) in right.items():
        for_it, against = math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)
        odds = odds + F.when(vote[k] == 1, for_it).when(vote[k] == -1, against).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(measured: DataFrame, model: tuple[float, dict[str, tuple[float, float]]]) -> DataFrame:
    """Adds ``base_failed``, ``posterior`` and ``kept`` to measured documents."""
    good, right = model
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = votes()
    out = measured.withColumns({"base_failed": base_failed, "posterior": posterior(good, right, {k: known[k] for k in right})})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def accepted(judged: DataFrame) -> DataFrame:
    """The judged documents that are kept.

    The row number keeps the filter above the measures; pushed down, it would hold a copy of them for
    each place that names one.
    """
    return judged.withColumn("__row", F.monotonically_increasing_id()).where("kept and __row >= 0").drop("__row")

"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how often each is right.

Everything is a DataFrame expression. One pass counts what the rules look at and takes their votes (1 good, -1 bad, 0
abstains); documents with equal votes are counted together (at most 3 ** 9 patterns, however many documents there are).
Expectation-maximisation over these patterns estimates the share of good documents and, for each rule, how often it is
right on good and on bad documents when it votes. The posterior probability of a good document decides: a rule that is
seldom wrong outweighs several that can't tell junk from prose, and no rule has to pass alone.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Rounds of expectation-maximisation, decimals that its estimates keep (so that the order of sums doesn't show), and what each count starts with.
ROUNDS, DECIMALS, SMOOTH = 25, 9, 1.0
#: Estimates at the start: share of good documents, share of right votes on good and on bad documents.
START = (0.7, 0.998, 0.15)
#: Rules are written to be seldom wrong on good text: their accuracy there isn't estimated lower. Else junk that one rule alone sees would count as that rule's error.
LEAST_RIGHT = 0.998
#: Words that make up much of running text in some languages.
STOP_WORDS = tuple("the of and to in is that for it on with as be de la le les des et un une que en el los y der die das und ist nicht den von zu mit ein eine".split())
BLANKS, SYMBOLS, CAPITALS, DIGITS, ENDS = " \t\n\x0b\x0c\r", "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".?!…。？！\"'”»)"

#: The rules in terms of the counted columns: name, when it votes good, when it votes bad; it abstains otherwise.
RULES = {
    "word_size": ("word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 40 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "capitals": ("10 * n_capitals <= word_chars", "10 * n_capitals > 3 * word_chars"),
    "line_copies": ("n_lines > 1 AND 10 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    "repeats": ("10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "line_ends": ("2 * n_line_ends >= n_lines", "10 * n_line_ends < n_lines"),
    "stop_words": ("n_stop_words >= 2", "false"),
    "exclamations": ("100 * n_exclamations <= n_words", "10 * n_exclamations > n_words"),
    "digits": ("10 * n_digits <= word_chars", "10 * n_digits > 3 * word_chars"),
}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use refers to it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_of(text: Column, letters: str) -> Column:
    """How many of these characters are in text."""
    return F.char_length(text) - F.char_length(F.translate(text, letters, ""))


def words_of(text: Column) -> Column:
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that occur more than once among words.

    Sorted numbers of half a hash and a place show the windows that may occur again; their words decide.
    """
    size = F.size(words)
    windows = F.arrays_zip(words, F.slice(words, 2, size), F.slice(words, 3, size))
    marks = F.slice(F.transform(windows, lambda w, at: F.xxhash64(w).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(at)), 1, size - 2)

    def read(at: Column) -> Column:
        at = at.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return F.struct(F.concat_ws(" ", F.get(words, at), F.get(words, at + 1), F.get(words, at + 2)).alias("text"), at.alias("at"))

    def covered(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["text"] == F.get(s, k)["text"], F.lit(False))
        again = F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["at"])), lambda at: at.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda at: F.array(at, at + 1, at + 2)))))

    def told(s: Column) -> Column:
        pairs = F.filter(F.arrays_zip(s.alias("a"), F.slice(s, 2, size).alias("b")), lambda x: F.shiftright(x["a"].bitwiseXOR(x["b"]), 32) == 0)
        return bound(pairs, lambda p: F.when(F.size(p) > 0, bound(F.sort_array(F.transform(F.array_distinct(F.flatten(F.transform(p, lambda x: F.array(x["a"], x["b"])))), read)), covered)).otherwise(0))

    return F.when(size > 3, bound(F.sort_array(marks), told)).otherwise(0)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of every whole text: a narrow pass."""
    text = F.col("text")
    stop = F.array(*map(F.lit, STOP_WORDS))
    by_words = bound(
        words_of(text),
        lambda w: F.struct(
            F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"), F.size(F.array_intersect(w, stop)).alias("n_stop_words")
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    by_lines = bound(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), F.size(F.filter(x, lambda y: F.right(F.rtrim(y, F.lit(BLANKS)), F.lit(1)).isin(*ENDS))).alias("n_line_ends")
        ),
    )
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    read = slim.select("id", by_words.alias("w"), by_lines.alias("l"), F.regexp_replace("text", f"[^{SYMBOLS}A-Z0-9!]+", "").alias("marks"))
    counts = {name: count_of(F.col("marks"), letters).alias(name) for name, letters in (("n_symbols", SYMBOLS), ("n_capitals", CAPITALS), ("n_digits", DIGITS), ("n_exclamations", "!"))}
    return read.select("id", "w.*", "l.*", *counts.values())


def vote(rule: str) -> Column:
    good, bad = RULES[rule]
    return F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("int")


def posterior(votes: Column, share: Column, good: Column, bad: Column) -> Column:
    """Probability of a good document: votes, and for each rule how often it is right on good and on bad documents."""
    ratio = lambda v, g, b: F.when(v == 1, F.ln(g / (1 - b))).when(v == -1, F.ln((1 - g) / b)).otherwise(0.0)
    ratios = F.zip_with(votes, F.arrays_zip(good.alias("g"), bad.alias("b")), lambda v, x: ratio(v, x["g"], x["b"]))
    return 1 / (1 + F.exp(-F.aggregate(ratios, F.ln(share / (1 - share)), lambda a, x: a + x)))


def estimated(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: share of good documents, the rules' accuracies on good and on bad documents, from patterns of votes and their counts n.

    The patterns (at most 3 ** 9, however many documents there are) become one array; each round folds it into the next estimates.
    """
    k = len(RULES)
    start = F.struct(F.lit(START[0]).alias("share"), F.array_repeat(F.lit(START[1]), k).alias("good"), F.array_repeat(F.lit(START[2]), k).alias("bad"))
    of = lambda a, b: F.round((a + SMOOTH) / (a + b + 2 * SMOOTH), DECIMALS)
    total = lambda scored, value: F.aggregate(scored, F.lit(0.0), lambda a, x: a + value(x))

    def step(state: Column, patterns: Column) -> Column:
        scored = F.transform(patterns, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * posterior(x["votes"], state["share"], state["good"], state["bad"])).alias("g")))

        def of_rule(scored: Column, j: Column) -> Column:
            when = lambda vote, value: total(scored, lambda x: F.when(F.get(x["votes"], j) == vote, value(x)).otherwise(0.0))
            good, bad = lambda x: x["g"], lambda x: x["n"] - x["g"]
            return F.struct(F.greatest(F.lit(LEAST_RIGHT), of(when(1, good), when(-1, good))).alias("good"), of(when(-1, bad), when(1, bad)).alias("bad"))

        def told(scored: Column) -> Column:
            rules = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: of_rule(scored, j))
            share = of(total(scored, lambda x: x["g"]), total(scored, lambda x: x["n"] - x["g"]))
            return bound(rules, lambda r: F.struct(share.alias("share"), F.transform(r, lambda x: x["good"]).alias("good"), F.transform(r, lambda x: x["bad"]).alias("bad")))

        return bound(scored, told)

    read = patterns.groupBy().agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    return read.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: step(state, F.col("patterns"))).alias("state")).select("state.*")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality, votes.

    quality is the posterior probability of a good document to six decimals, votes the rules' votes in the order of RULES. kept is
    false where base_failed (under 50 words, or over half of them in repeated windows), else quality >= 0.5. Null and empty texts
    have no words: every rule abstains, base_failed is true. Texts count whole, whatever their length. Ids may be null or repeated
    (each row counts as a document); equal texts get equal verdicts; extra columns are ignored; an empty table gives no rows.
    The counted rows (some 100 bytes a document) are written to the shared folder once; the only shuffle is of patterns, and one
    row of estimates is broadcast.
    """
    rows = materialize(measured(docs, id_col, text_col).withColumn("votes", F.array(*map(vote, RULES))))
    state = materialize(estimated(rows.groupBy("votes").agg(F.count("*").alias("n")), rounds))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = F.round(posterior(F.col("votes"), F.col("share"), F.col("good"), F.col("bad")), 6)
    rows = rows.crossJoin(F.broadcast(state)).withColumn("quality", quality)
    return rows.select(
        F.col("id").alias(id_col), *(F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed.alias("base_failed"),
        (~base_failed & (F.col("quality") >= 0.5)).alias("kept"), "quality", "votes",
    )

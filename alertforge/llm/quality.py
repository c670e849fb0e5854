"""Quality rules: one threshold table compiled into one projection.

``RULES`` is data: each row names a metric and the interval it has to lie in.
``quality_columns`` turns the table into Spark expressions, so the verdict is
evaluated row by row in the scan stage: no shuffle, no user function, and a
task holds one text at a time.

Defined results: a null or blank text has no words, every count 0, fails the
base rule (fewer than 50 words) and is not kept. Rows are judged alone, so
repeated rows get equal verdicts. Extra columns pass through; metric columns
replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertforge.llm.common import WORD_SPACE, words_of

# FIXED VALUES: symbols counted by the base measure.
SYMBOLS = "#*$%&|<>"

# FIXED VALUES: frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "be", "are", "as", "by", "this",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "im", "nicht", "ein", "eine", "mit", "auf", "als", "dem", "sich",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "pour", "dans", "par", "sur", "qui", "au",
    "el", "los", "las", "y", "se", "del", "una", "con", "para", "por", "es", "no", "lo", "su",
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high`` (either bound may be open)."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 25.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("exclamations_per_word", "n_exclamations", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", None, 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)

BASE_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA_METRICS = ("n_exclamations", "n_stop_words", "n_lines", "n_ellipsis_lines")


def rule_passes(rule: Rule) -> Column:
    """One row of the table as a boolean; an empty denominator passes."""
    value = F.col(rule.numerator).cast("double")
    tests = []
    scale = F.lit(1.0) if rule.denominator is None else F.col(rule.denominator).cast("double")
    if rule.low is not None:
        tests.append(value >= F.lit(float(rule.low)) * scale)
    if rule.high is not None:
        tests.append(value <= F.lit(float(rule.high)) * scale)
    passed = tests[0]
    for t in tests[1:]:
        passed = passed & t
    return passed


def _let(value: Column, body) -> Column:
    """``body(value)`` with the intermediate array computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cover(positions: Column) -> Column:
    """Words under 3-word windows that start at the sorted ``positions``."""
    return F.aggregate(
        F.transform(positions, lambda x, k: F.least(F.lit(3).cast("long"),
                                                    F.coalesce(F.get(positions, k + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda acc, x: acc + x)


# a sort key packs 40 bits of the window's hash above its position
_POSITION_BITS = 24
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def _covered_words(words: str, hashes: str) -> Column:
    """Words inside a 3-word window that the text has at least twice.

    Windows are sorted as packed longs; neighbours with equal hash bits are
    repeats. If two neighbours agree in hash bits but not in words, or the
    text has over 2^24 windows, the text is redone with windows sorted by
    (hash, words, position), so the count is exact either way. Texts whose
    window hashes are all distinct skip both.
    """
    w, h = F.col(words), F.col(hashes)

    def bits(x: Column) -> Column:
        return F.shiftrightunsigned(x, _POSITION_BITS)

    def position(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_POSITION_MASK).cast("long"))

    def differ(x: Column, y: Column) -> Column:
        i, j = position(x).cast("int"), position(y).cast("int")
        return ((F.get(w, i) != F.get(w, j)) | (F.get(w, i + 1) != F.get(w, j + 1))
                | (F.get(w, i + 2) != F.get(w, j + 2)))

    def repeats(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(bits(x) == bits(F.get(s, k - 1)), F.lit(False))
                        | F.coalesce(bits(x) == bits(F.get(s, k + 1)), F.lit(False)))

    def clash(r: Column) -> Column:
        return F.exists(F.transform(r, lambda x, k: F.when(bits(x) == bits(F.get(r, k - 1)),
                                                          differ(x, F.get(r, k - 1))).otherwise(False)),
                        lambda x: x)

    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_POSITION_MASK).cast("long"))
                                      .bitwiseOR(i.cast("long"))))
    fast = _let(packed, lambda s: _let(repeats(s), lambda r: F.when(
        ~clash(r), _let(F.sort_array(F.transform(r, position)), _cover))))

    windows = F.sort_array(F.transform(h, lambda x, i: F.struct(
        x.alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"),
        i.cast("long").alias("i"))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]),
                          F.lit(False))

    slow = _let(windows, lambda s: _let(F.sort_array(F.transform(
        F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"])), _cover))
    return (F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0).cast("long"))
            .when(F.size(h) > F.lit(1 << _POSITION_BITS), slow)
            .otherwise(F.coalesce(fast, slow)))


def quality_columns(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the metrics, ``base_failed`` and ``kept``."""
    own = (*BASE_METRICS, *EXTRA_METRICS, "base_failed", "kept", "_t", "_w", "_h", "_l")
    df = docs.select(*[c for c in docs.columns if c not in own])
    df = df.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({
        "_w": words_of(F.col("_t")),
        "_l": F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != ""),
    })
    df = df.withColumn("_h", F.when(F.size("_w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2))))
        .otherwise(F.array().cast("array<bigint>")))

    def chars(s: str) -> Column:
        return (F.length("_t") - F.length(F.translate(F.col("_t"), s, ""))).cast("long")

    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(F.col("_t"), WORD_SPACE, "")).cast("long"),
        "n_symbols": chars(SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": _covered_words("_w", "_h").cast("long"),
        "n_exclamations": chars("!"),
        "n_stop_words": F.size(F.filter(F.col("_w"), lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_ellipsis_lines": F.size(F.filter(
            F.col("_l"), lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
    }).drop("_t", "_w", "_h", "_l")
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                       | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    passed = ~F.col("base_failed")
    for rule in rules:
        passed = passed & rule_passes(rule)
    return df.withColumn("kept", passed)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    judged = quality_columns(docs.withColumn("_keep", F.struct(*docs.columns)), text, rules)
    # the row id keeps the optimizer from copying the rules into a filter under the metrics
    judged = judged.select("_keep", "kept", F.monotonically_increasing_id().alias("_row"))
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select("_keep.*")

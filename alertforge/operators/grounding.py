"""J10 over whole conversations: values held against contexts of many turns.

``answers.is_grounded`` tests one value against one text. Here the context of a
value is all turns that share its key, in order, and no context is ever put
together in one row: an inverted index places every token of the normalised
turns at a global position, and a value meets only the places of its *anchor*.

* Three tokens and more: the inner tokens are whole tokens of the context, so
  the anchor is the one that is rarest there.
* Two tokens: the second opens a token of the context; the anchor is its head.
* One token: it may lie anywhere inside a token of the context; the anchor is
  its rarest run of up to three characters among the context's distinct tokens.

A place is checked token by token with joins on the position, across turns too:
the first token ends, the last one opens, the inner ones equal what stands there.
Values that are not contained are grounded if all their numbers occur.

Defined results: a null or empty value, and a context without a character, are
not grounded; a value of white space only is, if there is a context. Null turns
add nothing. Turns that share their order follow each other by a hash of the
text. Equal values of a key are looked up once. A null key has no context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertforge.operators.answers import normalize_for_grounding, numbers_in
from alertforge.operators.ordinals import offsets_by_range
from alertforge.session import store

HEAD = 3


def _tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_for_grounding(text), " "), lambda t: t != "")


def _runs(token: Column, lengths: Column) -> Column:
    """The distinct runs of characters of a token, of those ``lengths`` up to ``HEAD``."""
    return F.array_distinct(F.flatten(F.array(*[
        F.when(F.array_contains(lengths, F.lit(n)) & (F.length(token) >= n),
               F.transform(F.sequence(F.lit(1), F.length(token) - (n - 1)), lambda at: F.substring(token, at, F.lit(n))))
        .otherwise(F.array().cast("array<string>")) for n in range(1, HEAD + 1)])))


def _placed(turns: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """``(key, _token, _at)``: every token of the turns at its global position, neighbours one apart.

    Turns are sorted and get the place of their first token; their tokens count on from there.
    Tokens of equal turns at one place of the order alternate.
    """
    rows = (turns.groupBy(*key, *order, text).agg(F.count(F.lit(1)).alias("_copies"))
            .withColumns({"_tie": F.xxhash64(text), "_n": F.size(_tokens(F.col(text))) * F.col("_copies")}))
    started = offsets_by_range(rows, [*key, *order, "_tie"], "_n", "_start")
    copies = started.select(*key, text, "_start", "_copies", F.explode(F.sequence(F.lit(0), F.col("_copies").cast("int") - 1)).alias("_copy"))
    tokens = copies.select(*key, "_start", "_copies", "_copy", F.posexplode(_tokens(F.col(text))).alias("_i", "_token"))
    at = F.col("_start") + F.col("_i") * F.col("_copies") + F.col("_copy")
    return store(tokens.select(*key, "_token", at.alias("_at")), "grounding-tokens")


def _starts_by_inner_token(wanted: DataFrame, placed: DataFrame, vocabulary: DataFrame, key: list[str]) -> DataFrame:
    """Places where a value of three tokens and more may start, by its rarest inner token."""
    inner = (wanted.where("size(_tokens) > 2")
             .select(*key, "_vid", F.posexplode(F.slice("_tokens", F.lit(2), F.size("_tokens") - 2)).alias("_k", "_token")))
    known = inner.join(vocabulary, [*key, "_token"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    anchor = (known.groupBy(*key, "_vid").agg(F.min(F.struct("_n", "_k", "_token")).alias("_a"))
              .where("_a._n > 0").select(*key, "_vid", "_a._k", "_a._token"))
    return anchor.join(placed, [*key, "_token"]).select(*key, "_vid", (F.col("_at") - F.col("_k") - 1).alias("_start"))


def _starts_by_head(wanted: DataFrame, placed: DataFrame, vocabulary: DataFrame, key: list[str]) -> DataFrame:
    """Places where a value of two tokens may start: the token before one that its second token opens."""
    second = (wanted.where("size(_tokens) = 2").select(*key, "_vid", F.col("_tokens")[1].alias("_opens"))
              .withColumn("_head", F.substring("_opens", 1, HEAD)))
    heads = vocabulary.select(*key, "_token", F.explode(F.array_distinct(F.array(
        *[F.substring("_token", 1, n) for n in range(1, HEAD + 1)]))).alias("_head"))
    tokens = second.join(heads, [*key, "_head"]).where(F.startswith("_token", "_opens")).select(*key, "_vid", "_token")
    return tokens.join(placed, [*key, "_token"]).select(*key, "_vid", (F.col("_at") - 1).alias("_start"))


def _stands_at(starts: DataFrame, wanted: DataFrame, placed: DataFrame, key: list[str]) -> DataFrame:
    """``(_vid)`` of the values whose every token fits what stands from one of its starts on."""
    each = (starts.join(wanted.select("_vid", "_tokens"), "_vid")
            .select(*key, "_vid", "_start", F.size("_tokens").alias("_m"), F.posexplode("_tokens").alias("_k", "_want"))
            .withColumn("_at", F.col("_start") + F.col("_k")))
    fits = (F.when(F.col("_k") == 0, F.endswith("_token", "_want"))
            .when(F.col("_k") == F.col("_m") - 1, F.startswith("_token", "_want"))
            .otherwise(F.col("_token") == F.col("_want")))
    return (each.join(placed, [*key, "_at"]).where(fits).groupBy("_vid", "_start", "_m").agg(F.count(F.lit(1)).alias("_fit"))
            .where("_fit = _m").select("_vid"))


def _inside_a_token(wanted: DataFrame, vocabulary: DataFrame, key: list[str]) -> DataFrame:
    """``(_vid)`` of the values of one token that lie inside a token of their context."""
    single = wanted.where("size(_tokens) = 1").select(*key, "_vid", F.col("_tokens")[0].alias("_want"))
    longest = F.least(F.length("_want"), F.lit(HEAD))
    asked_lengths = single.groupBy(*key).agg(F.collect_set(longest).alias("_lengths"))  # at most HEAD of them
    runs = (vocabulary.join(asked_lengths, key)
            .select(*key, "_token", F.explode(_runs(F.col("_token"), F.col("_lengths"))).alias("_run")))
    asked = single.select(*key, "_vid", "_want", F.explode(_runs(F.col("_want"), F.array(longest))).alias("_run"))
    counted = asked.join(runs.groupBy(*key, "_run").agg(F.count(F.lit(1)).alias("_n")), [*key, "_run"], "left")
    anchor = (counted.groupBy(*key, "_vid", "_want").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_run")).alias("_a"))
              .where("_a._n > 0").select(*key, "_vid", "_want", "_a._run"))
    return anchor.join(runs, [*key, "_run"]).where(F.contains("_token", "_want")).select("_vid")


def _numbers_occur(wanted: DataFrame, turns: DataFrame, key: list[str], text: str, value: str) -> DataFrame:
    """``(_vid)`` of the values that have numbers, all of which occur in their context."""
    asked = wanted.select(*key, "_vid", F.explode(F.array_distinct(numbers_in(F.col(value)))).alias("_number"))
    seen = (turns.select(*key, F.explode(F.array_distinct(numbers_in(F.col(text)))).alias("_number")).distinct()
            .withColumn("_seen", F.lit(1)))
    return (asked.join(seen, [*key, "_number"], "left").groupBy("_vid")
            .agg(F.count(F.lit(1)).alias("_n"), F.count("_seen").alias("_found")).where("_n = _found").select("_vid"))


def grounded_in_turns(values: DataFrame, turns: DataFrame, key: list[str], order: list[str], value: str = "value",
                      text: str = "text") -> DataFrame:
    """``values`` with ``grounded``: whether the turns of the same key, joined in order by line ends, hold the value."""
    turns = turns.where(F.col(text).isNotNull())
    wanted = store(values.where(F.col(value) != "").select(*key, value).distinct()
                   .withColumns({"_tokens": _tokens(F.col(value)), "_vid": F.monotonically_increasing_id()}), "grounding-values")
    placed = _placed(turns, key, order, text)
    vocabulary = placed.groupBy(*key, "_token").agg(F.count(F.lit(1)).alias("_n"))
    starts = (_starts_by_inner_token(wanted, placed, vocabulary, key)
              .unionByName(_starts_by_head(wanted, placed, vocabulary, key)))
    # with the line end between turns, two empty turns are a context of one character
    some = (turns.groupBy(*key).agg((F.sum(F.length(text)) + F.count(F.lit(1)) - 1).alias("_chars")).where("_chars > 0"))
    blank = wanted.where("size(_tokens) = 0").join(some, key, "left_semi").select("_vid")
    hits = (_stands_at(starts, wanted, placed, key).unionByName(_inside_a_token(wanted, vocabulary, key))
            .unionByName(_numbers_occur(wanted, turns, key, text, value)).unionByName(blank).distinct())
    known = wanted.join(hits, "_vid", "left_semi").select(*key, value, F.lit(True).alias("_hit"))
    return (values.join(known, [*key, value], "left").withColumn("grounded", F.coalesce("_hit", F.lit(False)))
            .select(*values.columns, "grounded"))

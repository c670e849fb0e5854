"""Grounding by anchors against the rule applied to the whole context."""
import random
import re

import pytest

from pyspark.sql import functions as F

from alertforge.operators import grounding as GROUND
from alertforge.operators.grounding import grounded_in_turns


def plain(value, turns):
    """The rule on one text: contained once normalised, else all numbers occur."""
    context = "\n".join(t for t in turns if t is not None)
    if not value or not context:
        return False

    def norm(x):
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower().replace(",", "")).strip(" \t\n\x0b\f\r")

    numbers = [re.findall(r"[0-9]+", x.replace(",", "")) for x in (value, context)]
    return norm(value) in norm(context) or bool(numbers[0]) and set(numbers[0]) <= set(numbers[1])


def check(spark, values, turns):
    v = spark.createDataFrame([(i, *x) for i, x in enumerate(values)], "row int, k string, value string")
    t = spark.createDataFrame(turns, "k string, turn int, text string")
    got = {r.row: r.grounded for r in grounded_in_turns(v, t, ["k"], ["turn"]).collect()}
    for i, (k, value) in enumerate(values):
        context = [x for key, _, x in sorted(turns, key=lambda r: r[1]) if key == k and k is not None]
        assert got[i] == plain(value, context), (k, value)
    assert len(got) == len(values)
    return sum(got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_excerpts_match_the_rule_on_whole_contexts(spark, seed):
    rnd = random.Random(seed)
    words = ["ab", "abc", "bca", "a", "Router", "1,348", "42", "é", "down,", "x" * 40]
    turns = [(k, n, " ".join(rnd.choices(words, k=rnd.randint(0, 12))) + rnd.choice(["", " \t", "\n"]))
             for k in "pq" for n in range(8)]
    values = []
    for k in "pq":
        whole = "\n".join(t for key, _, t in turns if key == k)
        for _ in range(120):
            a = rnd.randrange(len(whole))
            values.append((k, whole[a:a + rnd.randint(1, 30)]))
            values.append((k, " ".join(rnd.choices(words, k=rnd.randint(1, 4)))))
            values.append((k, "".join(rnd.choices("abcé1 ", k=rnd.randint(1, 5)))))
    assert 200 < check(spark, values, turns) < len(values)


def test_awkward_rows(spark):
    turns = [("p", 0, "The Router  DOWN"), ("p", 1, None), ("p", 2, ""), ("p", 3, " now, 1348 alerts"), ("p", 3, " now, 1348 alerts"),
             ("empty", 0, ""), ("two", 0, ""), ("two", 1, ""), (None, 0, "router down"), ("long", 0, "z" * 100_000 + "q end")]
    values = [("p", None), ("p", ""), ("p", " "), ("p", "outer down\tno"), ("p", "router down"), ("p", "router down"),
              ("p", "DOWN now 1,348 ale"), ("p", "1348 or so"), ("p", "1 or so"), ("p", ","), ("empty", " "), ("two", " "),
              ("none", "x"), (None, "router"), ("long", "zq e"), ("long", "z" * 5000), ("long", "zzqz")]
    assert check(spark, values, turns) == 10


def test_no_rows(spark):
    v = spark.createDataFrame([], "k string, value string, turn int")
    t = spark.createDataFrame([], "k string, turn int, text string")
    assert grounded_in_turns(v, t, ["k"], ["turn"]).count() == 0
    v = spark.createDataFrame([("p", "x", 1)], v.schema)
    assert [tuple(r) for r in grounded_in_turns(v, t, ["k"], ["turn"]).collect()] == [("p", "x", 1, False)]


def test_places_come_from_sorted_turns_not_tokens(spark, monkeypatch):
    sorted_rows = []
    keep = GROUND.offsets_by_range
    monkeypatch.setattr(GROUND, "offsets_by_range", lambda df, *a: sorted_rows.append(df.count()) or keep(df, *a))
    rows = [("k", t, f"a{t} b c{t}" if t % 3 else "  ") for t in range(40)] + [("l", 0, "x y"), ("l", 0, "x y"), ("l", 1, "z")]
    turns = spark.createDataFrame(rows, "k string, turn long, text string").repartition(4)
    placed = GROUND._placed(turns, ["k"], ["turn"], "text")
    assert sorted_rows == [42]  # turns, equal ones once
    at = sorted((r._at, r.k, r._token) for r in placed.collect())
    assert [x[0] for x in at] == list(range(at[0][0], at[0][0] + len(at)))
    assert [x[2] for x in at if x[1] == "k"] == [w for _, t, s in rows[:40] for w in s.split()]
    assert [x[2] for x in at if x[1] == "l"] == ["x", "x", "y", "y", "z"]
    runs = spark.range(1).select(GROUND._runs(F.lit("abcd"), F.array(F.lit(3))).alias("r")).first().r
    assert sorted(runs) == ["abc", "bcd"]

"""Quality rules, sharding and mixing against brute force, with the awkward inputs."""
import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertforge.llm import mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")

TEXTS = [
    None, "", " \t\n ", "one", "a b a b a b", "x y z x y z",
    "the of " * 40, " ".join(f"the of w{i}" for i in range(40)),
    "line one here\nline one here\n\nother line\n" * 3, "### *** $$$ " * 30, "GO!! " * 60,
    "été の 😀 naïve " * 20 + "\x0b\x0c\r end", "w " * 5000, " ".join(f"v{i}" for i in range(30000)) + " the of the of",
]


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    n = len(words)
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    rows = quality.quality_columns(docs).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute_quality(TEXTS[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert 7 in kept and not kept & {0, 1, 2, 9, 10}


def test_hash_clash_takes_the_exact_path(spark):
    """Windows whose packed hash bits agree but whose words differ are not repeats."""
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], [5 << 24, (5 << 24) + 1, 9 << 24]),
                                (["a", "b", "c", "a", "b", "c"], [5 << 24, 7 << 24, 9 << 24, 5 << 24])],
                               "w array<string>, h array<bigint>")
    got = [r[0] for r in df.select(quality._covered_words("w", "h")).collect()]
    # all three hashes of the first row differ as longs, two agree in their packed bits
    assert got[1] == 6 and got[0] == 0


def test_keep_good_returns_the_input_columns(spark):
    docs = spark.createDataFrame([(i, t, True, 1) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, kept boolean, n_lines int")
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {7}
    assert quality.keep_good(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- sharding

def test_shards_are_exact_and_gapless(spark):
    rows = [(i, i % 7) for i in range(1003)] + [(5, 5)] * 400 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, size long")
    got = sharding.hypergeometric_shuffle(df, 40, seed=3).collect()
    assert sorted((r.doc_id or -1, r.size or -1) for r in got) == sorted((a or -1, b or -1) for a, b in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 40 and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.hypergeometric_shuffle(df, 40, seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_few_and_no_rows(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"))
    assert sorted(r.slot for r in sharding.hypergeometric_shuffle(df, 40).collect()) == [0, 0, 0]
    assert sharding.hypergeometric_shuffle(df.limit(0), 4).count() == 0


def test_hypergeometric_distribution(spark):
    """Draws follow the exact law: 20,000 draws of (30 of 12 marked, 9 drawn) against the pmf."""
    from math import comb
    n = 20_000
    u = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"))
    lit = lambda x: F.lit(x).cast("long")
    got = collections.Counter(r[0] for r in u.select(
        sharding.hypergeometric(lit(30), lit(12), lit(9), F.col("u"))).collect())
    for x in range(10):
        p = comb(12, x) * comb(18, 9 - x) / comb(30, 9)
        assert abs(got[x] / n - p) < 2e-4
    big = u.select(sharding.hypergeometric(lit(10**10), lit(4 * 10**9), lit(10**6), F.col("u")).alias("x"))
    mean, sd = big.select(F.avg("x"), F.stddev("x")).first()
    assert abs(mean - 4e5) < 5 and abs(sd - (1e6 * 0.24) ** 0.5) < 5


def test_uniform_over_seeds(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"))
    first = [r.shard for s in range(12) for r in sharding.hypergeometric_shuffle(df, 6, seed=s).where("doc_id = 7").collect()]
    assert len(set(first)) >= 3


# ---------------------------------------------------------------- mixing

def water_fill(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rng = np.random.default_rng(1)
    sources = ["b", "a", "é", "Z", None, "empty"]
    rows = [(i, sources[min(int(rng.integers(0, 8)), 4)], "w " * int(rng.integers(0, 30)), "x") for i in range(600)]
    rows += [(1000, "empty", None, "x"), (1001, "empty", " ", "x"), (7, "a", "w w w", "x"), (7, "a", "w w w", "x"),
             (None, None, "w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target string")
    sizes = collections.Counter()
    for _, s, t, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = water_fill(sizes)
    plan = mixing.mix_plan(docs, seed=2).collect()
    taken = collections.Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.copies in (0, 1, 2) and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.copies * r.size * r.n_rows
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    assert sum(r.n_rows for r in plan) == len(rows)
    out = mixing.mix_documents(docs, seed=2)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies * r.n_rows for r in plan)
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_demand_inverse(spark):
    """The inverse of the schedule's integral, by numeric integration."""
    for knots in (*mixing.SCHEDULES, ((0.0, 0.0), (0.25, 2.0), (1.0, 0.5))):
        t = np.linspace(0, 1, 100_001)
        f = np.interp(t, [k[0] for k in knots], [k[1] for k in knots])
        area = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2)])
        area /= area[-1]
        shares = [0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0]
        df = spark.createDataFrame([(s,) for s in shares], "s double")
        got = [r[0] for r in df.select(mixing.demand_inverse(F.col("s"), knots)).collect()]
        assert np.allclose(got, np.interp(shares, area, t), atol=1e-4)

"""Line dedup, importance resampling and source divergence against brute force and SQL, with awkward rows."""
import collections
import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertforge.llm import divergence, importance, linededup

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

from compare import compare, duck  # noqa: E402

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_lines string, keep string, rank string, _row string"


def awkward_documents():
    """Nulls, empties, repeats, ties, one very long text, a line of a third of all rows, clashing columns."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "😀", "a1b2", "x-y"]
    rows = []
    for i in range(150):
        lines = [" ".join(rng.choice(words, int(rng.integers(0, 25)))) for _ in range(int(rng.integers(0, 6)))]
        lines += ["  Common Line\t"] * (i % 3 == 0) + ["common line"] * (i % 6 == 0) + ["\x0bRARE one", ""] * (i % 40 == 0)
        rows.append((i, "\n".join(lines), ["en", "de", None, ""][i % 4], ["s0", "s0", "s1", None, "s2"][i % 5]))
    rows += [(None, "common line", "en", "s0")] * 3 + [(None, None, None, None), (5, "", "en", "only"), (6, "\n\n", "de", "s1")]
    rows += [(900, "same text here\nCOMMON LINE", "en", "s0")] * 40
    rows.append((901, "\n".join(["common line", "long " * 30] * 3000), "de", "s9"))
    return [(*r, "clash", "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def awkward_dir(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(awkward_documents(), SCHEMA).repartition(5).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2 W3 common", "x"), (2, None, "x"), (3, "", "x"), (3, "été w5 w5", "x")],
                          "item_id long, text string, gain string").write.parquet(f"{top}/benchmark.parquet")
    rng = np.random.default_rng(11)
    vectors = [(int(i), rng.normal(size=8).tolist()) for i in rng.permutation(260)]
    vectors += [(50, rng.normal(size=8).tolist()) for _ in range(3)] + [(100, vectors[0][1])] * 4  # ids asked several times
    vectors += [(7, vectors[3][1])] * 30 + [(None, [1.0] * 8), (150, None), (200, [None] * 8), (250, [float("nan")] * 8), (0, [1.0, 2.0])]
    spark.createDataFrame([(*r, "clash") for r in vectors], "vec_id long, embedding array<double>, qkey string") \
        .repartition(3).write.parquet(f"{top}/embeddings.parquet")
    return top


def awkward_duck(top):
    con = duck(top)
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{top}/{t}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["op2_pivot_topk", "op9_quality_rules", "op11_line_dedup", "op12_importance_resampling", "op13_source_divergence"])
def test_registered_query_on_awkward_rows(spark, awkward_dir, name):
    ok, msg = compare(spark, name, awkward_dir, awkward_duck(awkward_dir))
    assert ok, msg


# ---------------------------------------------------------------- lines

def key_of(line):
    return line.strip(BLANK).translate(LOWER)


def brute_lines(rows, min_docs, min_chars, keep):
    """Per row (n_lines, the text that stays)."""
    texts = [(d, t or "") for d, t, *_ in rows]
    docs = collections.defaultdict(set)
    for i, (_, t) in enumerate(texts):
        for line in t.split("\n"):
            if len(key_of(line)) >= min_chars and key_of(line):
                docs[key_of(line)].add(i)
    gone = {k for k, v in docs.items() if len(v) >= min_docs}
    return [(len(t.split("\n")), "\n".join(x for x in t.split("\n") if key_of(x) not in gone)) for _, t in texts], gone


@pytest.mark.parametrize("partitions", [1, 8, 40])
@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 12), (1, 1)])
def test_frequent_lines_go(spark, partitions, min_docs, min_chars):
    rows = awkward_documents()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame(rows, SCHEMA).withColumn("_i", F.monotonically_increasing_id())
        out = linededup.line_keep_bitmaps(docs, min_docs, min_chars)
        assert set(out.columns) == set(docs.columns) | {"n_lines", "n_dropped", "keep"}
        got = out.withColumn("kept", linededup.kept_text(F.coalesce("text", F.lit("")), F.col("keep"))).orderBy("_i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want, _ = brute_lines(rows, min_docs, min_chars, "none")
    assert [(r.n_lines, r.kept) for r in got] == want
    assert all(r.n_dropped == len((r.text or "").split("\n")) - linededup.decode_keep(r.keep, r.n_lines).sum()
               for r in got)


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_first_occurrence_stays(spark, partitions):
    """keep='first' with min_docs=1: of each key one line stays, in the first document at its first position."""
    rows = [r for r in awkward_documents()]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = linededup.line_keep_bitmaps(spark.createDataFrame(rows, SCHEMA), 1, 1, keep="first").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    seen = collections.defaultdict(set)
    first_doc = {}
    for r in got:
        lines = (r.text or "").split("\n")
        for pos, (line, stays) in enumerate(zip(lines, linededup.decode_keep(r.keep, r.n_lines))):
            k = key_of(line)
            if not k:
                assert stays
                continue
            doc = (r.doc_id is not None, r.doc_id or 0)
            first_doc[k] = min(first_doc.get(k, doc), doc)
            if stays:
                seen[k].add((doc, r.text, pos, pos == min(i for i, x in enumerate(lines) if key_of(x) == k)))
    assert set(seen) == set(first_doc)
    for k, places in seen.items():
        assert len(places) == 1, k  # copies of one row share a bitmap
        doc, _, _, is_first = next(iter(places))
        assert doc == first_doc[k] and is_first


def test_line_bitmaps_round_trip_and_empty_table(spark):
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 1000, 40_000):
        stays = rng.random(n) < 0.7
        if stays.all():
            stays[n // 2] = False
        assert (linededup.decode_keep(linededup.encode_keep(np.flatnonzero(~stays)), n) == stays).all()
    assert len(linededup.encode_keep(np.arange(100_000))) < 200
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.line_keep_bitmaps(empty, 2).count() == 0
    with pytest.raises(ValueError):
        linededup.line_keep_bitmaps(empty, keep="last")


# ---------------------------------------------------------------- importance

def brute_resample(rows, target, n_gram, n_buckets, percent, min_words):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        ws = word.findall((text or "").translate(LOWER))
        return ws, [zlib.crc32(" ".join(ws[i:i + k]).encode()) % n_buckets for k in range(1, n_gram + 1)
                    for i in range(len(ws) - k + 1)]

    s = collections.Counter(b for r in rows for b in features(r[1])[1])
    t = collections.Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()) + n_buckets, sum(t.values()) + n_buckets
    out = []
    for doc_id, text in rows:
        ws, f = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(ws), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    pool = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, pool[:len(pool) * percent // 100]


@pytest.mark.parametrize("n_gram,n_buckets", [(1, 10_000), (2, 512), (3, 10_000)])
def test_resampling_matches_brute_force(spark, n_gram, n_buckets):
    rows = [(r[0], r[1]) for r in awkward_documents()]
    target = ["w1 w2 w3 common line", None, "", "naïve été w1 w2"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=30, min_words=5,
                              n_gram=n_gram, n_buckets=n_buckets).collect()
    everything, drawn = brute_resample(rows, target, n_gram, n_buckets, 30, 5)

    def plain(x):
        return tuple("" if v is None else str(v) for v in x)

    assert sorted(plain(r[:5]) for r in got) == sorted(map(plain, everything))
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [plain(r[:5]) for r in ranked] == [plain(d) for d in drawn]


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.limit(0).select("text")
    got = importance.resample(docs, none, percent=10).collect()
    assert len(got) == 2 and all(r.rank is None for r in got)
    assert importance.resample(docs.limit(0), docs.select("text")).count() == 0


# ---------------------------------------------------------------- divergence

def brute_divergence(rows, min_docs, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, df, seen = collections.defaultdict(collections.Counter), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", word.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        df.update({(lang, t) for t in terms})
        seen.add((lang, source))
    out = []
    for lang in {g[0] for g in seen}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        groups = {s: counts[lang, s] for x, s in seen if x == lang}
        whole = sum(groups.values(), collections.Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ordered, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs,block_terms,tile", [(2, 7, 2), (5, 32_768, 8), (10_000, 10, 3)])
def test_divergence_matches_brute_force(spark, min_docs, block_terms, tile):
    rows = [r[1:4] for r in awkward_documents()]
    docs = spark.createDataFrame(awkward_documents(), SCHEMA).withColumn("term", F.lit("clash")).withColumn("value", F.lit(1))
    got = divergence.divergence(docs, min_docs, 4, block_terms, tile)
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, min_docs, 4)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergence(docs).count() == 0


def test_shares_are_exact():
    rng = np.random.default_rng(5)
    for total in (0, 7, 10 ** 6, 8 * 10 ** 15):
        n_terms = int(rng.integers(1, 10 ** 6))
        c = rng.integers(0, total + 1, 200)
        want = [1 + 10 ** 9 * (int(x) + 5) // (total + 5 * n_terms) for x in c]
        assert divergence._shares(c, total, n_terms).tolist() == want
    ids = [np.sort(rng.choice(500, k, replace=False)) for k in (0, 1, 40, 300, 500)]
    for a in ids:
        for b in ids:
            x, y = rng.integers(1, 99, len(a)), rng.integers(1, 99, len(b))
            da, db = dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist()))
            want = sum(abs(da.get(t, 3) - db.get(t, 4)) for t in set(da) | set(db))
            assert divergence.merge_pair(a, x, 3, b, y, 4) == (want, len(set(da) | set(db)))


# ---------------------------------------------------------------- bounded memory inside a task

def text_batches(n=4):
    rows = awkward_documents()
    names = ["text", "lang", "source"]
    for part in np.array_split(np.arange(len(rows)), n):
        columns = [pa.array([rows[i][1 + k] or "" for i in part], pa.string()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def test_task_hands_on_what_it_holds(monkeypatch):
    """Small limits change how often a task hands on its sums, not the sums."""
    def sums():
        out = collections.Counter()
        pieces = 0
        for b in divergence._term_parts(text_batches(12)):
            pieces += 1
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "df"] += r["df"]
        return out, pieces

    want, one = sums()
    monkeypatch.setattr(divergence, "HELD_ROWS", 50)
    got, many = sums()
    assert got == want and many > one


def test_slices_do_not_change_features():
    from alertforge.llm.arrowwords import byte_slices
    batch = next(text_batches(1))
    row, bucket, words = importance.feature_buckets(batch.column("text"), 2, 1000)
    parts = [importance.feature_buckets(p.column("text"), 2, 1000) for p in byte_slices(batch, "text", 500)]
    assert len(parts) > 10
    assert np.concatenate([p[2] for p in parts]).tolist() == words.tolist()
    assert sorted(np.concatenate([p[1] for p in parts]).tolist()) == sorted(bucket.tolist())


def test_repeated_rows_are_counted_when_the_memory_is_small(monkeypatch):
    rows = [(r[0], (r[1] or "").encode()) for r in awkward_documents()]

    def counts():
        batches = [pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in part], pa.int64()), pa.array([hash(rows[i]) for i in part], pa.int64()),
             pa.array([0] * len(part), pa.int64()), pa.array([rows[i][1] for i in part], pa.binary())],
            names=["_ld_doc", "_ld_d1", "_ld_d2", "_ld_text"]) for part in np.array_split(np.arange(len(rows)), 60)]
        out, n_rows = collections.Counter(), 0
        for b in linededup._entries(1)(iter(batches)):
            n_rows += b.num_rows
            for h1, h2, n in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "n"))):
                out[h1, h2] += n
        return out, n_rows

    want, few = counts()
    monkeypatch.setattr(linededup, "MAX_SEEN", 3)
    monkeypatch.setattr(linededup, "_FLUSH_LINES", 10)
    got, many = counts()
    assert got == want and many > few
    assert max(got.values()) == sum("common line" in {key_of(x) for x in t.decode().split("\n")} for _, t in rows)

"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A document's shingles of five words, weighted by how often they occur, define
a probability distribution; two documents are linked when their probability
Jaccard similarity is 0.8 or more, and a class is a connected component.

1. *Sketch* (one pass over the scan). Each shingle is a Poisson process whose
   rate is its weight: arrivals come at sums of exponential gaps drawn from
   the shingle's own hash and fall on a hashed slot. A slot keeps the shingle
   of its first arrival, so two sketches agree in a slot with probability
   J_P. Arrivals are drawn up to a horizon only, at which all slots are
   expected to be filled; the few documents with an empty slot are redone with
   twice the horizon, which repeats the same arrivals and adds later ones.
2. *Bands*. Equal texts are collapsed first (by MD5); each distinct text
   gives 24 band keys of 4 slots (a pair at 0.8 shares one with probability
   1 - 3e-6).
3. *Estimate*. One byte per slot stays with each text. The share of slots that
   agree estimates J_P; a pair with fewer than 57 of 96 is dropped (a pair at
   0.8 is lost so with probability 4e-7, below what the bands lose).
4. *Verification*. Members of a band's bucket are compared with the bucket's
   leader first, by exact J_P over their shingles, and merged into components.
   In buckets whose members still lie in several components, blocks of members
   meet by their sketches alone. Their near pairs are verified where they are at
   most two a row; else each component's best estimated pair with another is.
   Rounds go on until one merges nothing; the next one keeps the texts whose near
   partners were too many, looks only at buckets in which a component changed and
   verifies no pair again. So the pairs verified grow
   with the members, not with their square.
5. *Rest*. Texts that still have a near partner in another component, by the
   estimate, are compared with all of them: they are packed into bounded
   blocks, blocks meet inside the bucket, a task checks a block pair and
   returns only the components it links. A pair that shares several buckets is
   decided in its first; pairs whose common shingles weigh too little for the
   bound in either text are dropped before the exact J_P.

Defined results: a null text is empty; a text without words is in a class with
equal texts only; a text of one to four words is one shingle. Rows that share
a doc_id are one document (their classes merge); a null doc_id stands for
itself by its text and stays null. Repeated rows share a class. An empty table gives no rows.
Extra columns pass through untouched (``keep_one`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertforge.llm.common import WORD_SPACE, freeze, freeze_counted, text_of
from alertforge.llm.components import connected_components
from alertforge.llm.tokens import slices

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
BLOCK_MEMBERS, BLOCK_BYTES = 256, 2 << 20
BLOCK_PAIRS_PER_BATCH = 8
# a pair at 0.8 agrees in fewer of its 96 slots with probability 4e-7
MIN_AGREEING = 57
BUCKET_BLOCK = 2048
# two blocks that meet name all their near pairs up to so many a row
PAIRS_PER_ROW = 2
_COMPARED = 1 << 17
_COLUMNS = 4096

_TO_BLANK = {ord(c): " " for c in WORD_SPACE}
_PRIME = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the distinct shingles, sorted by both."""
    words: list[str] = []
    ends = []
    for t in texts:
        words.extend([w for w in t.translate(_TO_BLANK).split(" ") if w])
        ends.append(len(words))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    del words
    ends = np.array(ends, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    doc_of = np.repeat(np.arange(len(texts)), sizes)
    # polynomial over the next words of the document; short documents are one shingle of all their words
    width = np.minimum(sizes, SHINGLE_WORDS)[doc_of]
    left = ends[doc_of] - np.arange(len(hashes))
    value = np.full(len(hashes), _PRIME, dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        follow = np.zeros(len(hashes), np.uint64)
        follow[:max(0, len(hashes) - k)] = hashes[k:]
        value = np.where(k < width, mix(value * np.uint64(_PRIME) + follow), value)
    real = left >= width
    doc, value = doc_of[real], value[real]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def _sketch_flat(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, horizon: float,
                 slots: int) -> np.ndarray:
    """(n_docs, slots) shingle of the first arrival in each slot; 0 where none came before the horizon."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    out = np.zeros(n_docs * slots, dtype=np.uint64)
    limit = horizon / np.maximum(total, 1)
    when, where, who = [], [], []
    t = np.zeros(len(doc))
    k = 0
    while len(doc):
        draw = mix(shingle + np.uint64((2 * k + 1) * _PRIME & 0xFFFFFFFFFFFFFFFF))
        u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        t = t - np.log(u) / weight
        live = t <= limit[doc]
        doc, shingle, weight, t = doc[live], shingle[live], weight[live], t[live]
        slot = mix(shingle + np.uint64((2 * k + 2) * _PRIME & 0xFFFFFFFFFFFFFFFF)) % np.uint64(slots)
        when.append(t)
        where.append(doc * slots + slot.astype(np.int64))
        who.append(shingle)
        k += 1
    when, where, who = np.concatenate(when), np.concatenate(where), np.concatenate(who)
    late_first = np.argsort(-when, kind="stable")
    out[where[late_first]] = who[late_first]  # the earliest arrival is written last
    return out.reshape(n_docs, slots)


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int,
                 slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash sketches of ``n_docs`` documents, each with at least one shingle."""
    horizon = slots * (np.log(slots) + 3.0)
    out = _sketch_flat(doc, shingle, weight.astype(np.float64), n_docs, horizon, slots)
    short = np.flatnonzero((out == 0).any(axis=1))
    while len(short):
        horizon *= 2
        pick = np.isin(doc, short)
        place = np.searchsorted(short, doc[pick])
        out[short] = _sketch_flat(place, shingle[pick], weight[pick].astype(np.float64), len(short), horizon, slots)
        short = short[(out[short] == 0).any(axis=1)]
    return out


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(n_docs, bands) keys, one number space for all bands."""
    rows = sketches.shape[1] // bands
    parts = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_PRIME), parts.shape[:2])
    for r in range(rows):
        key = mix(key * np.uint64(_PRIME) + parts[:, :, r])
    return key.view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets given as sorted keys and weights.

    J_P = sum over common d of 1 / sum over e of max(p_e / p_d, q_e / q_d).
    """
    if not len(a) or not len(b):
        return 0.0
    keys = np.union1d(a, b)
    p, q = np.zeros(len(keys)), np.zeros(len(keys))
    p[np.searchsorted(keys, a)] = wa / wa.sum()
    q[np.searchsorted(keys, b)] = wb / wb.sum()
    with np.errstate(divide="ignore"):
        ratio = q / p  # infinite where only b has the key
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    low_p = np.concatenate([[0.0], np.cumsum(p)])  # sum of p over smaller or equal ratios
    high_q = np.concatenate([np.cumsum(q[::-1])[::-1], [0.0]])
    common = (p > 0) & (q > 0)
    upto = np.searchsorted(ratio, ratio[common], side="right")
    return float(np.sum(1.0 / (low_p[upto] / p[common] + high_q[upto] / q[common])))


def _sketch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, nodes, sums = batch["_text"].tolist(), batch["node"].tolist(), batch["md5"].tolist()
        named = batch["named"].tolist()
        for a, b in slices(texts):
            doc, shingle, weight = weighted_shingles(texts[a:b])
            keys: list = [[] for _ in range(b - a)]
            marks = [b""] * (b - a)
            with_words = np.unique(doc)
            if len(with_words):
                place = np.searchsorted(with_words, doc)
                sketches = prob_minhash(place, shingle, weight, len(with_words))
                low = sketches.astype(np.uint8)
                for i, row, mark in zip(with_words, band_keys(sketches), low):
                    keys[i], marks[i] = row, mark.tobytes()
            yield pd.DataFrame({"node": nodes[a:b], "named": named[a:b], "md5": sums[a:b], "keys": keys, "marks": marks})


def _content_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, nodes = batch["_text"].tolist(), batch["node"].tolist()
        for a, b in slices(texts):
            doc, shingle, weight = weighted_shingles(texts[a:b])
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            yield pd.DataFrame({
                "node": nodes[a:b],
                "shingles": [shingle[x:y].astype("<u8").tobytes() for x, y in zip(cut, cut[1:])],
                "counts": [b"" if (weight[x:y] == 1).all() else weight[x:y].astype("<u4").tobytes()
                           for x, y in zip(cut, cut[1:])]})


def _weights(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, "<u4").astype(float) if counts else np.ones(n)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sims = []
        for sa, ca, sb, cb in zip(batch["sa"], batch["ca"], batch["sb"], batch["cb"]):
            a, b = np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8")
            sims.append(probability_jaccard(a, _weights(ca, len(a)), b, _weights(cb, len(b))))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": sims})


def _of_ends(content: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``content`` that a pair names, so that no other is shuffled."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return content.join(ends, "node", "left_semi")


def verify(pairs: DataFrame, content: DataFrame, min_similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose exact similarity reaches the bound."""
    right = content.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    left = content.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    return (pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "ca", "sb", "cb")
            .mapInPandas(_compare, "a long, b long, similarity double")
            .where(F.col("similarity") >= min_similarity))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many slots agree, each row of ``a`` with each of ``b`` (one byte a slot)."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for slot in range(a.shape[1]):
        out += a[:, slot][:, None] == b[:, slot][None, :]
    return out


def _near_pairs(key: int, side: np.ndarray | None, c: np.ndarray, keys: np.ndarray,
                marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, place, slots that agree) of the pairs of different components whose sketches are near, each pair
    once, from at most ``_COMPARED`` comparisons at a time (one row at least).

    ``side`` tells two blocks apart that meet (None for one block with itself).
    A pair that shares several buckets is looked at in the first of them. Every
    such pair has an end outside the component that most of the rows belong to,
    so only those ends are compared.
    """
    _, at, sizes = np.unique(c, return_inverse=True, return_counts=True)
    outside = at != sizes.argmax()
    few = np.flatnonzero(outside)
    step = max(1, _COMPARED // len(c))
    for start in range(0, len(few), step):
        rows = few[start:start + step]
        n = agreeing(marks[rows], marks)
        i, j = np.nonzero((n >= MIN_AGREEING) & (c[rows][:, None] != c[None, :]))
        x, n = rows[i], n[i, j]
        own = ~outside[j] | (x < j)  # with both ends outside it is met from either
        if side is not None:
            own &= side[x] != side[j]
        x, y, n = x[own], j[own], n[own]
        if len(x):
            first = (keys[x] == keys[y]).argmax(axis=1)
            own = keys[x, first] == key
            yield np.minimum(x, y)[own], np.maximum(x, y)[own], n[own]


def _bucket_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members ``(key, text_id, c, n)`` of unsettled buckets of n with their sketches, once per pair ``(i, j)`` of blocks they meet in."""
    placed = (members.select("key", "text_id", "c", F.ceil(F.col("n") / BUCKET_BLOCK).cast("long").alias("_parts"))
              .withColumn("part", F.pmod(F.xxhash64("text_id"), F.col("_parts")))
              .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))))
    return (placed.select("key", F.least("part", "_other").alias("i"), F.greatest("part", "_other").alias("j"), "part", "text_id", "c")
            .join(texts.select("text_id", "keys", "marks"), "text_id"))


def _best_partners(ids: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of the pairs, for each component the one that agrees most: at most one per component and pair of blocks."""
    a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
    order = np.lexsort((b, a, -n.astype(np.int64)))
    rank = np.tile(np.arange(len(order)), 2)
    ends = np.concatenate([c[x[order]], c[y[order]]])
    by_end = np.lexsort((rank, ends))
    _, at = np.unique(ends[by_end], return_index=True)  # the best rank of every component
    return order[np.unique(rank[by_end][at])]


def _kept_pairs(key: int, side: np.ndarray | None, ids: np.ndarray, c: np.ndarray, keys: np.ndarray,
                marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The near pairs ``(a, b)`` of two blocks and no texts, where they are few for the rows; else the best pairs and
    the texts of all. Pairs held at a time follow the rows, not their square."""
    limit, total = PAIRS_PER_ROW * len(ids), 0
    near = np.zeros(len(ids), bool)
    x, y, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    for found in _near_pairs(key, side, c, keys, marks):
        total += len(found[0])
        near[found[0]] = near[found[1]] = True
        x, y, n = (np.concatenate(p) for p in zip((x, y, n), found))
        if total > limit:  # the best of the best so far and the new ones
            best = _best_partners(ids, c, x, y, n)
            x, y, n = x[best], y[best], n[best]
    return np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), np.unique(ids[near]) if total > limit else ids[:0]


_MET = ["key", "i", "j", "part", "text_id", "c"]


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, over rows sorted by (key, i, j), one group held at a time: its near pairs ``(a, b)``
    (``pair``) where they are few for its rows; else the best pairs, and ``(key, text_id)`` of the texts that have a
    near partner in another component."""
    def groups(numbers: np.ndarray, keys: np.ndarray, marks: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
        out = [(np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s, e in zip(stops[:-1].tolist(), stops[1:].tolist()):
            key, i, j = numbers[s, :3].tolist()
            side = None if i == j else numbers[s:e, 3] == i
            ids, c = numbers[s:e, 4], numbers[s:e, 5]
            a, b, near = _kept_pairs(key, side, ids, c, keys[s:e], marks[s:e])
            out.append((np.ones(len(a), bool), a, b))
            out.append((np.zeros(len(near), bool), np.full(len(near), key), near))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*out)], names=["pair", "a", "b"])

    numbers, keys, marks = np.zeros((0, 6), np.int64), np.zeros((0, BANDS), np.int64), np.zeros((0, SLOTS), np.uint8)
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in _MET], axis=1)
        numbers = np.concatenate([numbers, fresh])
        keys = np.concatenate([keys, batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)])
        marks = np.concatenate([marks, np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint8).reshape(-1, SLOTS)])
        stops = np.concatenate([[0], np.flatnonzero((numbers[1:, :3] != numbers[:-1, :3]).any(axis=1)) + 1])
        yield groups(numbers, keys, marks, stops)
        numbers, keys, marks = numbers[stops[-1]:], keys[stops[-1]:], marks[stops[-1]:]
    yield groups(numbers, keys, marks, np.array([0, len(numbers)] if len(numbers) else [0]))


def _looked(members: DataFrame, texts: DataFrame, tried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` to verify, without those ``tried`` before, and texts ``(key, text_id)`` that have more near partners, see ``_look``."""
    met = _bucket_pairs(members, texts)
    found = freeze(met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                   .select(*_MET, "keys", "marks").mapInArrow(_look, "pair boolean, a long, b long"), "dedup-look")
    return (freeze(found.where("pair").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "dedup-pairs"),
            found.where("not pair").select(F.col("a").alias("key"), F.col("b").alias("text_id")))


def _shared_mass(a: list[tuple[np.ndarray, np.ndarray]],
                 b: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text of ``a`` against each of ``b``: the share of the first, and of the second, on common shingles.

    J_P is at most the smaller of the two.
    """
    common = np.intersect1d(np.concatenate([s for s, _ in a]), np.concatenate([s for s, _ in b]))
    out = np.zeros((len(a), len(b)), np.float32), np.zeros((len(a), len(b)), np.float32)

    def entries(side: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(side)), [len(s) for s, _ in side])
        shingle = np.concatenate([s for s, _ in side])
        share = np.concatenate([w / w.sum() for _, w in side])
        column = np.minimum(np.searchsorted(common, shingle), len(common) - 1)
        use = common[column] == shingle
        order = np.argsort(column[use], kind="stable")
        return row[use][order], column[use][order], share[use][order]

    if not len(common):
        return out
    sides = entries(a), entries(b)
    for start in range(0, len(common), _COLUMNS):
        dense = []
        for (row, column, share), n in zip(sides, (len(a), len(b))):
            x, y = np.searchsorted(column, [start, start + _COLUMNS])
            d = np.zeros((n, _COLUMNS), np.float32)
            d[row[x:y], column[x:y] - start] = share[x:y]
            dense.append(d)
        out[0][:] += dense[0] @ (dense[1] > 0).astype(np.float32).T
        out[1][:] += (dense[0] > 0).astype(np.float32) @ dense[1].T
    return out


def _links_between(key: int, left: list, right: list | None, min_similarity: float) -> list[tuple[int, int]]:
    """Components linked by the pairs of two blocks of bucket ``key`` (of one block where ``right`` is None)."""
    def parts(block: list) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        content = []
        for m in block:
            s = np.frombuffer(m["shingles"], "<u8")
            content.append((s, _weights(m["counts"], len(s))))
        return np.array([m["keys"] for m in block]), np.array([m["c"] for m in block]), content

    keys_a, c_a, a = parts(left)
    keys_b, c_b, b = (keys_a, c_a, a) if right is None else parts(right)
    band = int(np.flatnonzero(keys_a[0] == key)[0])
    open_ = c_a[:, None] != c_b[None, :]
    if right is None:
        open_ &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    for k in range(band):  # decided in an earlier bucket
        open_ &= keys_a[:, k][:, None] != keys_b[:, k][None, :]
    if not open_.any():
        return []
    mass = np.minimum(*_shared_mass(a, b))
    i, j = np.nonzero(open_ & (mass >= min_similarity - 1e-4))  # sums are in single precision
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    links = []
    for k in np.argsort(-mass[i, j], kind="stable"):
        x, y = int(c_a[i[k]]), int(c_b[j[k]])
        if find(x) != find(y) and probability_jaccard(*a[i[k]], *b[j[k]]) >= min_similarity:
            parent[find(x)] = find(y)
            links.append((x, y))
    return links


def remaining_links(members: DataFrame, texts: DataFrame, content: DataFrame, min_similarity: float) -> DataFrame:
    """Links ``(a, b)`` of components, by every pair of different components in a bucket of ``members (key, text_id, c)``.

    Buckets of two members are left out: the round before compared them.
    """
    spark = members.sparkSession
    wide = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 2").drop("_n"), "key")
    size = content.select(F.col("node").alias("text_id"), F.octet_length("shingles").cast("long").alias("_bytes"))
    wide = freeze(wide.join(size, "text_id"), "dedup-wide")

    def blocks_of(n: str, size: str):
        return F.greatest(F.ceil(F.col(n) / BLOCK_MEMBERS), F.ceil(F.col(size) / BLOCK_BYTES)).cast("long")

    # a component that fills a block has blocks of its own, which never meet each other; the others share blocks
    per_part = freeze(wide.groupBy("key", "c").agg(F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_size"))
                      .withColumn("_own", blocks_of("_n", "_size")), "dedup-parts")
    shared = (per_part.where("_own = 1").groupBy("key").agg(F.sum("_n").alias("_ns"), F.sum("_size").alias("_sizes"))
              .select("key", blocks_of("_ns", "_sizes").alias("_shared")))
    large = per_part.where("_own > 1").select("key", "c", "_own")
    placed = (wide.join(large, ["key", "c"], "left").join(shared, "key", "left")
              .select("key", "text_id", "c", F.when(F.col("_own").isNotNull(), F.col("c")).alias("own"),
                      F.pmod(F.xxhash64("text_id", "key"), F.coalesce("_own", "_shared")).alias("part")))
    ids = wide.select("text_id").distinct()
    whole = (content.withColumnRenamed("node", "text_id").join(ids, "text_id", "left_semi")
             .join(texts.select("text_id", "keys"), "text_id"))
    full = placed.join(whole, "text_id")
    packed = freeze(full.groupBy("key", "own", "part")
                    .agg(F.collect_list(F.struct("text_id", "c", "keys", "shingles", "counts")).alias("block"))
                    .withColumn("id", F.monotonically_increasing_id()), "dedup-blocks")
    one = packed.select("key", "own", F.col("id").alias("i"))
    two = packed.select("key", F.col("own").alias("_own"), F.col("id").alias("j"))
    meets = (one.join(two, "key").where("i < j and (own is null or _own is null or own <> _own)")
             .select("key", F.when((F.col("i") + F.col("j")) % 2 == 0, F.struct("i", "j"))
                     .otherwise(F.struct(F.col("j").alias("i"), F.col("i").alias("j"))).alias("ij"))
             .select("key", "ij.*"))
    pairs = (meets.join(packed.select(F.col("id").alias("i"), F.col("block").alias("left")), "i")
             .join(packed.select(F.col("id").alias("j"), F.col("block").alias("right")), "j")
             .select("key", "left", "right"))
    pairs = pairs.unionByName(packed.where("own is null and size(block) > 1")
                              .select("key", F.col("block").alias("left"), F.lit(None).cast(pairs.schema["right"].dataType)
                                      .alias("right")))

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for key, left, right in zip(batch["key"], batch["left"], batch["right"])
                     for x in _links_between(key, list(left), None if right is None else list(right), min_similarity)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    # a row holds two blocks: few rows in a batch
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BLOCK_PAIRS_PER_BATCH))
    try:
        return freeze(pairs.mapInPandas(links, "a long, b long").distinct(), "dedup-rest")
    finally:
        spark.conf.set(name, before)


def _merged(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """``labels (v, c)`` after links ``(a, b)`` between components."""
    merged = connected_components(ends).select(F.col("v").alias("c"), F.col("c").alias("_c"))
    old = labels.select("v", "c").join(merged, "c", "left").select("v", F.coalesce("_c", "c").alias("c"))
    fresh = merged.select(F.col("c").alias("v"), F.col("_c").alias("c"))
    return freeze(old.unionByName(fresh).groupBy("v").agg(F.min("c").alias("c")), "dedup-labels")


def _nodes(docs: DataFrame) -> DataFrame:
    text = text_of("text")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("node"), F.col("doc_id").isNotNull().alias("named"),
        F.unhex(F.md5(text.cast("binary"))).alias("md5"), text.alias("_text"))


def _same_document(sketch: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the texts that share a node."""
    own = sketch.select("node", "md5").distinct()
    several = own.groupBy("node").agg(F.min("md5").alias("_lo"), F.max("md5").alias("_hi")).where("_lo < _hi").select("node")
    ends = freeze(own.join(several, "node").join(texts.select("md5", "text_id"), "md5").select("node", "text_id"), "dedup-ids")
    return (ends.join(ends.groupBy("node").agg(F.min("text_id").alias("a")), "node")
            .select("a", F.col("text_id").alias("b")).where("a <> b"))


def _classes(docs: DataFrame, min_similarity: float) -> DataFrame:
    """``(node, named, md5, class_id)`` per row of ``docs``; a row without a doc_id is not named."""
    rows = _nodes(docs)
    sketch = freeze(rows.mapInPandas(_sketch_rows, "node long, named boolean, md5 binary, keys array<bigint>, marks binary"), "dedup-sketch")
    texts = freeze(sketch.groupBy("md5").agg(F.min("node").alias("first_node"), F.first("keys").alias("keys"), F.first("marks").alias("marks"))
                   .withColumn("text_id", F.monotonically_increasing_id()), "dedup-texts")

    member = texts.select("text_id", F.explode("keys").alias("key"))
    leaders = (member.groupBy("key").agg(F.min("text_id").alias("lead"), F.max("text_id").alias("_last"))
               .where("_last > lead").drop("_last"))
    members = freeze(member.join(leaders, "key"), "dedup-members")
    involved, n_involved = freeze_counted(members.select("text_id").union(members.select("lead")).distinct(), "dedup-involved")
    content, n_content = freeze_counted(
        rows.select("node", "md5", "_text")
        .join(texts.select(F.col("first_node").alias("node"), "md5", "text_id").join(involved, "text_id"), ["node", "md5"])
        .select(F.col("text_id").alias("node"), "_text").mapInPandas(_content_rows, "node long, shingles binary, counts binary"), "dedup-content")
    if n_content > n_involved:  # rows that repeat
        content = freeze(content.dropDuplicates(["node"]), "dedup-content")

    pairs = members.where("text_id <> lead").select(F.col("lead").alias("a"), F.col("text_id").alias("b")).distinct()
    labels = connected_components(verify(pairs, content, min_similarity).select("a", "b")
                                  .union(_same_document(sketch, texts)))
    tried = members.select(F.col("lead").alias("a"), F.col("text_id").alias("b"))
    members = members.select("key", "text_id", F.lit(None).cast("long").alias("c"))
    while True:
        tagged = members.select("key", "text_id", F.col("c").alias("_was")).join(
            labels.select(F.col("v").alias("text_id"), "c"), "text_id", "left") \
            .withColumn("c", F.coalesce("c", "text_id"))
        # a bucket whose members share a component is settled for good; one in which no component changed gives the pairs it gave
        unsettled = (tagged.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count(F.lit(1)).alias("n"),
                                               F.max(F.coalesce(F.col("c") != F.col("_was"), F.lit(True))).alias("moved"))
                     .where("_lo < _hi").select("key", "n", "moved"))
        members, n_open = freeze_counted(tagged.drop("_was").join(unsettled, "key"), "dedup-open")
        if not n_open:
            break
        picked, beside = _looked(members.where("moved"), texts, tried)
        tried = tried.unionByName(picked)
        links, n_links = freeze_counted(verify(picked, _of_ends(content, picked), min_similarity), "dedup-links")
        # pairs named are decided; a text with no further near partner has none after a merge either
        members = members.where("moved").join(beside, ["key", "text_id"], "left_semi").unionByName(members.where("not moved"))
        if not n_links:  # the rest is decided pair by pair
            labels = _merged(labels, remaining_links(members, texts, content, min_similarity))
            break
        named = labels.select("v", "c")
        ends = (links.select("a", "b").join(named.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", "left")
                .join(named.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "left")
                .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        labels = _merged(labels, ends)

    own = labels.select(F.col("v").alias("text_id"), "c")
    names = own.join(texts.select("text_id", "first_node"), "text_id").groupBy("c").agg(F.min("first_node").alias("class_id"))
    by_text = (texts.select("md5", "text_id", "first_node").join(own.join(names, "c").drop("c"), "text_id", "left")
               .select("md5", F.coalesce("class_id", "first_node").alias("class_id")))
    return sketch.select("node", "named", "md5").join(by_text, "md5").select("node", "named", "md5", "class_id")


def near_duplicate_classes(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``(doc_id, node, class_id)`` per row of ``docs``: node is the doc_id or, where that is null, a hash of the text;
    class_id is the smallest node of the class."""
    return _classes(docs, min_similarity).select(F.when(F.col("named"), F.col("node")).alias("doc_id"), "node", "class_id")


def keep_one(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest doc_id, of its texts the one with the smallest MD5."""
    kept = (_classes(docs, min_similarity).where("node = class_id")
            .groupBy(F.col("node").alias("_node")).agg(F.min("md5").alias("_md5")))
    text = text_of("text")
    return (docs.withColumns({"_node": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)),
                              "_md5": F.unhex(F.md5(text.cast("binary")))})
            .dropDuplicates(["_node", "_md5"]).join(kept, ["_node", "_md5"], "left_semi").select(*docs.columns))

"""Divergence of sources: how far each source's word use lies from the others'.

Per language, terms found in enough documents are kept; every (language,
source) group and every language spreads probability over all kept terms by
smoothed counts, in whole billionths. A pair of groups differs by the sum of
absolute differences over all kept terms; a group is marked by the terms it
uses more than its language does.

1. One pass over the texts (Arrow kernels); a task adds up (language, source,
   term) before anything is shuffled. Term counts and document counts meet by
   (language, term), so the document count of a term, its count in the
   language and the choice of kept terms need no second shuffle.
2. Kept terms get dense ids; a group's counts become sorted (term id, count)
   arrays in blocks of ``BLOCK_TERMS`` ids, so no cell grows with the
   vocabulary.
3. *Pair tasks*: a language's sources are dealt to tiles of ``TILE`` sources.
   For each pair of tiles and block of ids the arrays are co-grouped; in the
   task every unordered pair is merged once. The shorter array is searched in
   the longer one (galloping), which prices overlaps, then both one-sided
   rests; terms absent on both sides are priced from their number alone. The
   price serves both directions.

Sums per pair and block are added up; pairs of sources are the result itself.
All arithmetic is on whole numbers.

Defined results: null text, language and source are empty. A group without
terms still counts, with equal shares. A language without kept terms has pairs
of value 0 and no term rows. Repeated rows count as often as they stand there.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertforge.llm.arrowwords import byte_slices, coded_words
from alertforge.llm.common import freeze
from alertforge.operators.ordinals import ordinals_by_range

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
TOP_TERMS = 50
UNIT, SMOOTH = 1_000_000_000, 5
BLOCK_TERMS = 32_768
TILE = 8
HELD_ROWS = 1_000_000
# a row that only says that a group exists; terms hold no blank
_GROUP_MARK = " "

_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                    ("n", pa.int64()), ("df", pa.int64())])


def _batch_counts(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Term counts and document counts per (language, source) of a few texts."""
    row, word, dictionary = coded_words(batch.column("text"), SEPARATORS)
    keys = pa.Table.from_arrays([batch.column("lang"), batch.column("source"), pa.array(np.arange(batch.num_rows))],
                                names=["lang", "source", "row"])
    groups = keys.group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
    group_of = np.zeros(batch.num_rows, dtype=np.int64)
    for g, rows in enumerate(groups.column("row_list").to_pylist()):
        group_of[rows] = g
    langs, sources = groups.column("lang").combine_chunks(), groups.column("source").combine_chunks()
    mark = pa.array([_GROUP_MARK + s for s in sources.to_pylist()], pa.string())
    zero = pa.array(np.zeros(len(langs), np.int64))
    yield pa.Table.from_arrays([langs, sources, mark, zero, zero], schema=_PARTS)
    if not len(row):
        return
    in_doc, n = np.unique(row * len(dictionary) + word, return_counts=True)
    doc, term = np.divmod(in_doc, len(dictionary))
    code, where = np.unique(group_of[doc] * len(dictionary) + term, return_inverse=True)
    group, term = np.divmod(code, len(dictionary))
    total = np.zeros(len(code), dtype=np.int64)
    np.add.at(total, where, n)
    yield pa.Table.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), dictionary.take(pa.array(term)),
                                pa.array(total), pa.array(np.bincount(where, minlength=len(code)).astype(np.int64))], schema=_PARTS)


def _term_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term) sums of a task; what is held is handed on when it gets large."""
    held: list[pa.Table] = []
    rows = 0

    def summed() -> pa.Table:
        whole = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False)
        return whole.aggregate([("n", "sum"), ("df", "sum")]).rename_columns(_PARTS.names)

    for batch in batches:
        for part in byte_slices(batch, "text"):
            for t in _batch_counts(part):
                held.append(t)
                rows += t.num_rows
            if rows > 2 * HELD_ROWS:
                whole = summed()
                held, rows = [whole], whole.num_rows
                if rows > HELD_ROWS:
                    yield from whole.to_batches(50_000)
                    held, rows = [], 0
    if held:
        yield from summed().to_batches(50_000)


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 n_terms))``, exact."""
    def whole(c: Column) -> Column:
        return c.cast("decimal(20,0)")
    scaled = whole(count + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)")
    return (1 + F.call_function("div", scaled, whole(total) + SMOOTH * whole(n_terms))).cast("long")


def _shares(count: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """``share`` for arrays: long division by thousands, exact for totals below 9 * 10^15."""
    by = total + SMOOTH * n_terms
    rest, out = count.astype(np.int64) + SMOOTH, np.zeros(len(count), np.int64)
    out, rest = np.divmod(rest, by)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + digit
    return out + 1


def merge_pair(a_ids: np.ndarray, a: np.ndarray, a_none: int, b_ids: np.ndarray, b: np.ndarray,
               b_none: int) -> tuple[int, int]:
    """(sum of |difference| over terms of either array, how many those are).

    Ids are sorted; ``_none`` is the share of a term that a group lacks.
    """
    if len(a_ids) > len(b_ids):
        a_ids, a, a_none, b_ids, b, b_none = b_ids, b, b_none, a_ids, a, a_none
    at = np.searchsorted(b_ids, a_ids)
    both = np.zeros(len(a_ids), dtype=bool)
    inside = at < len(b_ids)
    both[inside] = b_ids[at[inside]] == a_ids[inside]
    value = np.abs(a[both] - b[at[both]]).sum() + np.abs(a[~both] - b_none).sum()
    value += np.abs(b - a_none).sum() - np.abs(b[at[both]] - a_none).sum()
    return int(value), len(a_ids) + len(b_ids) - int(both.sum())


def _pair_task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of all unordered pairs of the sources of two tiles in one block of term ids."""
    def read(side: pd.DataFrame) -> list[tuple]:
        out = []
        for r in side.itertuples():
            none = int(_shares(np.zeros(1, np.int64), r.total, r.n_terms)[0])
            out.append((r.number, np.asarray(r.ids), _shares(np.asarray(r.counts), r.total, r.n_terms), none,
                        r.total, r.n_terms))
        return out

    rows = []
    one = read(left)
    if len(left) and left["own"].iloc[0]:
        pairs = [(x, y) for i, x in enumerate(one) for y in one[i + 1:]]
    else:
        two = read(right)
        pairs = [(x, y) for x in one for y in two]
    lang = (left if len(left) else right)["lang"].iloc[0]
    for x, y in pairs:
        value, n = merge_pair(x[1], x[2], x[3], y[1], y[2], y[3])
        rows.append((lang, min(x[0], y[0]), max(x[0], y[0]), value, n))
    return pd.DataFrame(rows, columns=["lang", "a", "b", "value", "n"]).astype(
        {"lang": object, "a": "int64", "b": "int64", "value": "int64", "n": "int64"})


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, source, term, n, lang_n)`` of kept terms, and one row without a term per group."""
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    parts = docs.select(named("lang"), named("source"), named("text")).mapInArrow(
        _term_parts, "lang string, source string, term string, n long, df long")
    # one exchange serves the sums by source and those by language
    counts = (parts.repartition("lang", "term").groupBy("lang", "source", "term")
              .agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    by_term = Window.partitionBy("lang", "term")
    mark = F.startswith("term", F.lit(_GROUP_MARK))
    return freeze(counts.withColumns({"_docs": F.sum("df").over(by_term), "lang_n": F.sum("n").over(by_term)})
                  .where(mark | (F.col("_docs") >= min_docs))
                  .select("lang", "source", F.when(~mark, F.col("term")).alias("term"), "n", "lang_n"), "term-counts")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
               block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: pairs of sources, and the terms that mark a source."""
    counts = term_counts(docs, min_docs)
    kept = counts.where(F.col("term").isNotNull())
    ids = freeze(ordinals_by_range(kept.select("lang", "term").distinct(), ["lang", "term"], "id"), "term-ids")
    langs = (counts.groupBy("lang").agg(F.sum("n").alias("lang_total"))
             .join(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms")), "lang", "left").fillna(0, ["n_terms"]))
    # one row per group from here on
    groups = freeze(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
                    .withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")),
                    "source-groups")

    arrays = (kept.join(ids, ["lang", "term"])
              .groupBy("lang", "source", F.floor(F.col("id") / block_terms).cast("long").alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("_t")))
    # a source without a term in a block stands there with empty arrays: the others' terms are one-sided to it
    blocks = ids.select("lang", F.floor(F.col("id") / block_terms).cast("long").alias("block")).distinct()
    empty = F.array().cast("array<bigint>")
    arrays = freeze(groups.join(blocks, "lang").join(arrays, ["lang", "source", "block"], "left")
                    .select("lang", "block", "number", "total", "n_terms",
                            F.floor((F.col("number") - 1) / tile).cast("long").alias("tile"),
                            F.coalesce("_t.id", empty).alias("ids"), F.coalesce("_t.n", empty).alias("counts")), "term-arrays")
    tiles = groups.groupBy("lang").agg((F.floor((F.max("number") - 1) / tile) + 1).cast("long").alias("n_tiles"))
    placed = arrays.join(tiles, "lang")
    # the same table twice: the right side gets column identities of its own
    twin = placed.select(*[F.col(c).alias(f"r_{c}") for c in placed.columns]).toDF(*placed.columns)
    first = (placed.withColumn("other", F.explode(F.sequence(F.col("tile"), F.col("n_tiles") - 1)))
             .withColumn("own", F.col("other") == F.col("tile")))
    second = (twin.where("tile > 0").withColumn("other", F.col("tile"))
              .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile") - 1))))
    keys = ["lang", "tile", "other", "block"]
    columns = ["number", "total", "n_terms", "ids", "counts"]
    merged = (first.select(*keys, "own", *columns).groupBy(*keys)
              .cogroup(second.select(*keys, *columns).groupBy(*keys))
              .applyInPandas(_pair_task, "lang string, a long, b long, value long, n long")
              .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("n").alias("n")))
    return _pair_rows(groups, merged).unionByName(_term_rows(kept, groups, top_terms))


def _pair_rows(groups: DataFrame, merged: DataFrame) -> DataFrame:
    none = share(F.lit(0), F.col("total"), F.col("n_terms"))
    side = groups.select("lang", "source", "number", "n_terms", F.when(F.col("n_terms") > 0, none).alias("none"))
    a = side.select("lang", "n_terms", F.col("source").alias("sa"), F.col("number").alias("a"), F.col("none").alias("na"))
    b = side.select("lang", F.col("source").alias("sb"), F.col("number").alias("b"), F.col("none").alias("nb"))
    both = a.join(b, "lang").where("a < b").join(merged, ["lang", "a", "b"], "left").withColumn(
        "value", F.coalesce(F.coalesce("value", F.lit(0))
                            + (F.col("n_terms") - F.coalesce("n", F.lit(0))) * F.abs(F.col("na") - F.col("nb")), F.lit(0)))
    ways = F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")),
                   F.struct(F.col("sb").alias("source"), F.col("sa").alias("item")))
    rows = both.select("lang", "value", F.explode(ways).alias("_w")).select("lang", "_w.source", "_w.item", "value")
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value", _rank())


def _term_rows(kept: DataFrame, groups: DataFrame, top_terms: int) -> DataFrame:
    own = share(F.col("n"), F.col("total"), F.col("n_terms"))
    whole = share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    rows = (kept.where("n > 0").join(groups, ["lang", "source"])
            .select("lang", "source", F.col("term").alias("item"), (own - whole).alias("value")).where("value > 0"))
    return (rows.select("lang", "source", F.lit("term").alias("part"), "item", "value", _rank())
            .where(F.col("rank") <= top_terms))


def _rank() -> Column:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return F.row_number().over(order).alias("rank")

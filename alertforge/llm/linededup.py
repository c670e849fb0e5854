"""Line dedup: lines found in many documents lose their place, or all but the first.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends
and with A-Z lower-cased. What comes back is not text but, per document, a
compressed bitmap of the lines that stay (``keep``), and how many go.

1. *Entries* (one pass over the texts): one narrow row per line with a key:
   128 bits of the key's MD5, the document, the position. Equal rows of the
   input are told by 128 bits of (doc_id, text); within a task the lines of a
   repeated row are sent once, with a count.
2. *Stream*: entries are range-partitioned by (hash, document) and sorted by
   (hash, document, position). Document is part of the range, so a line that
   stands in a third of all documents is split over as many tasks as it needs.
   Each task reads its sorted entries once, run by run, and holds at most the
   entries of ``min_docs`` documents before it knows that a run is frequent.
   Only the first and the last run of a task can go on elsewhere: their totals
   (two rows a task) are added up, and the few entries that hang on them are
   settled by that.
3. *Bitmaps*: dropped positions are collected per document (at most its own
   lines), set in a bitmap and deflated where that is smaller.

``keep="first"`` keeps the first occurrence in (doc_id, text hash, position)
order, null doc_ids first; with ``min_docs=1`` that is the common line dedup.

Defined results: null text is empty; an empty text is one empty line; a line
whose key is shorter than ``min_chars`` code points (an empty key always) stays
and counts nowhere. Every row is a document, repeated rows too, and equal rows
share a bitmap (``keep="first"`` keeps a line in all copies of the first row).
An empty table gives no rows. Columns named as an added one are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from alertforge.llm.common import WORD_SPACE, freeze, text_of

BLANKS = WORD_SPACE.encode()
MAX_SEEN = 100_000
MAX_HELD_LINES = 1_000_000
_FLUSH_LINES = 100_000

ENTRY_SCHEMA = "h1 long, h2 long, doc long, d1 long, d2 long, pos long, n long"
_ENTRY_COLUMNS = ["h1", "h2", "doc", "d1", "d2", "pos", "n"]
_ARROW = pa.schema([(c, pa.int64()) for c in _ENTRY_COLUMNS])
_KEY = ["h1", "h2", "doc", "d1", "d2"]
# what the stream says of an entry
DROP, OPEN, TOTAL, HEAD = 0, 1, 2, 3


def _digests(raw: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, MD5 of the key) of the lines with a key of at least ``min_chars`` code points."""
    for pos, line in enumerate(raw.lower().split(b"\n")):  # bytes.lower() turns A-Z alone
        key = line.strip(BLANKS)
        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
            yield pos, hashlib.md5(key, usedforsecurity=False).digest()


def _entries(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def table(digests: list[bytes], rest: list[tuple]) -> pa.RecordBatch:
        hashes = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        columns = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
        columns += [pa.array(c, pa.int64()) for c in zip(*rest)] if rest else [pa.array([], pa.int64())] * 5
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        again: dict[tuple, list] = {}  # identity -> [rows seen again, doc_id, distinct keys]
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for (d1, d2), (n, doc, keys) in again.items():
                if keys:
                    yield table(list(keys), [(doc, d1, d2, -1, n)] * len(keys))
            again.clear()
            seen.clear()

        for batch in batches:
            digests, rest = [], []
            names = (batch.column(c).to_pylist() for c in ("_ld_doc", "_ld_d1", "_ld_d2"))
            for doc, d1, d2, raw in zip(*names, batch.column("_ld_text")):
                me = (d1, d2)
                if me in again:
                    again[me][0] += 1
                    continue
                keys = _digests(raw.as_py(), min_chars)
                if me in seen:
                    again[me] = [1, doc, {k for _, k in keys}]
                    held += len(again[me][2])
                    continue
                seen.add(me)
                own: set[bytes] = set()
                for pos, k in keys:
                    digests.append(k)
                    rest.append((doc, d1, d2, pos, 0 if k in own else 1))  # a document counts once per key
                    own.add(k)
                if len(digests) >= _FLUSH_LINES:
                    yield table(digests, rest)
                    digests, rest = [], []
            if digests:
                yield table(digests, rest)
            if len(seen) > MAX_SEEN or held > MAX_HELD_LINES:
                yield from counted()
                held = 0
        yield from counted()
    return run


def _runs(min_docs: int, keep_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream a task's sorted entries; yields entries that go, and what only all tasks together can settle."""
    schema = _ARROW.append(pa.field("kind", pa.int64()))

    def out(rows: np.ndarray, kind: np.ndarray | int, null_doc: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(rows[:, i], pa.int64(), mask=null_doc if i == 2 else None) for i in range(7)]
        columns.append(pa.array(np.broadcast_to(kind, len(rows)).astype(np.int64)))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def total(key: tuple, n: int) -> pa.RecordBatch:
        return out(np.array([[*key, 0, 0, 0, -1, n]], dtype=np.int64), TOTAL, np.array([True]))

    def marked(rows: np.ndarray, edge: bool, frequent: bool, headless: bool) -> np.ndarray:
        """Kinds of one run's entries, -1 where nothing is to be said (``headless``: its first was seen before)."""
        kind = np.full(len(rows), (DROP if frequent else OPEN) if frequent or edge else -1)
        kind[rows[:, 5] < 0] = -1
        same = np.zeros(len(rows), dtype=bool)  # copies of a row met in several tasks
        same[1:] = (rows[1:, 2:6] == rows[:-1, 2:6]).all(axis=1)
        kind[same] = -1
        if keep_first and frequent and not headless:
            kind[np.flatnonzero(rows[:, 5] >= 0)[0]] = HEAD
        return kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, null_doc = np.zeros((0, 7), np.int64), np.zeros(0, bool)
        key, counted, first = None, 0, True  # the open run: documents already handed on; is it the task's first?
        for batch in batches:
            doc = batch.column("doc")
            fresh = np.stack([(batch.column(c).fill_null(0) if c == "doc" else batch.column(c))
                              .to_numpy(zero_copy_only=False) for c in _ENTRY_COLUMNS], axis=1)
            rows = np.concatenate([rows, fresh])
            null_doc = np.concatenate([null_doc, doc.is_null().to_numpy(zero_copy_only=False)])
            if not len(rows):
                continue
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], len(rows))
            sums = np.add.reduceat(rows[:, 6], starts)
            kinds = np.full(len(rows), -1)
            # runs that lie inside are settled together: only those long enough are looked at
            look = set(np.flatnonzero(sums >= min_docs).tolist()) | {0, len(starts) - 1}
            for r in sorted(look):
                a, b, n = starts[r], stops[r], int(sums[r])
                mine = (int(rows[a, 0]), int(rows[a, 1]))
                if mine == key:
                    n += counted
                elif key is not None and r == 0:  # the open run had ended with the batch before
                    if first:
                        yield total(key, counted)
                    first, counted = False, 0
                going_on = mine == key and counted > 0
                last = r == len(starts) - 1
                edge = first and r == 0
                if last and n < min_docs:
                    key, counted = mine, 0
                    if r:
                        first = False
                    break
                kinds[a:b] = marked(rows[a:b], edge, n >= min_docs, going_on)
                if last:
                    key, counted = mine, n
                    first = edge
                elif edge:
                    yield total(mine, n)
            said = kinds >= 0
            if said.any():
                yield out(rows[said], kinds[said], null_doc[said])
            # the open run stays if it is not yet frequent
            at = len(rows) if counted and key == tuple(rows[-1, :2].tolist()) else int(starts[-1])
            rows, null_doc = rows[at:], null_doc[at:]
        if key is not None:
            yield total(key, counted + int(rows[:, 6].sum()))
            if len(rows):
                kinds = marked(rows, True, False, False)
                said = kinds >= 0
                yield out(rows[said], kinds[said], null_doc[said])
    return run


def dropped_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "none",
                  num_partitions: int | None = None) -> DataFrame:
    """``(d1, d2, pos)``: the lines that go, by document identity."""
    entries = freeze(
        docs.select("_ld_doc", "_ld_d1", "_ld_d2", F.col("_ld_text").cast("binary").alias("_ld_text"))
        .mapInArrow(_entries(min_chars), ENTRY_SCHEMA), "line-entries")
    n = num_partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (entries.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in _KEY])
              .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*_KEY, "pos")]))
    said = freeze(ranged.mapInArrow(_runs(min_docs, keep == "first"), ENTRY_SCHEMA + ", kind long"), "line-runs")
    frequent = (said.where(F.col("kind") == TOTAL).groupBy("h1", "h2").agg(F.sum("n").alias("_n"))
                .where(F.col("_n") >= min_docs).select("h1", "h2"))
    settled = said.where(F.col("kind") == OPEN).join(frequent, ["h1", "h2"]).unionByName(said.where(F.col("kind") == HEAD))
    if keep == "first":
        place = F.struct(*[F.col(c) for c in ("doc", "d1", "d2", "pos")])
        first = settled.groupBy("h1", "h2").agg(F.min(place).alias("_first"))
        settled = settled.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("_first")))
    return said.where(F.col("kind") == DROP).select("d1", "d2", "pos").unionByName(settled.select("d1", "d2", "pos"))


def encode_keep(dropped: np.ndarray) -> bytes:
    """Bitmap of the lines that stay up to the last that goes; a first byte says whether it is deflated."""
    bits = np.ones((int(dropped.max()) // 8 + 1) * 8, dtype=np.uint8)
    bits[dropped] = 0
    raw = np.packbits(bits, bitorder="little").tobytes()
    small = zlib.compress(raw, 6)
    return b"\x01" + small if len(small) < len(raw) else b"\x00" + raw


def decode_keep(keep: bytes | None, n_lines: int) -> np.ndarray:
    """One boolean per line; lines beyond the bitmap stay."""
    out = np.ones(n_lines, dtype=bool)
    if keep:
        raw = zlib.decompress(keep[1:]) if keep[0] else keep[1:]
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n_lines]
        out[:len(bits)] = bits.astype(bool)
    return out


@pandas_udf(StructType([StructField("keep", BinaryType()), StructField("n_dropped", LongType())]))
def _bitmap(positions: pd.Series) -> pd.DataFrame:
    gone = [np.unique(np.asarray(p, dtype=np.int64)) for p in positions]
    return pd.DataFrame({"keep": [encode_keep(g) for g in gone], "n_dropped": [len(g) for g in gone]})


@pandas_udf(StringType())
def _kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    out = []
    for t, k in zip(text, keep):
        if t is None or k is None:
            out.append(t)
            continue
        lines = t.split("\n")
        out.append("\n".join([x for x, stays in zip(lines, decode_keep(k, len(lines)).tolist()) if stays]))
    return pd.Series(out, dtype=object)


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``keep`` (null where every line stays)."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep")]
    text, doc = text_of("text"), F.col("doc_id").cast("long")
    known = docs.select(*columns).withColumns({
        "_ld_doc": doc, "_ld_text": text,
        "_ld_d1": F.xxhash64(F.lit(1), doc, text), "_ld_d2": F.xxhash64(F.lit(2), doc, text)})
    maps = (dropped_lines(known, min_docs, min_chars, keep).groupBy("d1", "d2").agg(F.collect_list("pos").alias("_p"))
            .select(F.col("d1").alias("_ld_d1"), F.col("d2").alias("_ld_d2"), _bitmap("_p").alias("_ld_map")))
    return known.join(maps, ["_ld_d1", "_ld_d2"], "left").select(
        *columns, (F.regexp_count("_ld_text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.coalesce("_ld_map.n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.col("_ld_map.keep").alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that go; texts that lose none never leave the JVM."""
    return F.when(keep.isNull(), text).otherwise(_kept_text(F.when(keep.isNotNull(), text), keep))

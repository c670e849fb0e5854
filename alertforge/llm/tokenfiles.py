"""Binary token files: concatenated ids with Elias-Fano coded boundaries.

Layout of one file (little-endian)::

    8 bytes   magic
    ids       n_ids x width bytes (2 where the vocabulary has at most 2^16 ids)
    code      Elias-Fano code of the n_docs + 1 boundaries
    code      Elias-Fano code of the non-null doc_ids, less the smallest
    footer    counts, sizes of the parts, smallest doc_id, number of null doc_ids
    8 bytes   magic

Documents are range-partitioned and sorted by doc_id, each task streams one
file into the shared folder under a name of its own attempt, and the rows that
the job returns (one per file) are the manifest: files of lost or repeated
attempts are in no manifest. The first id of a file is the sum of the ids of
the files before it, so no boundary needs a 64-bit table.

Defined results: a null text is empty and stores the end id alone; null
doc_ids come first; rows with equal doc_id are all kept, in order of their
text. An empty table writes no file. Only doc_id and text are stored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertforge.llm import eliasfano
from alertforge.llm.common import count_rows, freeze, text_of
from alertforge.llm.storage import open_fs
from alertforge.llm.tokens import ID_SLICE_CHARS, VOCABULARY, slices, tokenizer

MAGIC = b"IDSEFv01"
_FOOTER = "<QQBQQqQ"  # docs, ids, width, bytes of boundaries, of doc_ids, smallest doc_id, null doc_ids
END_ID = 2
DOCS_PER_FILE = 50_000
READ_IDS = 1 << 22

MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


class TokenFile:
    """Reader of one file; loads the codes, leaves the ids on disk."""

    def __init__(self, uri: str) -> None:
        store, path = open_fs(uri)
        self._file = store.open_input_file(path)
        size = self._file.size()
        tail = self._file.read_at(struct.calcsize(_FOOTER) + 8, size - struct.calcsize(_FOOTER) - 8)
        if tail[-8:] != MAGIC or self._file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.n_docs, self.n_ids, self.width, b, d, low, self.n_null = struct.unpack(_FOOTER, tail[:-8])
        at = 8 + self.n_ids * self.width
        self.boundaries = eliasfano.EliasFano(self._file.read_at(b, at))
        self._doc_ids = eliasfano.EliasFano(self._file.read_at(d, at + b))
        self._low = low

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [int(x) + self._low for x in self._doc_ids.decode()]

    def ids(self, first: int, stop: int) -> np.ndarray:
        """Ids ``first`` to ``stop`` of the file."""
        data = self._file.read_at((stop - first) * self.width, 8 + first * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i``, by two selects."""
        return self.ids(self.boundaries.select(i), self.boundaries.select(i + 1))

    def close(self) -> None:
        self._file.close()


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                      docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Write ``docs`` below ``path`` (shared, empty) and return the manifest."""
    spark = docs.sparkSession

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        tok = tokenizer(vocabulary)
        end = np.array([end_id], tok.dtype).tobytes()
        part, out, lengths, doc_ids = TaskContext.get().partitionId(), None, [], []
        for batch in batches:
            texts = batch["_text"].tolist()
            if out is None and texts:
                store, folder = open_fs(path)
                store.create_dir(folder, recursive=True)
                name = f"ids-{part:06d}-{uuid.uuid4().hex}.bin"
                out = store.open_output_stream(f"{folder}/{name}")
                out.write(MAGIC)
            doc_ids.append(batch["doc_id"].astype("Int64"))
            for a, b in slices(texts, ID_SLICE_CHARS):
                for code in tok.ids(texts[a:b]):
                    out.write(code)
                    out.write(end)
                    lengths.append(len(code) // tok.dtype.itemsize + 1)
        if out is None:
            return
        known = pd.concat(doc_ids).dropna().to_numpy(dtype=np.int64)
        low = int(known[0]) if len(known) else 0
        bounds = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))])
        codes = (eliasfano.encode(bounds), eliasfano.encode((known - low).astype(np.uint64)))
        for code in codes:
            out.write(code)
        out.write(struct.pack(_FOOTER, len(lengths), int(bounds[-1]), tok.dtype.itemsize, len(codes[0]),
                              len(codes[1]), low, len(lengths) - len(known)))
        out.write(MAGIC)
        size = out.tell()
        out.close()
        yield pd.DataFrame({"part": [part], "path": [f"{path.rstrip('/')}/{name}"], "n_docs": [len(lengths)],
                            "n_ids": [int(bounds[-1])], "n_bytes": [size]})

    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count_rows(docs) / docs_per_file))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("_text"))
    tie = F.xxhash64("_text")
    ordered = (rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), tie)
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "_text"))
    return freeze(ordered.mapInPandas(write, MANIFEST), "token-manifest")


def with_first_ids(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first_id``: ids in all earlier files (one row per file)."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).cast("long"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` of every document.

    Ids are read in blocks of whole documents of about ``READ_IDS`` ids.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, first in zip(batch["path"], batch["first_id"]):
                f = TokenFile(uri)
                bounds, doc_ids = f.boundaries.decode().astype(np.int64), f.doc_ids()
                i = 0
                while i < f.n_docs:
                    stop = max(i + 1, int(np.searchsorted(bounds, bounds[i] + READ_IDS, side="right")) - 1)
                    ids = f.ids(int(bounds[i]), int(bounds[stop])).astype("<u4")
                    cut = bounds[i:stop + 1] - bounds[i]
                    yield pd.DataFrame({
                        "doc_id": pd.array(doc_ids[i:stop], dtype="Int64"), "start": bounds[i:stop] + first,
                        "n_tokens": np.diff(cut),
                        "ids_crc32": [zlib.crc32(ids[x:y]) for x, y in zip(cut, cut[1:])]})
                    i = stop
                f.close()

    files = with_first_ids(manifest)
    return files.repartition(max(1, manifest.count()), "part").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Packing by power-of-two decomposition.

Each document's ids (an end id after its text's ids) are cut into as many
pieces of the longest length as fit, then into the binary digits of the rest,
longest first: 5,000 ids make 2048 + 2048 + 512 + 256 + 128 + 8. Every piece is
a sequence of its own, so no sequence crosses documents and none is padded.
Sequences of equal length share a bucket, and a batch drawn from one bucket is
rectangular; ``write_buckets`` lays the buckets out as folders.

The work is one pass over the scan: no shuffle, and memory follows one slice of
an Arrow batch (one text at least).

Defined results: a null or empty text is one piece that holds the end id. Rows
are packed one by one, so repeated rows (or doc_ids, or a null doc_id) each get
their own sequences. An empty table gives no rows. Extra columns are
dropped, whatever their names: only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertforge.llm.common import text_of
from alertforge.llm.tokens import ID_SLICE_CHARS, VOCABULARY, slices, tokenizer

MAX_LENGTH = 2048
END_ID = 1


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` ids: powers of two, longest first."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, longest: int = MAX_LENGTH,
                   end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, bucket, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit ids; ``bucket`` is log2 of the length.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, doc_ids = batch["_text"].tolist(), batch["doc_id"].tolist()
            for a, b in slices(texts, ID_SLICE_CHARS):
                out = []
                for doc_id, code in zip(doc_ids[a:b], tok.ids(texts[a:b])):
                    data = np.frombuffer(code, tok.dtype).astype("<u4").tobytes() + end
                    total, start = len(data) // 4, 0
                    for n in piece_lengths(total, longest):
                        out.append((doc_id, start, n, n.bit_length() - 1, data[4 * start:4 * (start + n)], total))
                        start += n
                pieces = pd.DataFrame(out, columns=["doc_id", "start", "length", "bucket", "ids", "doc_tokens"])
                pieces["doc_id"] = pieces["doc_id"].astype("Int64")
                yield pieces

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("_text"))
    pieces = rows.mapInPandas(
        pack, "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long")
    # a piece is a whole sequence: a unique id needs no exchange
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(),
                               "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length; each holds equal-length sequences only."""
    pieces.write.partitionBy("bucket").parquet(path)

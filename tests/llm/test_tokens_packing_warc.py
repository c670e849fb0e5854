"""Token files, packing and archives: exact round trips."""
import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertforge.llm import eliasfano, packing, tokenfiles, tokens, warc

TEXTS = [
    None, "", "  \n\t ", "a<|endoftext|>b It's we'll naïve café 3.14 don't! --- 's ß ÿ Ÿ", "İstanbul ΣΑΣ Σ. é x\x1cy",
    "日本語 ½ ª, Ñandú; .,. a,b;c:", "A" * 3000 + ". " + "é" * 100, "the quick brown fox. " * 900, "ab\xa0cd ef",
]


def encode(text):
    from tokenizers import Tokenizer
    if not hasattr(encode, "t"):
        encode.t = Tokenizer.from_file(tokens.vocabulary_path())
    return encode.t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=1500))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    code = eliasfano.EliasFano(eliasfano.encode(np.array(values, dtype=np.uint64)))
    assert code.decode().tolist() == values and len(code) == len(values)
    for i in range(0, len(values), 97):
        assert code.select(i) == values[i]


def test_elias_fano_space_and_repeats():
    x = np.cumsum(np.full(100_000, 300)).astype(np.uint64)
    assert len(eliasfano.encode(x)) * 8 < 100_000 * 11.5  # 2 + log2(300) bits and the directory
    same = eliasfano.EliasFano(eliasfano.encode(np.full(2000, 7)))
    assert [same.select(i) for i in (0, 511, 512, 1999)] == [7] * 4
    with pytest.raises(ValueError):
        eliasfano.encode(np.array([2, 1]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abÀéßñσΣIi'stve019.,! \n\t\xa0\x1c日́<|>-"), max_size=40), max_size=6))
def test_chunked_ids_equal_whole_text_ids(texts):
    tok = tokens.tokenizer()
    for text, code in zip(texts, tok.ids(texts)):
        assert np.frombuffer(code, tok.dtype).tolist() == encode(text)


PIECES = ["the", "Haus", "ñandú", "ESTH", "ª", "µ", "ß", "Σ", "3", "don't", "***", "$$$", ",&&&", "!!", "'s", "-", "<|endoftext|>",
          "<|", "\u0301", "\u0338", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2028", "a" * 70, "*" * 70]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=6))
def test_ids_of_words_with_marks_equal_whole_text_ids(texts):
    tok = tokens.tokenizer()
    for text, code in zip(texts, tok.ids(texts)):
        assert np.frombuffer(code, tok.dtype).tolist() == encode(text)


class Spy:
    """A tokenizer that notes what it encodes."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def encode(self, text, **options):
        self.seen.append(text)
        return self.inner.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.seen.extend(texts)
        return self.inner.encode_batch_fast(texts, **options)


def test_words_are_encoded_once_whatever_marks_follow():
    """Patterns and normal forms are for marks and odd chunks; a word goes past them, alone, once."""
    tok, patterned, plain = tokens.ChunkTokenizer(tokens.VOCABULARY), [], []
    tok._tokenizer = Spy(tok._tokenizer, patterned)
    if hasattr(tok, "_word_tokenizer"):
        tok._word_tokenizer = Spy(tok._word_tokenizer, plain)
    words, marks = ["the", "Quick", "BROWN", "füchse", "thanan"], ["", ".", "***", "$$$", ",&&&", "!!"]
    texts = [" ".join(w + m for w in words) for m in marks] * 2
    for text, code in zip(texts, tok.ids(texts[:3]) + tok.ids(texts[3:])):
        assert np.frombuffer(code, tok.dtype).tolist() == encode(text)
    assert sorted(patterned) == sorted(marks[1:])
    assert sorted(" ".join(plain).split()) == sorted(w.lower() for w in words)


def test_vocabulary_of_other_rules_gets_whole_chunks(tmp_dir):
    import json

    from tokenizers import Tokenizer
    with open(tokens.vocabulary_path(), encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"] = {"type": "NFC"}  # case stays
    with open(f"{tmp_dir}/cased.json", "w", encoding="utf-8") as f:
        json.dump(rules, f)
    tok, whole = tokens.ChunkTokenizer(f"{tmp_dir}/cased.json"), Tokenizer.from_file(f"{tmp_dir}/cased.json")
    text = "The the THE*** HAUS, Haus it's 3.14"
    assert np.frombuffer(tok.ids([text])[0], tok.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, part int")


def test_token_files_round_trip(spark, tmp_dir):
    rows = [(i * 3 - 4, t) for i, t in enumerate(TEXTS)] + [(2, "again"), (2, "again"), (None, "no id")]
    manifest = tokenfiles.write_token_files(frame(spark, rows), f"{tmp_dir}/ids", docs_per_file=3)
    got = sorted(((r.doc_id is not None, r.doc_id), r.start, r.n_tokens, r.ids_crc32)
                 for r in tokenfiles.read_documents(manifest).collect())
    assert len(got) == len(rows)
    at = 0
    for (_, doc_id), start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    want = sorted((d is not None, d if d is not None else 0, zlib.crc32(np.array(encode(t) + [2], "<u4").tobytes()))
                  for d, t in rows)
    assert sorted((k[0], k[1] if k[0] else 0, c) for k, _, _, c in got) == want
    starts = [s for _, s, _, _ in got]
    assert starts == sorted(starts)  # ascending doc_id, null first
    f = tokenfiles.TokenFile(manifest.orderBy("part").first().path)
    assert f.document(0).tolist() == f.ids(0, f.boundaries.select(1)).tolist()
    assert tokenfiles.read_documents(tokenfiles.write_token_files(frame(spark, []), f"{tmp_dir}/no")).count() == 0


def test_packing_is_whole_and_unpadded(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "no id")]
    got = packing.pack_documents(frame(spark, rows)).withColumn("crc", F.crc32("ids")).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    by = {}
    for r in got:
        assert r.length == 1 << r.bucket <= 2048 and r.offset == 0 and len(r.ids) == 4 * r.length
        assert r.crc == zlib.crc32(r.ids)
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        if doc_id == 3:
            continue
        pieces = sorted(by[doc_id], key=lambda r: r.start)
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == encode(text) + [1]
    assert len(by[3]) == 2 * len(packing.piece_lengths(len(encode(TEXTS[3])) + 1))
    assert packing.pack_documents(frame(spark, [])).count() == 0
    assert packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]


def test_archives_round_trip(spark, tmp_dir):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 300_000, "<p>\r\n\r\nWARC/1.1\r\n</p>", "<p>é</p>"]
    rows = [(i - 1, None if i == 4 else f"http://a/{i}\r\nx", h, "z") for i, h in enumerate(html)]
    rows += [(None, "u", "<p>é</p>", "z"), (None, "u", "alone", "z"), (1, "again", "<p>é</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    path = f"{tmp_dir}/warc"
    warc.archive_pages(pages, path)
    got = warc.read_archives(spark, path, payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        r = first.get(h or "")
        revisit = r is not None and r != p
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                     "revisit" if revisit else "response", r if revisit else None, None if revisit else b))
    have = [(warc.urn_page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type,
             warc.urn_page(r.refers_to), None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    # predicates reach the reader: only header fields of matching records come back
    df = warc.read_archives(spark, path).where("record_type = 'revisit' and payload_digest is not null")
    assert all(r.payload is None and r.record_type == "revisit" for r in df.collect())
    assert df.count() == sum(w[3] == "revisit" for w in want)
    # any gzip reader sees plain WARC, and such an archive reads back as well
    import glob
    plain = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{path}/*.warc.gz")))
    assert plain.count(b"WARC/1.1\r\nWARC-Type") == len(rows)
    with gzip.open(f"{tmp_dir}/foreign.warc.gz", "wb") as f:
        f.write(plain)
    again = warc.read_archives(spark, f"{tmp_dir}/foreign.warc.gz", payload=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    warc.archive_pages(pages.limit(0), f"{tmp_dir}/none")


def test_reader_skips_unwanted_blocks(tmp_dir):
    """A record that fails the header test is not inflated: a broken block goes unnoticed."""
    good, bad = warc.record_bytes(1, "u", b"payload", None), bytearray(warc.record_bytes(2, "u", b"y" * 500, 1))
    bad[-40:-8] = b"\xff" * 32
    with open(f"{tmp_dir}/a.warc.gz", "wb") as f:
        f.write(bytes(bad) + good)
    rows = list(warc.read_archive(f"{tmp_dir}/a.warc.gz", lambda r: r["record_type"] == "response", True))
    assert [r["payload"] for r in rows] == [b"payload"]

"""Token ids of whole texts with a public vocabulary, Arrow batch by Arrow batch.

The vocabulary never joins characters across white space, so a text's ids are
the concatenated ids of its blank-separated chunks. It parts a letter from a
mark behind it as well, so a blank goes between the two first, and most chunks
are a word or some marks. Arrow kernels split a slice of texts, number its
distinct chunks and lay out their ids; Python sees each distinct chunk of a
slice once. A worker keeps the ids of chunks it has seen; only new chunks go
through the ``tokenizers`` library: words of Latin-1 letters in lower case as
one long text, told apart by the word-end mark of their last token. They are
composed and cut already, so that text skips the vocabulary's normalizer and
patterns. A vocabulary of other rules, and a text that holds one of its added
tokens, are not parted at marks. The store is emptied when full, which changes
speed alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
MAX_CHUNKS = 1_000_000
MAX_CACHED_CHUNK = 64
WORD_END = "</w>"  # FIXED VALUE: the mark of a word's last token
BATCH_CHARS = 1_000_000
ID_SLICE_CHARS = 2_000_000  # larger slices repeat fewer distinct chunks
# FIXED VALUES: a Latin-1 letter and a mark (no apostrophe), and the rules that part the two and by which
# a lower-case Latin-1 word is its own normal form.
LETTER_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
            "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Path of a vocabulary: a path as it is, else a name among the installed public files."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class ChunkTokenizer:
    """``ids(texts)``: little-endian ids of each text as bytes, ``width`` bytes an id."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self._tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        marks = [t.endswith(WORD_END) for t, _ in sorted(self._tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self._ends_word = np.array(marks)
        self._known: dict[str, bytes] = {}
        with open(vocabulary_path(vocabulary), encoding="utf-8") as f:
            rules = json.load(f)
        added = rules.get("added_tokens", [])
        self._added = [t["content"] for t in added]
        self._parts_marks = (all(rules.get(k) == v for k, v in WORD_RULES.items())
                             and not any(t["normalized"] or t["content"].isalpha() for t in added))
        self._word_tokenizer = Tokenizer(self._tokenizer.model)
        self._word_tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.CharDelimiterSplit(" "),
            pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])

    def _encode(self, chunks: list[str]) -> list[bytes]:
        codes = self._tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in codes]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters only, encoded as one text."""
        text, = self._word_tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(text.ids, dtype=self.dtype)
        ends = np.flatnonzero(self._ends_word[ids]) + 1
        if len(ends) != len(words):  # some word is not one word to the vocabulary
            return self._encode(words)
        data, stops = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of new chunks, in their order; lower-case words are kept."""
        known, words, other = self._known, {}, []
        for i, c in enumerate(new):
            # Latin-1 letters: composed already, and their lower case is one letter
            if self._parts_marks and c.isalpha() and len(c) <= MAX_CACHED_CHUNK and (c.isascii() or max(c) <= "\xff"):
                words[i] = c.lower()
            else:
                other.append(i)
        missing = list(set(words.values()).difference(known))
        known.update(zip(missing, self._encode_words(missing)))
        codes: list[bytes] = [b""] * len(new)
        for i, word in words.items():
            codes[i] = known[word]
        for i, code in zip(other, self._encode([new[i] for i in other])):
            codes[i] = code
        return codes

    def _codes(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, known or new."""
        known = self._known
        if len(known) > MAX_CHUNKS:
            known.clear()
        codes = list(map(known.get, chunks))
        places = [i for i, code in enumerate(codes) if code is None]
        new = [chunks[i] for i in places]
        for i, chunk, code in zip(places, new, self._learn(new)):
            codes[i] = code
            if len(chunk) <= MAX_CACHED_CHUNK:
                known[chunk] = code
        return codes

    def _parted(self, texts: pa.Array) -> pa.Array:
        """The texts with a blank between a letter and a mark behind it."""
        if not self._parts_marks:
            return texts
        parted = pc.replace_substring_regex(texts, LETTER_MARK, r"\1 \2")
        for token in self._added:
            found = pc.match_substring(texts, token)
            if pc.any(found).as_py():
                parted = pc.if_else(found, texts, parted)
        return parted

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; memory follows the texts given, so callers pass slices."""
        chunks = pc.ascii_split_whitespace(self._parted(pa.array(texts, pa.large_string())))
        coded = pc.dictionary_encode(chunks.values)
        codes = pa.array(self._codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        placed = codes.take(coded.indices)
        _, offsets, data = placed.buffers()
        if data is None:
            return [b""] * len(texts)
        ends = np.frombuffer(offsets, np.int64)[:len(placed) + 1][chunks.offsets.to_numpy()].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY) -> ChunkTokenizer:
    """The worker's tokenizer."""
    return ChunkTokenizer(vocabulary)


def slices(texts: list[str], limit: int = BATCH_CHARS) -> Iterable[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)

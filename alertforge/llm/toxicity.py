"""Toxic spans by a linear-chain conditional random field.

Two states (clean, toxic) over a document's words. A word's emission score is
the sum of the weights of its features (the word and its prefixes of 4 to 6
letters, lower case); transitions and the start have weights of their own.
Forward-backward gives each word's marginal; a document's score is a logistic
function of the largest marginal, their sum and their share of the words.

*Fit* (on the driver, bounded): at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN``
clean labelled documents of at most ``MAX_FIT_WORDS`` words, drawn by a hash of
doc_id among rows the caller allows. Words are labelled from the documents'
labels: in a toxic document, those whose features are over-represented in toxic
documents; everything in clean ones is clean. Copies of a sampled text count once. Weights are fitted by gradient
ascent on the conditional likelihood, with exact marginals. Clean documents
count by the inverse of their sampling rate, so scores are calibrated to the
labelled share.

*Scoring* covers every whole text in one pass over the scan: no shuffle, and
memory follows a slice of a batch. The chain of a slice is evaluated in blocks:
2 x 2 products per block, a carry across blocks, then all blocks at once, which
is the exact recursion in another order.

Defined results: null, empty and blank texts have no words and get the score
of zero evidence. Equal texts get equal scores. Without labels of both kinds
(or any word that tells them apart) every score is 0. Repeated rows are scored each; a null doc_id is not held
out. Conflicting labels of a doc_id count as toxic. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertforge.llm.common import n_words_of, text_of
from alertforge.llm.tokens import slices

MAX_TOXIC, MAX_CLEAN, MAX_FIT_WORDS = 1500, 2500, 5000
MAX_FEATURES = 20_000
MIN_DOCS = 2
LABEL_LOG_ODDS = 2.5
PREFIXES = (4, 5, 6)
SPAN_MARGINAL = 0.5
BLOCK = 64

_PUNCTUATION = str.maketrans({c: " " for c in ".,;:!?\"()[]{}…«»“”¡¿*#%&$|<>"})


def split_words(text: str) -> list[str]:
    return text.translate(_PUNCTUATION).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code point offsets of ``split_words(text)``."""
    return [m.span() for m in re.finditer(r"\S+", text.translate(_PUNCTUATION))]


def word_features(word: str) -> list[str]:
    w = word.lower()
    return [w] + [f"{w[:n]}*" for n in PREFIXES if len(w) > n]


def _scan(scores: np.ndarray, first: np.ndarray, m00: float, m01: float, m10: float, m11: float,
          start: float) -> np.ndarray:
    """r_t = e_t (m01 + m11 r) / (m00 + m10 r) with r of t - 1; e_t * start where ``first``."""
    n = len(scores)
    columns = -(-n // BLOCK)
    e = np.ones(columns * BLOCK)
    e[:n] = np.exp(np.clip(scores, -30, 30))
    reset = np.zeros(columns * BLOCK, dtype=bool)
    reset[:n] = first
    e, reset = e.reshape(columns, BLOCK).T, reset.reshape(columns, BLOCK).T
    # product of the block's maps r -> (b + d r) / (a + c r)
    a, b, c, d = np.ones(columns), np.zeros(columns), np.zeros(columns), np.ones(columns)
    for k in range(BLOCK):
        na, nc = m00 * a + m10 * b, m00 * c + m10 * d
        nb, nd = e[k] * (m01 * a + m11 * b), e[k] * (m01 * c + m11 * d)
        z = reset[k]
        if z.any():
            na, nb = np.where(z, 1.0, na), np.where(z, e[k] * start, nb)
            nc, nd = np.where(z, 0.0, nc), np.where(z, 0.0, nd)
        top = np.maximum(np.maximum(na, nb), np.maximum(nc, nd))
        a, b, c, d = na / top, nb / top, nc / top, nd / top
    carry, r = np.empty(columns), 1.0
    for j, (aj, bj, cj, dj) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        carry[j] = r
        r = min(max((bj + dj * r) / max(aj + cj * r, 1e-300), 1e-100), 1e100)
    out = np.empty((BLOCK, columns))
    r = carry
    for k in range(BLOCK):
        r = np.where(reset[k], e[k] * start, e[k] * (m01 + m11 * r) / (m00 + m10 * r))
        r = np.clip(r, 1e-100, 1e100)
        out[k] = r
    return out.T.reshape(-1)[:n]


@dataclass
class Crf:
    """Parameters; ``t`` holds the log potentials of 0-1, 1-0 and 1-1 (0-0 is 0)."""

    weights: dict[str, float]
    bias: float
    start: float
    t: tuple[float, float, float]

    def messages(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward ratio, backward ratio and marginal of the toxic state per word."""
        t01, t10, t11 = np.exp(self.t)
        r = _scan(scores, first, 1.0, t01, t10, t11, float(np.exp(self.start)))
        # backwards x_t = e_t b_t and b_t = (t10 + t11 x) / (1 + t01 x): the same scan with the matrix transposed
        last = np.append(first[1:], True)
        x = _scan(scores[::-1], last[::-1], 1.0, t10, t01, t11, 1.0)[::-1]
        e = np.exp(np.clip(scores, -30, 30))
        b = x / e
        odds = r * b
        return r, b, odds / (1.0 + odds)

    def word_score(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in word_features(word))


def evidence(marginals: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: largest marginal, log of their sum, share of the words."""
    n = np.bincount(doc, minlength=n_docs)
    total = np.bincount(doc, weights=marginals, minlength=n_docs)
    largest = np.zeros(n_docs)
    np.maximum.at(largest, doc, marginals)
    return np.stack([largest, np.log1p(total), np.sqrt(total / np.maximum(n, 1))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class ToxicityModel:
    crf: Crf
    head: np.ndarray  # intercept and one weight per evidence column

    def scores(self, ev: np.ndarray) -> np.ndarray:
        return _sigmoid(self.head[0] + ev @ self.head[1:])


def _lexicon(docs: list[list[str]], toxic: np.ndarray) -> dict[str, float]:
    """Log odds of features that toxic documents hold more often than chance allows.

    A feature stays if its split between toxic and clean documents has a log
    likelihood gain over the overall split of at least the logarithm of the
    number of features tried, so that none is expected to pass by luck.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    counts = (Counter(), Counter())
    for words, is_toxic in zip(docs, toxic):
        counts[int(is_toxic)].update({f for w in set(words) for f in word_features(w)})
    names = [f for f, k in counts[1].items() if k >= MIN_DOCS]
    k1 = np.array([counts[1][f] for f in names], dtype=float)
    k0 = np.array([counts[0][f] for f in names], dtype=float)
    gain = k1 * np.log(k1 / (k1 + k0) * (n1 + n0) / n1)
    gain += k0 * np.log(np.maximum(k0, 1e-9) / (k1 + k0) * (n1 + n0) / n0)
    odds = np.log((k1 + 0.1) / (n1 - k1 + 1.0)) - np.log((k0 + 0.1) / (n0 - k0 + 1.0))
    passed = np.flatnonzero((gain >= np.log(max(len(names), 2))) & (odds >= 1.0))
    best = sorted(passed, key=lambda i: (-gain[i], names[i]))[:MAX_FEATURES]
    return {names[i]: float(odds[i]) for i in best}


def _originals(docs: list[list[str]]) -> list[int]:
    """Indexes of the documents that are no copy of an earlier one.

    Copies share most of their 16 smallest hashes of word triples; a word of a
    much copied text would otherwise pass for one that many texts chose.
    """
    holders: dict[int, list[int]] = {}
    keep = []
    for i, words in enumerate(docs):
        triples = {zlib.crc32(" ".join(words[k:k + 3]).encode()) for k in range(max(1, len(words) - 2))}
        sketch = sorted(triples)[:16]
        shared = Counter(j for h in sketch for j in holders.get(h, ()))
        if shared and max(shared.values()) * 4 >= len(sketch):
            continue
        keep.append(i)
        for h in sketch:
            holders.setdefault(h, []).append(i)
    return keep


def fit(texts: list[str], labels: list[int], clean_weight: float = 1.0, steps: int = 40) -> ToxicityModel | None:
    """Fit CRF and document head; None without both labels or any telling feature."""
    docs = [split_words(t) for t in texts]
    used = [i for i in _originals(docs) if docs[i]]
    docs, toxic = [docs[i] for i in used], np.array([labels[i] == 1 for i in used], dtype=bool)
    if not len(docs) or toxic.all() or not toxic.any():
        return None
    odds = _lexicon(docs, toxic)
    if not odds:
        return None
    index = {f: i for i, f in enumerate(odds)}
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for d in docs for w in d])
    sizes = np.array([len(d) for d in docs])
    doc = np.repeat(np.arange(len(docs)), sizes)
    first = np.zeros(len(word), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    # (word, feature) incidence
    pairs = [(v, index[f]) for w, v in vocabulary.items() for f in word_features(w) if f in index]
    pw = np.array([p[0] for p in pairs], dtype=np.int64)
    pf = np.array([p[1] for p in pairs], dtype=np.int64)
    strength = np.array(list(odds.values()))
    best = np.full(len(vocabulary), -np.inf)
    np.maximum.at(best, pw, strength[pf])
    y = toxic[doc] & (best[word] >= LABEL_LOG_ODDS)
    # pairs of neighbours inside a document
    inner = np.flatnonzero(~first)
    seen = np.array([np.sum(~y[inner - 1] & y[inner]), np.sum(y[inner - 1] & ~y[inner]), np.sum(y[inner - 1] & y[inner])])
    share = max(y.mean(), 1e-4)
    # features share a word's evidence; unseen transitions start from the word share
    theta = np.concatenate([0.3 * strength, [np.log(share), np.log(share), 0.0, 0.0, 0.0]])
    n_f = len(odds)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        crf = Crf({}, float(theta[n_f]), float(theta[n_f + 1]), tuple(theta[n_f + 2:]))
        by_word = np.bincount(pw, weights=theta[:n_f][pf], minlength=len(vocabulary)) + crf.bias
        scores = by_word[word]
        r, b, p = crf.messages(scores, first)
        left, right = r[inner - 1], (np.exp(np.clip(scores, -30, 30)) * b)[inner]
        t01, t10, t11 = np.exp(crf.t)
        parts = np.stack([right * t01, left * t10, left * right * t11])
        parts = (parts / (1.0 + parts.sum(axis=0))).sum(axis=1)
        miss = y - p
        by_word = np.bincount(word, weights=miss, minlength=len(vocabulary))
        grad = np.concatenate([np.bincount(pf, weights=by_word[pw], minlength=n_f) - 0.05 * theta[:n_f],
                               [miss.sum(), miss[first].sum()], seen - parts])
        grad /= len(docs)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    crf = Crf({f: float(theta[i]) for f, i in index.items()}, float(theta[n_f]), float(theta[n_f + 1]),
              tuple(float(x) for x in theta[n_f + 2:]))
    by_word = np.bincount(pw, weights=theta[:n_f][pf], minlength=len(vocabulary)) + crf.bias
    ev = evidence(crf.messages(by_word[word], first)[2], doc, len(docs))
    return ToxicityModel(crf, _logistic(ev, toxic, np.where(toxic, 1.0, clean_weight)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps, intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = _sigmoid(x @ beta)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
    return beta


def fit_on(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic) and their documents."""
    marks = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def draw(value: int, most: int) -> DataFrame:
        return marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    chosen = draw(1, MAX_TOXIC).unionByName(draw(0, MAX_CLEAN))  # at most 4,000 rows
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
              .join(F.broadcast(chosen), "doc_id").where(n_words_of(F.col("text")) <= MAX_FIT_WORDS)
              .dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect())
    sample.sort(key=lambda r: r["doc_id"])
    rate = min(1.0, MAX_CLEAN / max(totals.get(0, 0), 1)) / min(1.0, MAX_TOXIC / max(totals.get(1, 0), 1))
    return fit([r["text"] for r in sample], [r["toxic"] for r in sample], 1.0 / rate)


class _Scores(dict):
    """Word scores, computed once per word; emptied by the caller when large."""

    def __init__(self, crf: Crf) -> None:
        super().__init__()
        self._crf = crf

    def __missing__(self, word: str) -> float:
        self[word] = s = self._crf.word_score(word)
        return s


def score_documents(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``doc_id, score, spans`` per row: spans are code point offsets of toxic runs with their marginal."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Scores(model.crf) if model else None
        for batch in batches:
            texts, ids = batch["_text"].tolist(), batch["doc_id"].astype("Int64")
            for a, b in slices(texts):
                out = pd.DataFrame({"doc_id": ids.iloc[a:b].array, "score": 0.0, "spans": [[] for _ in range(b - a)]})
                if model:
                    if len(known) > 300_000:
                        known.clear()
                    split = [split_words(t) for t in texts[a:b]]
                    sizes = np.array([len(s) for s in split])
                    scores = np.array([known[w] for s in split for w in s])
                    doc = np.repeat(np.arange(b - a), sizes)
                    marginal = np.zeros(0)
                    if len(scores):
                        first = np.zeros(len(scores), dtype=bool)
                        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
                        marginal = model.crf.messages(scores, first)[2]
                    out["score"] = model.scores(evidence(marginal, doc, b - a))
                    ends = np.cumsum(sizes)
                    for i in np.unique(doc[marginal >= SPAN_MARGINAL]):
                        out.at[int(i), "spans"] = _spans(texts[a + i], marginal[ends[i] - sizes[i]:ends[i]])
                yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("_text"))
    return rows.mapInPandas(
        score, "doc_id long, score double, spans array<struct<start:int,stop:int,marginal:double>>")


def _spans(text: str, marginal: np.ndarray) -> list[dict]:
    """Runs of words at or above the span marginal."""
    out: list[dict] = []
    offsets = word_offsets(text)
    last = -2
    for i in np.flatnonzero(marginal >= SPAN_MARGINAL):
        if i == last + 1:
            out[-1]["stop"] = offsets[i][1]
            out[-1]["marginal"] = max(out[-1]["marginal"], float(marginal[i]))
        else:
            out.append({"start": offsets[i][0], "stop": offsets[i][1], "marginal": float(marginal[i])})
        last = i
    return out

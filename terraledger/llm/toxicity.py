"""Toxic spans with a linear-chain conditional random field, learned from document labels.

A token is clean or toxic. A toxic one has a weight that is the sum of those of its features: the word,
its beginnings and end, its shape, and the words beside it; features are 32-bit hashes. A document is
toxic if any token of it is, so its likelihood is 1 - Z(all clean) / Z, or Z(all clean) / Z if it is
clean, and forward-backward gives Z and its gradient: no token is labelled by hand or by a list. The
weights of features and transitions are fitted together by maximum likelihood.

Features are first counted over the labelled documents on the executors, copies and near copies once;
those that toxic documents have more often than clean ones take part, weak ones too: the chain weighs
them. All other tokens share one weight, so between tokens with features the chain's 2 x 2 matrix is
raised to a power, in closed form: marginals are exact and a text costs time only for such tokens.
A document's score is the probability that any token is toxic, from the same forward pass; tokens with
a marginal of OFFENDING or more are the offending spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning
from .runtime import text_or_empty, written
from .textstats import windows

#: Labelled rows that a model is fitted on, at most, and features that it has, at most (those of the strongest evidence).
SAMPLE, MOST_FEATURES = 12_000, 20_000
#: Log of the chance at which a feature's documents would be so toxic, as far as which it takes part.
WEAK = np.log(1e-6)
#: Documents that share as many of their least shingles are one family.
SHINGLES, SHARED = 8, 4
#: Marginal from which a token belongs to an offending span.
OFFENDING = 0.5
#: What a weight is held back by, steps of the fit and their size.
RIDGE, STEPS, RATE = 0.004, 120, 0.25
WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text)


def _id(kind: str, what: str) -> int:
    return zlib.crc32(f"{kind}:{what}".encode("utf-8", "surrogatepass"))


def own_features(word: str) -> list[int]:
    """Of a token as written: the word, beginnings of 4 and 5 letters, the last 4, and its shape if it is not plain."""
    low = word.lower()
    out = [_id("w", low)]
    if len(low) > 4:
        out += [_id("b4", low[:4]), _id("e4", low[-4:])]
    if len(low) > 5:
        out.append(_id("b5", low[:5]))
    if len(word) > 1 and word.isupper():
        out.append(_id("shape", "capitals"))
    return out


def beside(word: str) -> tuple[int, int]:
    """What a word gives to the token after it, and to the one before it."""
    low = word.lower()
    return _id("after", low), _id("before", low)


def document_features(words: list[str]) -> np.ndarray:
    """Distinct features of a document's tokens."""
    kinds = set(words)
    out = {f for w in kinds for f in own_features(w)}
    for w in {w.lower() for w in kinds}:
        out.update(beside(w))
    return np.fromiter(out, np.int64, len(out))


# ---------------------------------------------------------------- the chain


@dataclass(frozen=True)
class Model:
    """Weights of features, that of tokens without any, and log transition weights to clean and toxic from each (clean to clean is 0)."""

    weights: dict[int, float]
    other: float = -12.0
    into: float = 0.0
    stay: float = 0.0
    back: float = 0.0

    def tagger(self) -> Tagger:
        return Tagger(self)


def _gaps(theta: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrices, logs): exp(log) * matrix is the product over so many tokens without features, transition before each.

    By the eigenvalues of the 2 x 2 matrix, so for any length alike.
    """
    other, into, stay, back = theta
    a, b, c, d = 1.0, np.exp(into + other), np.exp(back), np.exp(stay + other)
    mean, off = (a + d) / 2, np.sqrt(((a - d) / 2) ** 2 + b * c)
    high, low = mean + off, mean - off
    n = lengths.astype(float)[:, None, None]
    m, one = np.array([[a, b], [c, d]]), np.eye(2)
    first, second = (m - low * one) / (high - low), (high * one - m) / (high - low)
    ratio = low / high
    power = np.where(n > 0, np.sign(ratio) ** (n % 2) * np.abs(ratio) ** n, 1.0)
    return first + power * second, lengths * np.log(high)


def _step(theta: np.ndarray) -> np.ndarray:
    return np.exp(np.array([[0.0, theta[1]], [theta[3], theta[2]]]))


class Tagger:
    """A model at work on one text at a time."""

    def __init__(self, model: Model):
        self.model, self.theta = model, np.array([model.other, model.into, model.stay, model.back])
        self.step = _step(self.theta)
        self.known: dict[str, tuple[float, float, float] | None] = {}
        self.cache: dict[int, tuple[np.ndarray, float]] = {}

    def parts(self, word: str) -> tuple[float, float, float] | None:
        """Weight of the word's own features, and what it gives to the tokens after and before it; none without any."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            w = self.model.weights
            after, before = beside(word)
            own = [w[f] for f in own_features(word) if f in w]
            some = own or after in w or before in w
            self.known[word] = (sum(own) if own else np.nan, w.get(after, np.nan), w.get(before, np.nan)) if some else None
        return self.known[word]

    def weighted(self, words: list[str]) -> dict[int, float]:
        """Tokens with features, by position: the sum of their weights and that of any token."""
        out: dict[int, float] = {}
        if not self.model.weights:
            return out
        hits = {w for w in set(words) if self.parts(w) is not None}
        if not hits:
            return out
        for i, w in enumerate(words):
            if w in hits:
                own, after, before = self.parts(w)
                for at, x in ((i, own), (i + 1, after), (i - 1, before)):
                    if x == x and 0 <= at < len(words):
                        out[at] = out.get(at, self.model.other) + x
        return dict(sorted(out.items()))

    def gap(self, n: int) -> tuple[np.ndarray, float]:
        if n not in self.cache:
            m, log = _gaps(self.theta, np.array([n]))
            self.cache[n] = m[0], float(log[0])
        return self.cache[n]

    def run(self, words: list[str], marginals: bool = True) -> tuple[float, dict[int, float]]:
        """(probability that any token is toxic, marginals of tokens with features by position)."""
        if not words or not self.model.weights:
            return 0.0, {}
        emit = self.weighted(words)
        at = list(emit)
        alpha, log, before, forward = np.array([1.0, 0.0]), 0.0, -1, []
        for i in at:
            m, more = self.gap(i - before - 1)
            alpha = (alpha @ m @ self.step) * np.array([1.0, np.exp(emit[i])])
            total = alpha.sum()
            alpha, log, before = alpha / total, log + more + np.log(total), i
            forward.append(alpha)
        m, more = self.gap(len(words) - 1 - before)
        beta = m.sum(1)
        score = float(-np.expm1(-(log + more + np.log(alpha @ beta))))
        out: dict[int, float] = {}
        if marginals:
            for k in range(len(at) - 1, -1, -1):
                p = forward[k] * beta
                out[at[k]] = float(p[1] / p.sum())
                if k:
                    m, _ = self.gap(at[k] - at[k - 1] - 1)
                    beta = m @ self.step @ (np.array([1.0, np.exp(emit[at[k]])]) * beta)
                    beta /= beta.sum()
        return min(1.0, max(0.0, score)), out

    def spans(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, offending tokens): start and end in code points of the text, and marginal."""
        words = tokens(text)
        score, got = self.run(words)
        bad = {i: p for i, p in got.items() if p >= OFFENDING}
        if not bad:
            return score, []
        return score, [(m.start(), m.end(), bad[i]) for i, m in enumerate(WORD.finditer(text)) if i in bad]


# ---------------------------------------------------------------- learning


def families(shingles: list[list[int]]) -> list[int]:
    """A number for each document, alike for copies and near copies: those that share SHARED of their SHINGLES least shingles, or half of fewer."""
    parent = list(range(len(shingles)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[int, int] = {}
    for i, grams in enumerate(shingles):
        shared: dict[int, int] = {}
        for g in grams:
            if g in first:
                shared[first[g]] = shared.get(first[g], 0) + 1
        for j, n in shared.items():
            if n >= min(SHARED, -(-len(grams) // 2)):
                a, b = find(j), find(i)
                parent[max(a, b)] = min(a, b)
        for g in grams:
            first.setdefault(g, i)
    return [find(i) for i in range(len(shingles))]


def least_shingles(words: list[str]) -> list[int]:
    """The least hashes of the document's 5-word shingles (of all its words, where there are fewer)."""
    if not words:
        return []
    h = np.array([_id("w", w.lower()) for w in words], np.uint64)
    return np.unique(windows(h, min(5, len(h))))[:SHINGLES].view(np.int64).tolist()


def tail(k: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Log of a bound on the chance of k or more of n at that rate (Chernoff's); 0 where k is not above it."""
    share = k / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0)
        out = -n * (share * np.log(share / rate) + rest)
    return np.where(share > rate, out, 0.0)


def fit(features: np.ndarray, docs: list[tuple[int, np.ndarray, list[np.ndarray]]], y: np.ndarray, share: np.ndarray) -> Model:
    """The model of greatest likelihood. docs: (tokens, positions of tokens with features, indexes of their features)."""
    order = sorted(range(len(docs)), key=lambda i: len(docs[i][1]))
    n = len(features)
    theta = np.concatenate([np.zeros(n), [-9.0, 0.0, 1.0, 0.0]])  # other, into, stay, back
    groups = []
    for at in range(0, len(order), 1024):  # documents of about as many tokens with features together
        rows = order[at : at + 1024]
        width = max(len(docs[i][1]) for i in rows)
        gap, tok = np.zeros((len(rows), width + 1), np.int64), np.full((len(rows), width), -1)
        flat, owner = [], []
        for r, i in enumerate(rows):
            length, pos, feats = docs[i]
            edges = np.concatenate([[-1], pos, [length]])
            gap[r, : len(pos) + 1] = np.diff(edges) - 1
            for j, f in enumerate(feats):
                tok[r, j] = len(flat) and owner[-1] + 1
                flat.append(f)
                owner.append(tok[r, j])
        lengths, index = np.unique(gap, return_inverse=True)
        count = np.array([len(f) for f in flat], np.int64)
        groups.append((np.array([len(docs[i][1]) for i in rows]), lengths, index.reshape(gap.shape), tok, np.concatenate(flat) if flat else np.zeros(0, np.int64), np.repeat(np.arange(len(flat)), count), len(flat), y[rows], share[rows]))
    m, v, weight = np.zeros_like(theta), np.zeros_like(theta), share.sum()
    for step in range(1, STEPS + 1):
        grad = np.zeros_like(theta)
        for group in groups:
            grad += _gradient(theta, n, *group)
        grad = grad / weight
        grad[:n] += RIDGE / len(docs) * theta[:n]
        grad[n + 1 :] += RIDGE / 10 * theta[n + 1 :]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta[n:] = np.clip(theta[n:], [-16, -4, -4, -4], [-4, 4, 4, 4])
    return Model({int(f): float(w) for f, w in zip(features, theta[:n])}, *map(float, theta[n:]))


def _gradient(theta, n, size, lengths, index, tok, flat, owner, n_tok, y, share) -> np.ndarray:
    """Of the negative log likelihood of a group of documents."""
    rows, width = tok.shape
    other = theta[n]
    emit = np.bincount(owner, theta[flat], n_tok) + other if n_tok else np.zeros(0)
    e = np.where(tok >= 0, emit[np.maximum(tok, 0)] if n_tok else 0.0, 0.0)
    toxic = np.exp(np.minimum(e, 30.0))
    mats, logs = _gaps(theta[n:], lengths)
    t = _step(theta[n:])
    inner = mats @ t
    alphas, log = np.zeros((rows, width + 1, 2)), np.zeros(rows)
    alphas[:, 0, 0] = 1.0
    for k in range(width):
        a = np.einsum("ri,rij->rj", alphas[:, k], inner[index[:, k]])
        a[:, 1] *= toxic[:, k]
        total = a.sum(1)
        live = k < size
        alphas[:, k + 1] = np.where(live[:, None], a / total[:, None], alphas[:, k])
        log += np.where(live, np.log(total) + logs[index[:, k]], 0.0)
    last = index[np.arange(rows), size]
    end = mats[last].sum(2)
    z = log + logs[last] + np.log((alphas[:, -1] * end).sum(1))
    clean = np.exp(-np.maximum(z, 1e-12))
    # Weight of the expected features: 1 for a clean document, and what makes "any token toxic" likelier for a toxic one.
    factor = share * np.where(y > 0, -clean / np.maximum(1 - clean, 1e-6), 1.0)
    eps, out = 1e-5, np.zeros_like(theta)
    slopes = []
    for i in range(4):
        up, down = theta[n:].copy(), theta[n:].copy()
        up[i] += eps
        down[i] -= eps
        (mu, lu), (md, ld) = _gaps(up, lengths), _gaps(down, lengths)
        scale_u, scale_d = np.exp(lu - logs)[:, None, None], np.exp(ld - logs)[:, None, None]
        slopes.append((((mu * scale_u) @ _step(up) - (md * scale_d) @ _step(down)) / (2 * eps), (mu * scale_u - md * scale_d) / (2 * eps)))
    beta = end / (alphas[:, -1] * end).sum(1, keepdims=True)
    for i, (_, tails) in enumerate(slopes):
        out[n + i] += (factor * np.einsum("ri,rij->r", alphas[:, -1], tails[last]) / (alphas[:, -1] * end).sum(1)).sum()
    pull = np.zeros(n_tok)
    for k in range(width - 1, -1, -1):
        live = k < size
        p = alphas[:, k + 1, 1] * beta[:, 1] / (alphas[:, k + 1] * beta).sum(1)
        g = np.where(live, factor * p, 0.0)
        pull[tok[live, k]] = g[live]
        out[n] += g.sum()
        b = beta.copy()
        b[:, 1] *= toxic[:, k]
        back = np.einsum("rij,rj->ri", inner[index[:, k]], b)
        norm = (alphas[:, k] * back).sum(1)
        for i, (steps, _) in enumerate(slopes):
            out[n + i] += np.where(live, factor * np.einsum("ri,rij,rj->r", alphas[:, k], steps[index[:, k]], b) / norm, 0.0).sum()
        beta = np.where(live[:, None], back / norm[:, None], beta)
    if n_tok:
        out[:n] = np.bincount(flat, pull[owner], n)
    return out


def train(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE) -> Model:
    """Fit on at most at_most labelled documents of the teaching folds. Without toxic evidence every score is 0.

    Texts stay on the executors. The driver gets, of each labelled document, its least shingles and the
    places of its tokens with features; features are counted there and only those of evidence come back.
    """
    rows = written(learning.sample(docs, labels, "toxic", at_most), "toxicity-sample")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([least_shingles(tokens(t)) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "y", "s"])

    known = sorted((r.doc_id, r.y, r.s) for r in rows.select("doc_id", "y", "text").mapInArrow(shingled, "doc_id long, y int, s array<long>").toLocalIterator())
    family = families([r[2] for r in known])
    heads = {}  # one document a family and label teaches which features there are
    for (doc, y, _), f in zip(known, family):
        heads.setdefault((f, y > 0), doc)
    n_toxic = sum(toxic for _, toxic in heads)
    if not n_toxic or n_toxic == len(heads):
        return Model({})
    chosen = {doc: toxic for (_, toxic), doc in heads.items()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                got = {True: [np.zeros(0, np.int64)], False: [np.zeros(0, np.int64)]}
                for doc, t in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist()):
                    if doc in chosen:
                        got[chosen[doc]].append(document_features(tokens(t)))
                for toxic, parts in got.items():
                    f, c = np.unique(np.concatenate(parts), return_counts=True)
                    zero = np.zeros(len(c), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(c if toxic else zero), pa.array(zero if toxic else c)], ["f", "toxic", "clean"])

    seen = rows.select("doc_id", "text").mapInArrow(counted, "f long, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = n_toxic / len(heads)
    likely = seen.filter((F.col("toxic") > 1) & (F.col("toxic") > rate * (F.col("toxic") + F.col("clean"))))
    n, k = F.col("toxic") + F.col("clean"), F.col("toxic")
    share = k / n
    chance = -n * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    strong = likely.withColumn("chance", chance).filter(F.col("chance") <= float(WEAK)).orderBy("chance", "f").limit(MOST_FEATURES)
    features = np.array(sorted(r.f for r in strong.select("f").collect()), np.int64)  # MOST_FEATURES numbers at most
    if not len(features):
        return Model({})
    position = {int(f): i for i, f in enumerate(features)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lengths, at, what = [], [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(t)
                found: dict[int, list[int]] = {}
                memo: dict[str, tuple[list[int], list[int], list[int]]] = {}
                for i, w in enumerate(words):
                    if w not in memo:
                        after, before = beside(w)
                        memo[w] = [position[f] for f in own_features(w) if f in position], [position[f] for f in (after,) if f in position], [position[f] for f in (before,) if f in position]
                    for j, fs in zip((i, i + 1, i - 1), memo[w]):
                        if fs and 0 <= j < len(words):
                            found.setdefault(j, []).extend(fs)
                ids.append(doc)
                lengths.append(len(words))
                at.append(sorted(found))
                what.append([found[j] for j in sorted(found)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(what, pa.list_(pa.list_(pa.int32())))], ["doc_id", "n", "at", "f"])

    where = {r.doc_id: r for r in rows.select("doc_id", "text").mapInArrow(placed, "doc_id long, n long, at array<long>, f array<array<int>>").toLocalIterator()}
    size: dict[int, int] = {}
    for f in family:
        size[f] = size.get(f, 0) + 1
    used = [i for i, r in enumerate(known) if where[r[0]].n]
    sparse = [(where[known[i][0]].n, np.array(where[known[i][0]].at, np.int64), [np.array(x, np.int64) for x in where[known[i][0]].f]) for i in used]
    return fit(features, sparse, np.array([known[i][1] for i in used]), np.array([1 / size[family[i]] for i in used]))


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans): spans are (start, end, marginal) of offending words, in code points of the text.

    Every row and whole text; null text counts as empty (score 0, no spans); equal or null ids are
    separate rows; an empty table gives no rows; extra columns are not carried.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model.tagger()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                got = [tagger.spans(t) for t in part.column(1).to_pylist()]
                spans = [[{"start": x[0], "end": x[1], "marginal": x[2]} for x in s] for _, s in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    schema = "doc_id long, score double, spans array<struct<start: int, end: int, marginal: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, spans.

    Null text counts as empty and scores 0; a null doc_id is in the fold of the empty text; rows that
    share an id are separate; without labels of both kinds every score is 0; extra columns are not carried.
    """
    got = tag(docs, train(docs, labels))
    return got.select("doc_id", (learning.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")

"""Toxicity: a linear-chain CRF over tokens, aggregated to documents.

Training sees at most ``TRAIN_TOXIC`` + ``TRAIN_CLEAN`` labelled documents
(the first of each class by hash of doc_id; of a text above ``TRAIN_CHARS``
characters as many, in ``TRAIN_PARTS`` random pieces spread over it). Both
classes are counted over all usable labels, and the feature precision and the
logistic layer weigh them by these counts, so the sample's bounds do not move
the 0.5 cut. Token labels come from the document labels: a token of a toxic document
is labelled if one of its features (the word, its prefixes and suffixes)
occurs in toxic documents significantly more often than their share explains,
near copies counted together. On these labels a two-state chain is fitted by
gradient ascent over forward-backward marginals, and a logistic layer turns a
document's marginals into its score.

Scoring covers every token of every document: forward and backward messages
run over pieces of ``PIECE`` tokens, all pieces of a batch at once. A
document's spans are the maximal runs of tokens more likely toxic than not.

Only the text enters a score. Defined results: a null or empty text has no
tokens and gets the score of a document without toxic tokens; rows are scored
one by one, so repeated rows get equal scores; without usable labels of both
classes every score is the share of toxic labels (0 without any); a null
doc_id is never held out; repeated labels of a document count once (toxic
wins); a score of exactly 0.5 is predicted toxic; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import materialise, with_row_key

TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS, TRAIN_PARTS = 1200, 3500, 20_000, 10
# tokens the chain is fitted on, rounds of fitting, clean documents of the logistic layer
FIT_TOKENS, FIT_ROUNDS, LAYER_CLEAN = 100_000, 60, 1500
PIECE = 128
FOLDS = 5
# words whose emission a worker remembers
CACHE_WORDS = 300_000
PRECISION = 0.8

# ASCII letters lower-cased; ASCII other than letters and digits to spaces
_TOKENS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_RUN = re.compile(rb"[^ ]+")


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TOKENS).split()


# parts of a word that are features, besides the word itself
PARTS = {"p3": slice(3), "p4": slice(4), "p5": slice(5), "s4": slice(-4, None)}


def word_features(word: bytes) -> list[tuple[str, str]]:
    """(kind, string) of a word's features."""
    w = word.decode("utf-8", "replace")
    return [("word", w), *((kind, w[part]) for kind, part in PARTS.items())]


def _messages(u: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the forward messages (with each token's own emission) and of
    the backward messages, for pieces in rows of ``u``; a: 2 x 2 log factors."""
    e = np.exp(a)
    step = lambda x, m: np.log((m[0, 1] + m[1, 1] * x) / (m[0, 0] + m[1, 0] * x))
    fwd, bwd = np.empty_like(u), np.zeros_like(u)
    fwd[:, 0] = u[:, 0]
    for t in range(1, u.shape[1]):
        fwd[:, t] = u[:, t] + step(np.exp(np.clip(fwd[:, t - 1], -30, 30)), e)
    for t in range(u.shape[1] - 2, -1, -1):
        bwd[:, t] = step(np.exp(np.clip(u[:, t + 1] + bwd[:, t + 1], -30, 30)), e.T)
    return fwd, bwd


def marginals(u: np.ndarray, a: np.ndarray) -> np.ndarray:
    """P(toxic) of every token; rows of ``u`` are emission log odds of pieces."""
    fwd, bwd = _messages(u, a)
    return _sigmoid(fwd + bwd)


def pair_marginals(u: np.ndarray, a: np.ndarray, fwd: np.ndarray, bwd: np.ndarray) -> np.ndarray:
    """(pieces, tokens - 1, 2, 2): P(states of two neighbours)."""
    left, right = fwd[:, :-1], u[:, 1:] + bwd[:, 1:]
    zero = np.zeros_like(left)
    joint = np.exp(np.clip(np.stack([zero, left], -1), -30, 30)[..., :, None]
                   + np.clip(np.stack([zero, right], -1), -30, 30)[..., None, :] + a)
    return joint / joint.sum(axis=(-1, -2), keepdims=True)


@dataclass
class Model:
    weights: dict[str, dict[str, float]]
    bias: float
    pair: np.ndarray
    layer: np.ndarray | None
    prior: float
    known: dict[bytes, float] = field(default_factory=dict)

    def emission(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        of = self.weights
        whole, parts = of.get("word", {}), [(of.get(kind, {}), part) for kind, part in PARTS.items()]
        for raw in set(words):
            if raw in known:
                continue
            w = raw.decode("utf-8", "replace")
            known[raw] = self.bias + whole.get(w, 0.0) + sum([of.get(w[part], 0.0) for of, part in parts])
        return np.array([known[w] for w in words])

    def token_marginals(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """P(toxic) of each token of each document."""
        sizes = [len(d) for d in docs]
        pieces = [-(-n // PIECE) for n in sizes]
        u = np.full((sum(pieces), PIECE), -30.0)
        flat, first = u.reshape(-1), np.concatenate(([0], np.cumsum(pieces))) * PIECE
        for at, words in zip(first, docs):
            if words:
                flat[at:at + len(words)] = self.emission(words)
        if len(u):
            flat = marginals(u, self.pair).reshape(-1)
        return [flat[at:at + n] for at, n in zip(first, sizes)]

    def score(self, probs: list[np.ndarray]) -> np.ndarray:
        if self.layer is None:
            return np.full(len(probs), self.prior)
        return _sigmoid(aggregate(probs) @ self.layer)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def aggregate(probs: list[np.ndarray]) -> np.ndarray:
    """A document's marginals as the layer's inputs: 1, the log odds of the
    most toxic token, and the logs of the expected number and of the expected
    share of toxic tokens (tokens below 0.02 do not add up to evidence)."""
    top = np.array([p.max() if len(p) else 0.0 for p in probs]).clip(1e-6, 1 - 1e-6)
    mass = np.array([p[p > 0.02].sum() for p in probs])
    share = mass / np.array([max(1, len(p)) for p in probs])
    return np.stack([np.ones(len(probs)), np.log(top / (1 - top)), np.log(0.05 + mass), np.log(1e-3 + share)], 1)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers, by an in-place sort: no table beside them."""
    x = x.reshape(-1)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _copies(ids: list[np.ndarray]) -> np.ndarray:
    """A number for each document that near copies mostly share: the least
    hash of its runs of three words."""
    out = np.empty(len(ids), np.uint64)
    for d, x in enumerate(ids):
        x = np.concatenate([x, x[-1:], x[-1:]]).astype(np.uint64)
        h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
             ^ x[2:] * np.uint64(0x165667B19E3779F9))
        out[d] = (h * np.uint64(0xD6E8FEB86659FD93)).min()
    return np.unique(out, return_inverse=True)[1]


def _toxic_features(words: list[bytes], ids: list[np.ndarray], toxic: np.ndarray, ratio: float) -> tuple[list, list, np.ndarray]:
    """Features met in 3 documents or more, each word's of them, and which are
    significantly toxic (binomial bound on the sample, corrected for the number
    tested) with a precision that holds at the true class sizes; ratio: what a
    toxic document of the sample stands for, in clean ones."""
    names: list[tuple[str, str]] = []
    index: dict[str, dict[str, int]] = {kind: {} for kind in ("word", *PARTS)}

    def number_of(kind: str, string: str) -> int:
        found = index[kind].get(string)
        if found is None:
            found = index[kind][string] = len(names)
            names.append((kind, string))
        return found

    of_word = np.empty((len(words), 1 + len(PARTS)), np.int32)
    for i, w in enumerate(words):
        of_word[i] = [number_of(*f) for f in word_features(w)]
    del index
    group = 2 * _copies(ids) + toxic
    seen = [np.unique(x) for x in ids]
    pairs = _distinct(np.repeat(group, [len(x) for x in seen]) * len(words) + np.concatenate(seen))
    of_group, of_pair = np.divmod(pairs, len(words))
    met = _distinct(of_group[:, None] * len(names) + of_word[of_pair])
    of_group, feature = np.divmod(met, len(names))
    n = np.bincount(feature, minlength=len(names))
    bad = np.bincount(feature[of_group % 2 == 1], minlength=len(names))
    share, precision = np.mean(np.unique(group) % 2), bad / np.maximum(n, 1)
    p = np.clip(precision, 1e-9, 1 - 1e-9)
    bound = n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    tested = max(1, int((n >= 3).sum()))
    true_precision = ratio * bad / np.maximum(ratio * bad + n - bad, 1e-9)
    strong = (true_precision >= PRECISION) & (bound >= np.log(20 * tested)) & (n >= 3)
    kept = np.flatnonzero(n >= 3)
    number = np.full(len(names), -1)
    number[kept] = np.arange(len(kept))
    features = [x[x >= 0] for x in number[of_word]]
    return [names[i] for i in kept], features, strong[kept]


def class_weights(toxic: np.ndarray, totals: tuple[int, int] | None) -> np.ndarray:
    """What a clean and a toxic row of a sample stand for, 1 on average;
    totals: clean and toxic documents there are (None: the sample is all)."""
    n = np.bincount(toxic, minlength=2)
    if totals is None or not n.all() or not all(totals):
        return np.ones(2)
    return np.asarray(totals, float) / n * (n.sum() / sum(totals))


def fit(texts: list[str], toxic: np.ndarray, totals: tuple[int, int] | None = None) -> Model:
    """Fit on labelled texts; totals: the true sizes of both classes."""
    toxic = np.asarray(toxic, int)
    prior = float(toxic.mean()) if len(toxic) else 0.0
    if totals is not None and sum(totals):
        prior = totals[1] / sum(totals)
    weight = class_weights(toxic, totals)
    vocabulary: dict[bytes, int] = {}
    ids, labels = [], []
    for text, label in zip(texts, toxic):
        words = tokens(text)
        if words:
            ids.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
            labels.append(label)
    labels = np.array(labels, int)
    nothing = Model({}, 0.0, np.zeros((2, 2)), None, prior)
    if not len(labels) or labels.min() == labels.max():
        return nothing
    words = list(vocabulary)
    names, of_word, strong = _toxic_features(words, ids, labels, weight[1] / weight[0])
    marked = np.array([strong[x].any() for x in of_word])
    if not marked.any():
        return nothing

    # pieces: those with labelled tokens and as many others as the bound allows
    pieces = [(x[i:i + PIECE], marked[x[i:i + PIECE]] & bool(label))
              for x, label in zip(ids, labels) for i in range(0, len(x), PIECE)]
    hot = [i for i, (_, y) in enumerate(pieces) if y.any()]
    cold = [i for i, (_, y) in enumerate(pieces) if not y.any()]
    rng = np.random.default_rng(0)
    rows = FIT_TOKENS // PIECE
    chosen = [*rng.permutation(hot)[:rows // 2], *rng.permutation(cold)[:rows // 2]]
    w = np.zeros((len(chosen), PIECE), int)
    y, real = np.zeros(w.shape), np.zeros(w.shape, bool)
    for r, i in enumerate(chosen):
        x, mark = pieces[i]
        w[r, :len(x)], y[r, :len(x)], real[r, :len(x)] = x, mark, True

    # the gradient of the log likelihood is observed minus expected counts
    used = np.unique(w[real])
    place = np.zeros(len(words), int)
    place[used] = np.arange(len(used))
    rowed = place[w]
    owner = np.repeat(np.arange(len(used)), [len(of_word[i]) for i in used])
    feats = np.concatenate([of_word[i] for i in used]).astype(int)
    theta, bias, pair = np.zeros(len(names)), -4.0, np.zeros((2, 2))
    speed, total = [np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)], real.sum()
    both = (real[:, 1:] & real[:, :-1])[..., None, None]
    pairs_seen = np.stack([np.stack([(1 - y[:, :-1]) * (1 - y[:, 1:]), (1 - y[:, :-1]) * y[:, 1:]], -1),
                           np.stack([y[:, :-1] * (1 - y[:, 1:]), y[:, :-1] * y[:, 1:]], -1)], -2)
    for _ in range(FIT_ROUNDS):
        score = bias + np.bincount(owner, theta[feats], len(used))
        u = np.where(real, score[rowed], -30.0)
        fwd, bwd = _messages(u, pair)
        diff = np.where(real, y - _sigmoid(fwd + bwd), 0.0)
        by_word = np.bincount(rowed[real], diff[real], len(used))
        gradients = [np.bincount(feats, by_word[owner], len(names)) - 0.02 * theta, by_word.sum(),
                     ((pairs_seen - pair_marginals(u, pair, fwd, bwd)) * both).sum(axis=(0, 1)) - 0.05 * pair]
        speed = [s + (g / total) ** 2 for s, g in zip(speed, gradients)]  # Adagrad
        theta, bias, pair = (v + 1.0 * g / total / np.sqrt(s)
                             for v, g, s in zip((theta, bias, pair), gradients, speed))
    weights: dict[str, dict[str, float]] = {}
    for (kind, string), v in zip(names, theta.tolist()):
        if abs(v) > 1e-3:
            weights.setdefault(kind, {})[string] = v
    model = Model(weights, float(bias), pair, None, prior)

    # the logistic layer, by Newton's method with a small penalty
    some = np.concatenate([np.flatnonzero(toxic), np.flatnonzero(toxic == 0)[:LAYER_CLEAN]])
    probs = [p for i in range(0, len(some), 256)
             for p in model.token_marginals([tokens(texts[j]) for j in some[i:i + 256]])]
    x, beta, toxic = aggregate(probs), np.zeros(4), toxic[some]
    true = totals if totals is not None else (int(np.sum(labels == 0)), int(labels.sum()))
    row_weight = class_weights(toxic, true)[toxic]
    for _ in range(30):
        p = _sigmoid(x @ beta)
        hessian = (x * (row_weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        beta = beta + np.linalg.solve(hessian, x.T @ (row_weight * (toxic - p)) - 0.1 * beta)
    model.layer = beta
    model.known = {}
    return model


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def training_text() -> Column:
    """``text``, or of a long one a random piece of each of its parts."""
    part = F.floor(F.char_length("text") / TRAIN_PARTS).cast("int")
    size = TRAIN_CHARS // TRAIN_PARTS
    pieces = [F.substring(F.col("text"), (part * i + F.pmod(F.xxhash64("rid", F.lit(i)), part - size + 1) + 1).cast("int"), F.lit(size))
              for i in range(TRAIN_PARTS)]
    return F.when(F.char_length("text") <= TRAIN_CHARS, F.col("text")).otherwise(F.concat_ws(" ", *pieces))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, tuple[int, int]]:
    """Texts and labels of a bounded sample outside fold 0, and the sizes of
    both classes there."""
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    fitting = docs.where(F.char_length("text") >= 1).select("doc_id").distinct()
    marks = marks.join(fitting, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    marks = materialise(marks, "toxicity_labels")
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    chosen = (marks.where("toxic = 1").orderBy("h", "doc_id").limit(TRAIN_TOXIC)
              .unionByName(marks.where("toxic = 0").orderBy("h", "doc_id").limit(TRAIN_CLEAN)))
    chosen = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["toxic"]) for r in chosen.collect()],
        f"id {labels.schema['doc_id'].dataType.simpleString()}, toxic int")
    # at most TRAIN_TOXIC + TRAIN_CLEAN ids, so they may be broadcast
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["id"]).select("rid", training_text().alias("text"), "toxic")
    rows = rows.dropDuplicates(["rid"]).orderBy("rid").limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN)).collect()
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], int), (sizes.get(0, 0), sizes.get(1, 0))


def toxic_spans(text: str, probs: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) code point offsets of the runs of toxic tokens."""
    hot = np.flatnonzero(probs > 0.5)
    if not len(hot):
        return []
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _RUN.finditer(re.sub(rb"[\x00-\x20]", b" ", raw.translate(_TOKENS)))]
    chars = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
    return [(chars(places[r[0]][0]), chars(places[r[-1]][1])) for r in runs]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, rid, held_out, score, predicted, spans) of every document."""
    rows = with_row_key(docs)
    model = fit(*training_sample(rows, labels.select("doc_id", "toxic")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the features of the bounded sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part["text"].to_pylist()
                probs = model.token_marginals([tokens(t) for t in texts])
                spans = [[{"start": s, "end": e} for s, e in toxic_spans(t, p)] for t, p in zip(texts, probs)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["rid"], pa.array(model.score(probs)),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "rid", "score", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"doc_id {kind}, rid long, score double, spans array<struct<start:long,end:long>>")
    return scored.select("doc_id", "rid", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")

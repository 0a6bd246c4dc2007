"""Toxic spans by a linear-chain conditional random field, and documents' scores from its marginals.

The field has two states, clean and toxic. It is trained on labelled tokens: in a toxic document those tokens are labelled
toxic whose word, or a prefix of it, marks toxic documents in the training sample (``marks_of``); all others are clean. Features of a token are its word, prefixes and suffix, hashed. The sample is bounded by
``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents, taken from the labelled documents with a text, and ends with the document that
reaches ``SAMPLE_TOKENS`` tokens; scoring reads every whole text.

Defined results: a null or empty text has no tokens and scores what no toxic token scores; documents without labels are only scored; labels with
a null id or class are ignored; of several labels of a document the largest counts; without labels of both classes nothing
is known and every score is 0; extra columns are ignored, and carried by ``drop_toxic``.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_TOKENS = 1000, 2000, 1_500_000
DIMENSIONS = 1 << 16
PREFIXES, SUFFIX = (3, 4, 5, 6, 7, 8), 3
#: A word or prefix can mark toxic tokens if it is in so many toxic documents, and so many times likelier there.
LEAST_DOCS, LIKELIER = 3, 12.0
#: So many of all stems may be taken for marks by chance: they label tokens of toxic documents alone, and the field weighs them
#: against the same stems in clean documents.
BY_CHANCE = 100.0
#: A document is summed up by its so many greatest marginals: their sum, and the greatest.
TOP = 10
CACHE_TOKENS = 400_000
#: Tokens of whole documents whose vectors are held at once.
PIECE_TOKENS = 100_000
_SPACED = re.compile(r"\S+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def word_of(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalnum())


def _stems(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIXES if k > 3 and len(word) >= k)]


def features(word: str) -> list[int]:
    """Hashed features; a token without letters or digits has one of its own."""
    names = ["w" + word, *(f"p{word[:k]}" for k in PREFIXES if len(word) >= k), "s" + word[-SUFFIX:]]
    return [xxhash.xxh32_intdigest(n.encode("utf-8", "surrogatepass")) % DIMENSIONS for n in names]


def _scan(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward vectors (scaled) of many sequences laid end to end; ``first`` marks where each begins.

    Each token is a 2 x 2 matrix, and one that starts a sequence forgets what was before. The tokens are cut into equal runs
    that advance side by side: first the runs' products, then the carry from run to run, then all vectors.
    """
    n = len(e)
    width = max(1, int(np.ceil(np.sqrt(n))))
    runs = -(-n // width)
    pad = runs * width - n
    up = np.exp(np.clip(np.r_[e, np.zeros(pad)], -30, 30)).reshape(runs, width)
    new = np.r_[first, np.zeros(pad, bool)].reshape(runs, width)
    t00 = np.where(new, start[0], trans[0, 0])
    t10 = np.where(new, start[0], trans[1, 0])
    t01 = np.where(new, start[1], trans[0, 1]) * up
    t11 = np.where(new, start[1], trans[1, 1]) * up
    p = [np.ones(runs), np.zeros(runs), np.zeros(runs), np.ones(runs)]  # columns: from state 0 to (0, 1), from state 1 to (0, 1)
    for k in range(width):
        a, b, c, d = t00[:, k], t10[:, k], t01[:, k], t11[:, k]
        p = [a * p[0] + b * p[1], c * p[0] + d * p[1], a * p[2] + b * p[3], c * p[2] + d * p[3]]
        total = p[0] + p[1] + p[2] + p[3]
        p = [x / total for x in p]
    v0, v1 = np.empty(runs), np.empty(runs)
    x, y = 0.5, 0.5
    for k in range(runs):
        v0[k], v1[k] = x, y
        x, y = p[0][k] * x + p[2][k] * y, p[1][k] * x + p[3][k] * y
        x, y = x / (x + y), y / (x + y)
    out = np.empty((runs, width, 2))
    for k in range(width):
        v0, v1 = t00[:, k] * v0 + t10[:, k] * v1, t01[:, k] * v0 + t11[:, k] * v1
        total = v0 + v1
        v0, v1 = v0 / total, v1 / total
        out[:, k, 0], out[:, k, 1] = v0, v1
    return out.reshape(-1, 2)[:n]


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: P(toxic) of each token, and the scaled forward and backward vectors."""
    if not len(e):
        return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2))
    alpha = _scan(e, first, trans, start)
    # Backwards a sequence begins at its last token; there the vector before the transition is (1, 1).
    last = np.r_[first[1:], True]
    seen = _scan(e[::-1], last[::-1], trans.T, np.ones(2))[::-1]  # includes the token's own evidence
    up = np.exp(np.clip(e, -30, 30))
    beta = seen / np.stack([np.ones_like(up), up], axis=1)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), alpha, beta / beta.sum(axis=1, keepdims=True)


def slopes(e: np.ndarray, labels: np.ndarray, first: np.ndarray, log_trans: np.ndarray, log_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the labels' log likelihood: along each token's evidence, the transition weights and the start weights."""
    trans, start = np.exp(log_trans), np.exp(log_start)
    p, alpha, beta = marginals(e, first, trans, start)
    pairs = np.flatnonzero(~first)
    up = np.stack([np.ones(len(e)), np.exp(np.clip(e, -30, 30))], axis=1)
    joint = alpha[pairs - 1][:, :, None] * trans[None] * (up * beta)[pairs][:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[pairs - 1], labels[pairs]), 1)
    begun = np.bincount(labels[first], minlength=2) - np.array([(1 - p)[first].sum(), p[first].sum()])
    return labels - p, seen - joint.sum(axis=0), begun


def summary(p: np.ndarray) -> np.ndarray:
    top = p if len(p) <= TOP else np.partition(p, -TOP)[-TOP:]
    return np.array([1.0, top.sum(), top.max() if len(top) else 0.0])


class Field:
    """Weights of the field: one per hashed feature for the toxic state, a transition matrix and start weights."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, start: np.ndarray):
        self.weights, self.bias, self.trans, self.start = weights, bias, trans, start
        self.logit = np.array([-3.0, 3.0, 3.0])

    def chance(self, p: np.ndarray) -> float:
        """A document's score, from its tokens' marginals."""
        return float(1 / (1 + np.exp(-np.clip(summary(p) @ self.logit, -30, 30))))

    def calibrate(self, sums: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression of the documents' classes on their summaries, by Newton steps with a small penalty."""
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(sums @ self.logit, -30, 30)))
            slope = sums.T @ (toxic - q) - 0.05 * self.logit
            bend = (sums * (q * (1 - q))[:, None]).T @ sums + 0.05 * np.eye(3)
            self.logit = self.logit + np.clip(np.linalg.solve(bend, slope), -2, 2)

    def evidence(self, word: str) -> float:
        return float(self.bias + self.weights[features(word)].sum()) if word else float(self.bias)


def marks_of(docs: Iterable[tuple[set[str], int]]) -> set[str]:
    """Words (``=word``) and prefixes that mark toxic tokens, from documents' sets of stems and classes, which are gone through twice.

    A stem must be ``LIKELIER`` times likelier in toxic documents. It is taken if so many toxic documents are a surprise that chance
    brings to ``BY_CHANCE`` of all stems at most; then, while toxic documents are left without a mark, the stem that is in most of them is taken.
    """
    seen = (Counter(), Counter())
    sizes = [0, 0]
    for stems, toxic in docs:
        sizes[toxic] += 1
        seen[toxic].update(stems)
    share = sizes[1] / max(1, sum(sizes))
    able = {s for s, n in seen[1].items() if n >= LEAST_DOCS and (n + 0.1) / (sizes[1] + 1) >= LIKELIER * (seen[0][s] + 0.1) / (sizes[0] + 1)}
    alike = math.log(len(seen[0].keys() | seen[1].keys()) / BY_CHANCE + 1)

    def surprise(s: str) -> float:
        n, m = seen[1][s], seen[0][s]
        q = n / (n + m)
        return n * math.log(q / share) + (m * math.log((1 - q) / (1 - share)) if m else 0.0)

    marks = {s for s in able if surprise(s) >= alike}
    left = [stems & able for stems, toxic in docs if toxic and not stems & marks]
    while left:
        count = Counter(s for stems in left for s in stems)
        best = max(count, key=lambda s: (count[s], len(s), s), default=None)
        if best is None or count[best] < LEAST_DOCS:
            break
        marks.add(best)
        left = [stems for stems in left if best not in stems]
    return marks


class _StemSets:
    """(stems, class) of documents, given as codes of words and classes; a document's set is made when it is asked for."""

    def __init__(self, docs: list[tuple[np.ndarray, int]], stems: list[list[str]]):
        self.docs, self.stems = docs, stems

    def __iter__(self) -> Iterator[tuple[set[str], int]]:
        for own, toxic in self.docs:
            yield {s for k in np.unique(own).tolist() for s in self.stems[k]}, toxic


def _coded(docs: Iterable[tuple[str, int]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the sample, its tokens as places among them, their labels, where documents begin, and the classes of documents with words.

    Texts are read one at a time and kept as codes; no more are read once the sample is full.
    """
    codes: dict[str, int] = {}
    words: dict[str, int] = {}
    kept, n = [], 0
    for text, toxic in docs:
        own = []
        for token in text.split():
            k = codes.get(token)
            if k is None:
                word = word_of(token)
                k = codes[token] = words.setdefault(word, len(words)) if word else -1
            if k >= 0:
                own.append(k)
        kept.append((np.array(own, np.int32), toxic))
        n += len(own)
        if n >= SAMPLE_TOKENS:  # the document that fills the sample is whole: a long one is as likely in it as a short one
            break
    del codes
    vocabulary = list(words)
    del words
    stems = [_stems(w) for w in vocabulary]
    marks = marks_of(_StemSets(kept, stems))
    marked = np.array([any(s in marks for s in found) for found in stems], bool)
    at = np.concatenate([np.zeros(0, np.int32), *(own for own, _ in kept)])
    sizes = np.array([len(own) for own, _ in kept if len(own)], np.int64)
    classes = np.array([toxic for own, toxic in kept if len(own)], np.int64)
    labels = (marked[at] & np.repeat(classes == 1, sizes)).astype(np.int8)
    first = np.zeros(len(at), bool)
    first[np.cumsum(sizes) - sizes] = True
    return vocabulary, at, labels, first, classes


def _labelled(docs: Iterable[tuple[str, int]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """``_coded`` with the tokens' words themselves."""
    vocabulary, at, labels, first, toxic = _coded(docs)
    return [vocabulary[k] for k in at.tolist()], labels, first, toxic


def _pieces(first: np.ndarray) -> list[slice]:
    """Slices of whole documents with some PIECE_TOKENS tokens each."""
    cuts = [0]
    for begin in np.flatnonzero(first).tolist():
        if begin - cuts[-1] >= PIECE_TOKENS:
            cuts.append(begin)
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(first)], strict=True)]


def train(docs: Iterable[tuple[str, int]], epochs: int = 15, rate: float = 0.5, decay: float = 1e-5) -> Field | None:
    """Maximum likelihood with a quadratic penalty, by adaptive gradient steps over whole batches of documents."""
    vocabulary, at, labels, first, toxic = _coded(docs)
    if not len(labels) or not labels.any():
        return None
    each = [np.array(features(w), np.int32) for w in vocabulary]
    lengths = np.array([len(f) for f in each])
    columns, rows = np.concatenate(each), np.repeat(np.arange(len(each)), lengths)
    pieces = _pieces(first)
    weights, bias = np.zeros(DIMENSIONS), -3.0
    trans, start = np.zeros((2, 2)), np.zeros(2)
    squares = [np.full(DIMENSIONS, 1e-3), 1e-3, np.full((2, 2), 1e-3), np.full(2, 1e-3)]
    scale = 1.0 / max(1, labels.sum())
    for _ in range(epochs):
        e = (bias + np.bincount(rows, weights[columns], len(each)))[at]
        parts = [slopes(e[own], labels[own], first[own], trans, start) for own in pieces]
        miss, moved, begun = np.concatenate([m for m, _, _ in parts]), sum(m for _, m, _ in parts), sum(b for _, _, b in parts)
        by_word = np.bincount(at, miss, len(each))
        grads = [np.bincount(columns, by_word[rows], DIMENSIONS) * scale - decay * weights, miss.sum() * scale, moved * scale - decay * trans, begun * scale - decay * start]
        squares = [s + g * g for s, g in zip(squares, grads, strict=True)]
        steps = [rate * g / np.sqrt(s) for g, s in zip(grads, squares, strict=True)]
        weights, bias, trans, start = weights + steps[0], bias + steps[1], trans + steps[2], start + steps[3]
    tr, st = np.exp(trans), np.exp(start)
    field = Field(weights.astype(np.float32), float(bias), tr / tr.sum(), st / st.sum())
    e = (bias + np.bincount(rows, weights[columns], len(each)))[at]
    p = np.concatenate([marginals(e[own], first[own], field.trans, field.start)[0] for own in pieces])
    field.calibrate(np.stack([summary(q) for q in np.split(p, np.flatnonzero(first)[1:])]), toxic)
    return field


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic and text of a bounded sample, those of the least hashes of their ids; never of held-out documents."""
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_CLEAN))
    # The sample's size is bounded, so the side is broadcast.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field of the training sample, fitted in one task: the driver gets the weights alone."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column("text")[k].as_py(), b.column("toxic")[k].as_py()) for b in batches for k in range(b.num_rows))
        field = train(rows)
        for _ in rows:  # what the full sample left is read to its end, as Spark expects
            pass
        yield pa.RecordBatch.from_pydict({"field": [pickle.dumps(field)]})

    order = F.crc32(F.col("doc_id").cast("string"))
    row = training_sample(docs, labels).repartition(1).sortWithinPartitions(order, "doc_id").select("toxic", "text").mapInArrow(fit, "field binary").first()
    return pickle.loads(bytes(row.field)) if row else None


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score and spans (start, end in code points, marginal) of the tokens that are likelier toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value

        class Evidence(dict):
            def __missing__(self, token: str) -> float:
                if len(self) >= CACHE_TOKENS:
                    self.clear()
                e = f.evidence(word_of(token))
                self[token] = e
                return e

        known = Evidence()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            k = 0
            while k < len(ids):
                own: list[np.ndarray] = []
                held, begin, n = [], k, 0
                while k < len(ids) and n < PIECE_TOKENS:
                    text = texts[k].as_py() or ""
                    tokens = text.split() if f is not None else []
                    own.append(np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens)))
                    held.append(text)
                    n += len(tokens)
                    k += 1
                cuts = np.r_[0, np.cumsum([len(x) for x in own])]
                first = np.zeros(n, bool)
                first[cuts[:-1][np.diff(cuts) > 0]] = True
                p = marginals(np.concatenate(own), first, f.trans, f.start)[0] if n else np.zeros(0)
                scores, spans = [], []
                for j, text in enumerate(held):
                    q = p[cuts[j] : cuts[j + 1]]
                    scores.append(f.chance(q) if f is not None else 0.0)
                    hot = np.flatnonzero(q >= 0.5)
                    if len(hot):
                        places = [m.span() for m in _SPACED.finditer(text)]
                        spans.append([{"start": places[x][0], "end": places[x][1], "marginal": float(q[x])} for x in hot])
                    else:
                        spans.append([])
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin:k], pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row of ``docs``."""
    found = score(docs, fitted(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, and rows with a null doc_id. All columns are carried."""
    gone = scored(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")

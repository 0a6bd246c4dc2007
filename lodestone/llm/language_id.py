"""Languages of words, and of documents, by a linear-chain conditional random field with one state per language.

Features of a word are hashed: the word, its prefixes and suffixes, its n-grams, and for each language whether the word is in the lexicon
that the training sample gives for it. Transitions are learned too: the sample's documents are cut into short runs of words which
are strung together across documents and languages, so that the chain learns how often text goes on in its language and what it
switches to. Scoring reads every whole text once: forward-backward gives each word its chances, a document's
language is the one with the greatest sum of chances, and its score is that language's share.

The field is fitted in one task on a bounded sample: at most ``LANGUAGES`` languages, the most frequent ones, some ``SAMPLE_DOCS`` documents of
each, of which words are taken document by document until a language has ``SAMPLE_WORDS``.

Defined results: a word is a run without white space that has a letter, of which letters and marks count, lower-cased; a null text or one
without a letter is ``und`` with score 0, and so is every text where no language could be learned; rows with a null doc_id or
lang are predicted and never learned from; rows that repeat are each predicted; a text of more than ``PART`` characters is tagged in
parts that are cut between two words; ties go to the language that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shingles import mixed
from lodestone.llm.toxicity import held_out

LANGUAGES, SAMPLE_DOCS, SAMPLE_WORDS = 64, 150, 40_000
DIMENSIONS = 1 << 17
AFFIXES, GRAMS = 4, 3
#: Documents of a language that must hold a word of its lexicon.
LEXICON_DOCS = 2
#: Words in a run of the strung-together training text, at least and at most, and runs in a sequence.
RUN, RUNS = (4, 40), 6
#: Characters that are tagged at once, and the longest part of one text.
CHUNK, PART = 1_500_000, 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = [np.uint64(c) for c in (1, 0xD1342543DE82EF95, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


# --- words and features --------------------------------------------------------------------------------------------------


@functools.cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code point below ``size``: letter (1), mark (3), white space (2) or neither (0), and its lower case."""
    chars = [chr(k) for k in range(size)]
    kinds = np.fromiter((1 if c.isalpha() else 2 if c.isspace() else 3 if c > "˿" and unicodedata.category(c)[0] == "M" else 0 for c in chars), np.uint8, size)
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, size)
    return kinds, lower


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _GRAM[1], np.uint64))


@dataclass
class Words:
    """Words of some texts in order: text number, first and last character there, and which of the distinct words it is; hashes, letters and lengths of the distinct ones."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    which: np.ndarray
    hashes: np.ndarray
    letters: np.ndarray
    lengths: np.ndarray


def words_of(texts: list[str]) -> Words:
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    top = points.max(initial=0)
    kinds, lower = _tables(0x250 if top < 0x250 else 0x10000 if top < 0x10000 else 0x110000)
    kind = kinds[points]
    token = np.cumsum(kind == 2, dtype=np.int32)
    worded = np.zeros(int(token[-1]) + 1 if len(token) else 1, bool)
    worded[token[kind == 1]] = True  # marks alone are no word
    at = np.flatnonzero((kind & 1).astype(bool) & worded[token])
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none)
    own = token[at]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    lengths = np.diff(np.r_[starts, len(at)])
    letters = mixed((lower[points[at]].astype(np.uint64) + np.uint64(1)) * _STEP)
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    h = np.add.reduceat(letters * _powers(max(64, 1 << int(lengths.max() - 1).bit_length()))[place], starts)
    hashes, one, which = np.unique(mixed(h + lengths.astype(np.uint64) * _STEP), return_index=True, return_inverse=True)
    size = lengths[one]
    flat = np.repeat(starts[one] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first, last = at[starts], at[np.r_[starts[1:], len(at)] - 1]
    text = np.searchsorted(begins, first, "right") - 1
    return Words(text, first - begins[text], last - begins[text], which, hashes, letters[flat], size)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, hashed feature) pairs: the word, prefixes and suffixes of up to AFFIXES letters, n-grams of 2 to GRAMS."""
    n = len(w.lengths)
    word = np.repeat(np.arange(n), w.lengths)
    ends = np.cumsum(w.lengths)
    place = np.arange(len(w.letters)) - np.repeat(ends - w.lengths, w.lengths)
    left = np.repeat(w.lengths, w.lengths) - place
    rows, names = [np.arange(n)], [w.hashes]
    gram = np.zeros(len(w.letters), np.uint64)
    for k in range(1, AFFIXES + 1):
        more = np.zeros_like(gram)
        more[: len(gram) - k + 1] = w.letters[k - 1 :]
        gram = gram + more * _GRAM[k - 1]
        uses = [place == 0, left == k] + ([left >= k] if 2 <= k <= GRAMS else [])
        for use, chosen in enumerate(uses):
            at = np.flatnonzero(chosen & (left >= k))
            rows.append(word[at])
            names.append(gram[at] + np.uint64((1 + 8 * k + use) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
    return np.concatenate(rows), (mixed(np.concatenate(names)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


# --- the chain -----------------------------------------------------------------------------------------------------------


def _forward(up: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward vectors, scaled, of many sequences laid end to end; ``first`` marks where each begins.

    Words are cut into equal runs that advance side by side: first the products of each run's matrices, then the vectors at the
    runs' starts, then all vectors.
    """
    n, k = up.shape
    width = max(1, int(np.ceil(np.sqrt(n))))
    runs = -(-n // width)
    pad = runs * width - n
    up = np.vstack([up, np.ones((pad, k))]).reshape(runs, width, k)
    new = np.r_[first, np.zeros(pad, bool)].reshape(runs, width)
    each = [np.flatnonzero(new[:, t]) for t in range(width)]
    p = np.broadcast_to(np.eye(k), (runs, k, k)).copy()
    for t in range(width):
        p = (p.reshape(-1, k) @ trans).reshape(runs, k, k)
        p[each[t]] = start
        p *= up[:, t, None, :]
        if t % 4 == 3:
            p /= p.sum(axis=(1, 2), keepdims=True)
    v = np.empty((runs, k))
    x = np.full(k, 1 / k)
    for r in range(runs):
        v[r] = x
        x = x @ p[r]
        x = x / x.sum()
    out = np.empty((runs, width, k))
    for t in range(width):
        v = v @ trans
        v[each[t]] = start
        v *= up[:, t]
        v /= v.sum(axis=1, keepdims=True)
        out[:, t] = v
    return out.reshape(-1, k)[:n]


def chances(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: each word's chance of each state, and the evidence, forward and backward vectors, each scaled."""
    up = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -30))
    alpha = _forward(up, first, trans, start)
    last = np.r_[first[1:], True]
    beta = _forward(up[::-1], last[::-1], trans.T, np.ones(len(start)))[::-1] / up
    beta /= beta.sum(axis=1, keepdims=True)
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True), up, alpha, beta


def slopes(e: np.ndarray, labels: np.ndarray, first: np.ndarray, log_trans: np.ndarray, log_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the labels' log likelihood along each word's evidence, the transition weights and the start weights."""
    k = len(log_start)
    trans, start = np.exp(log_trans), np.exp(log_start)
    p, up, alpha, beta = chances(e, first, trans, start)
    moved = np.zeros((k, k))
    pairs = np.flatnonzero(~first)
    np.add.at(moved, (labels[pairs - 1], labels[pairs]), 1)
    step = max(1, 4_000_000 // (k * k))
    for a in range(0, len(pairs), step):
        at = pairs[a : a + step]
        joint = alpha[at - 1][:, :, None] * trans * (up * beta)[at][:, None, :]
        moved -= (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    hit = np.eye(k)[labels]
    return hit - p, moved, (hit - p)[first].sum(axis=0)


# --- the field -----------------------------------------------------------------------------------------------------------


@dataclass
class Tagger:
    """Weights by hashed feature and language, transitions, and the lexicon: sorted hashes of words, which languages have them, and what that weighs."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray
    lexicon_of: np.ndarray
    lexicon_weights: np.ndarray

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.languages)))
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return self.lexicon_of[at] * (self.lexicon[at] == hashes)[:, None]

    def evidence(self, w: Words) -> np.ndarray:
        rows, columns = features(w)
        held = self.weights[columns]
        found = np.stack([np.bincount(rows, held[:, k], len(w.lengths)) for k in range(len(self.languages))], axis=1)
        return found + self.bias + self.known(w.hashes) @ self.lexicon_weights

    def tag(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        """Words of the texts and each word's chance of each language; each text is a sequence."""
        w = words_of(texts)
        if not len(w.text):
            return w, np.zeros((0, len(self.languages)))
        first = np.r_[True, w.text[1:] != w.text[:-1]]
        return w, chances(self.evidence(w)[w.which], first, self.trans, self.start)[0]


def _strung(docs: list[tuple[int, np.ndarray]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and labels of the sample as sequences of short runs of different documents, and where sequences begin."""
    runs = []
    for label, own in docs:
        at = 0
        while at < len(own):
            n = int(rng.integers(RUN[0], RUN[1] + 1))
            runs.append((label, own[at : at + n]))
            at += n
    runs = [runs[k] for k in rng.permutation(len(runs))]
    which = np.concatenate([own for _, own in runs])
    labels = np.repeat([label for label, _ in runs], [len(own) for _, own in runs])
    first = np.zeros(len(which), bool)
    first[np.cumsum([0, *(len(own) for _, own in runs)])[:-1][::RUNS]] = True
    return which, labels, first


def train(docs: list[tuple[str, str]], epochs: int = 25, rate: float = 0.6, decay: float = 1e-6) -> Tagger | None:
    """Maximum likelihood with a quadratic penalty on (language, text) pairs, by adaptive gradient steps over the whole sample."""
    w = words_of([text for _, text in docs])
    if not len(w.text):
        return None
    cuts = np.searchsorted(w.text, np.arange(len(docs) + 1))
    languages = sorted({docs[k][0] for k in np.unique(w.text).tolist()})
    number = {x: k for k, x in enumerate(languages)}
    k = len(languages)
    each = [(number[docs[d][0]], w.which[cuts[d] : cuts[d + 1]]) for d in range(len(docs)) if cuts[d + 1] > cuts[d]]
    held = np.zeros((len(w.lengths), k), np.int32)
    for label, own in each:
        held[np.unique(own), label] += 1
    inside = (held >= LEXICON_DOCS).any(axis=1)
    field = Tagger(languages, np.zeros((DIMENSIONS, k)), np.zeros(k), np.zeros((k, k)), np.zeros(k), w.hashes[inside], (held[inside] >= LEXICON_DOCS).astype(float), np.zeros((k, k)))
    which, labels, first = _strung(each, np.random.default_rng(7))
    rows, columns = features(w)
    listed = field.known(w.hashes)
    values = [field.weights, field.bias, field.trans, field.start, field.lexicon_weights]
    squares = [np.full(v.shape, 1e-6) for v in values]
    for _ in range(epochs):
        e = field.evidence(w)[which]
        miss, moved, begun = slopes(e, labels, first, field.trans, field.start)
        by_word = np.stack([np.bincount(which, miss[:, j], len(w.lengths)) for j in range(k)], axis=1)
        by_feature = np.stack([np.bincount(columns, by_word[rows, j], DIMENSIONS) for j in range(k)], axis=1)
        grads = [g / len(which) - decay * v for g, v in zip((by_feature, by_word.sum(axis=0), moved, begun, listed.T @ by_word), values, strict=True)]
        for v, s, g in zip(values, squares, grads, strict=True):
            s += g * g
            v += rate * g / np.sqrt(s)
    field.trans, field.start = np.exp(field.trans), np.exp(field.start)
    field.trans /= field.trans.sum()
    field.start /= field.start.sum()
    field.weights = field.weights.astype(np.float32)
    return field


def training_sample(docs: DataFrame) -> DataFrame:
    """lang and text of some SAMPLE_DOCS documents of each language, by a hash of their ids; never of held-out documents."""
    known = docs.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    # One row per language, at most LANGUAGES.
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    rates = counts.select("lang", F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_DOCS) / F.col("count")).alias("_rate"))
    order = F.xxhash64("doc_id")
    return (
        known.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(rates), "lang")
        .where(F.pmod(order, F.lit(1 << 30)) < F.col("_rate") * (1 << 30)).select("lang", "text", order.alias("_order"), "doc_id")
    )


def fitted(docs: DataFrame) -> Tagger | None:
    """The field of the training sample, fitted in one task: the driver gets the weights alone."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[str, int] = {}
        sample = []
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if sizes.get(lang, 0) < SAMPLE_WORDS:
                    said = text.as_py()
                    sizes[lang] = sizes.get(lang, 0) + said.count(" ") + 1
                    sample.append((lang, said))
        yield pa.RecordBatch.from_pydict({"field": [pickle.dumps(train(sample))]})

    row = training_sample(docs).repartition(1).sortWithinPartitions("_order", "doc_id", "text").select("lang", "text").mapInArrow(fit, "field binary").first()
    return pickle.loads(bytes(row.field)) if row else None


def _parts(text: str) -> list[str]:
    """A text in parts of at most PART characters, cut at white space where there is any."""
    out = []
    while len(text) > PART:
        cut = max(text.rfind(c, 1, PART) for c in " \n\t")
        cut = PART if cut < 0 else cut
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def predict(docs: DataFrame, field: Tagger | None) -> DataFrame:
    """doc_id, lang_pred, score and segments (start, end in code points, lang): runs of words of one language, of every row of ``docs``."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    # At most LANGUAGES weights for each of a fixed number of features.
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array(f.languages if f is not None else [], object)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            k = 0
            while k < len(ids):
                parts, owner, offset, begin, n = [], [], [], k, 0
                while k < len(ids) and n < CHUNK:
                    at = 0
                    for part in _parts((texts[k].as_py() or "") if f is not None else ""):
                        parts.append(part)
                        owner.append(k - begin)
                        offset.append(at)
                        at += len(part)
                    n += at
                    k += 1
                size = k - begin
                langs, scores, segments = ["und"] * size, np.zeros(size), [[] for _ in range(size)]
                if f is not None:
                    w, p = f.tag(parts)
                    doc = np.array(owner)[w.text]
                    sums = np.stack([np.bincount(doc, p[:, j], size) for j in range(p.shape[1])], axis=1)
                    best, total = sums.argmax(axis=1), sums.sum(axis=1)
                    for d in np.flatnonzero(total > 0).tolist():
                        langs[d], scores[d] = names[best[d]], min(1.0, sums[d, best[d]] / total[d])
                    label = p.argmax(axis=1)
                    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]) if len(doc) else np.zeros(0, np.int64)
                    ends = np.r_[new[1:], len(doc)] - 1
                    shift = np.array(offset)[w.text]
                    for d, a, b, x in zip(doc[new].tolist(), (w.first + shift)[new].tolist(), (w.last + shift)[ends].tolist() if len(new) else [], label[new].tolist(), strict=True):
                        segments[d].append({"start": a, "end": b + 1, "lang": names[x]})
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin:k], pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(segments, kind)], ["doc_id", "lang_pred", "score", "segments"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, lang_pred string, score double, segments array<struct<start:int,end:int,lang:string>>")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and segments of every row of ``docs``, by a field that the rows that aren't held out have taught."""
    return predict(docs, fitted(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "segments")

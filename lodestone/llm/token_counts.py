"""Token counts of whole texts under a unigram model, with one trie of pre-tokens and shared forward scores.

The pieces are a public vocabulary's; it lists them by rank, and a piece's log probability is Zipf's: minus the logarithm of
its rank, up to a constant that the number of pieces fixes. A pre-token is a run of characters without white space, with the mark
``▁`` before it. The distinct pre-tokens of a batch go into a trie in sorted order; a node's forward score, the best of all
segmentations of the characters down to it, is computed once for all pre-tokens below it, and so is the best one's number of
tokens. A character that no piece covers scores ``UNKNOWN`` below the rarest piece and counts as its UTF-8 bytes.
Equal scores: fewer tokens first.

Defined results: a null or empty text has no tokens; rows are counted one by one, so repeated and null doc_ids keep their
rows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
CACHE_WORDS = 400_000
_open: dict[str, Counts] = {}


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Piece -> log probability, for pieces in order of rank."""
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return {p: -math.log(k + 1) - total for k, p in reversed(list(enumerate(pieces)))}


def load_pieces(vocabulary: str) -> list[str]:
    """The vocabulary's ordinary pieces, in order of rank."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=str(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)))
    own = [k for k in range(m.get_piece_size()) if not (m.is_unknown(k) or m.is_control(k) or m.is_byte(k) or m.is_unused(k))]
    return [m.id_to_piece(k) for k in sorted(own, key=lambda k: -m.get_score(k))]


class Counts(dict):
    """Number of tokens of each pre-token that was inserted."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.nodes = 0

    def insert(self, words: set[str]) -> None:
        """Walks the trie of ``words`` in order; the path down to the present node is kept with its forward scores."""
        if len(self) + len(words) > CACHE_WORDS:
            self.clear()
        new = sorted(w for w in words if w not in self)
        get, longest = self.scores.get, self.longest
        path, best, count = "", [0.0], [0]
        for word in new:
            marked = MARK + word
            n = 0
            top = min(len(path), len(marked))
            while n < top and path[n] == marked[n]:
                n += 1
            del best[n + 1 :], count[n + 1 :]
            for end in range(n + 1, len(marked) + 1):
                c = marked[end - 1]
                score, tokens = best[end - 1] + self.unknown, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))
                for begin in range(max(0, end - longest), end):
                    s = get(marked[begin:end])
                    if s is not None:
                        s += best[begin]
                        if s > score or s == score and count[begin] + 1 < tokens:
                            score, tokens = s, count[begin] + 1
                best.append(score)
                count.append(tokens)
            self.nodes += len(marked) - n
            self[word] = count[-1]
            path = marked


def counts_of(vocabulary: str) -> Counts:
    if vocabulary not in _open:
        _open[vocabulary] = Counts(zipf_scores(load_pieces(vocabulary)))
    return _open[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words (pre-tokens) and n_tokens of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts_of(vocabulary)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a in range(0, len(ids), 500):
                own = [t.split() if t else [] for t in texts.slice(a, 500).to_pylist()]
                known.insert({w for words in own for w in words})
                tokens = [sum(map(known.__getitem__, words)) for words in own]
                yield pa.RecordBatch.from_arrays([ids.slice(a, 500), pa.array([len(w) for w in own], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")

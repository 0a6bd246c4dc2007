"""URL filtering by host and path rules, and by a weighted vocabulary for the rest.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: then up to ``?``, ``#`` or the end; both
are empty for a null url or one without ``://``. A rule fits its host and every subdomain of it if the path starts with the
rule's; the longest rule wins. Where no rule fits, an Aho-Corasick automaton finds all vocabulary terms in the lower-cased url
in one pass; a term counts where neither neighbour is a letter or digit. One strict term rejects, and so do at least ``SOFT_HITS``
distinct soft terms that weigh ``SOFT_LIMIT`` or more together. ``url_terms.tsv`` is the vocabulary, in the documents' four languages:
a weight of 0 makes a term strict.

Defined results: a null or empty url has no terms and is allowed; rows are judged one by one, so repeated and null page_ids keep
their rows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SOFT_HITS, SOFT_LIMIT = 2, 3


@functools.cache
def vocabulary() -> tuple[tuple[str, ...], tuple[tuple[str, int], ...]]:
    """Strict terms, and soft terms with their weights."""
    lines = (files("lodestone.llm") / "url_terms.tsv").read_text("utf-8").split("\n")[1:]
    rows = [(term, int(weight)) for term, weight in (line.split("\t") for line in lines if line)]
    return tuple(t for t, w in rows if not w), tuple((t, w) for t, w in rows if w)


_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    cut = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return rest[:end].translate(_AZ), path[:cut]


def fitting_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule as host + path, verdict) of the longest rule that fits."""
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=None)


@functools.cache
def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in [*((t, 0) for t in strict), *soft]:
        a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def term_hits(url: str, strict: tuple[str, ...] | None = None, soft: tuple[tuple[str, int], ...] | None = None) -> tuple[set[str], dict[str, int]]:
    """Strict terms found, and the distinct soft terms found with their weights; terms inside longer words don't count."""
    strict, soft = vocabulary()[0] if strict is None else strict, vocabulary()[1] if soft is None else soft
    text = url.translate(_AZ)
    strict_hits: set[str] = set()
    soft_hits: dict[str, int] = {}
    for end, (term, weight) in _automaton(strict, soft).iter(text) if strict or soft else ():
        begin = end - len(term)
        if (begin < 0 or not text[begin].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            if weight:
                soft_hits[term] = weight
            else:
                strict_hits.add(term)
    return strict_hits, soft_hits


def judge(pages: DataFrame, rules=RULES, strict: Sequence[str] | None = None, soft: Mapping[str, int] | None = None, soft_hits: int = SOFT_HITS, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, n_strict, n_soft, soft_weight, verdict of every row, by the vocabulary's terms or by those given."""
    hard = vocabulary()[0] if strict is None else tuple(strict)
    weighed = vocabulary()[1] if soft is None else tuple(soft.items())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule = fitting_rule(host, path, rules)
                hits, found = term_hits(url or "", hard, weighed)
                weight = sum(found.values())
                method = "block" if hits or len(found) >= soft_hits and weight >= soft_limit else "allow"
                rows.append((host, path, rule and rule[0], len(hits), len(found), weight, rule[1] if rule else method))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["page_id", "host", "path", "rule", "n_strict", "n_soft", "soft_weight", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url")).mapInArrow(each, "page_id long, host string, path string, rule string, n_strict long, n_soft long, soft_weight long, verdict string")

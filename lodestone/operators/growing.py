"""A BM25 index that grows: segments with their own postings and statistics, deletions, and merges.

Adding documents writes their postings, and of the documents that they replace the ids and the statistics to take off; what is there already is
not written again. Statistics are sums over segments, less those of deleted documents, so scores are those of an index that
was made at once. Segments of like size are merged when there are many of them, which drops what is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import lexical, pruned, ranking
from lodestone.plans.sizing import broadcast_if_small, is_small
from lodestone.plans.snapshots import FANOUT, Store, Version, due
from lodestone.plans.tables import written

#: Query words up to which a search reads their postings; for more it reads the documents' words, which stay together.
FEW_WORDS = 64
_SCHEMAS = {
    "postings": "term string, doc_id long, tf long, dl int",
    "words": "doc_id long, dl int, words array<string>",
    # With the greatest tf and the smallest dl of a term's postings, which bound what it can add to a score.
    "terms": "term string, df long, cf long, top long, least int",
    # What deleted documents take off the statistics of their segment ``of``; doc_id is null.
    "less": "doc_id long, of long, term string, df long, cf long",
}


class GrowingIndex:
    """An index of documents(doc_id, text) in the folder ``path``. Documents without a doc_id or with an empty text are left out."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.store = Store(spark, path, "doc_id", _SCHEMAS)

    # --- changes ------------------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, merge: bool = True) -> Version:
        """Adds documents; one with a doc_id that is known replaces the old one, which is gone if the new text is empty. A doc_id may be in ``docs`` once."""
        before = self.store.version()
        new = before.last + 1
        given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), tx.text_or_empty("text").alias("text"))
        self.store.write("words", new, given.where("text <> ''").select("doc_id", tx.tokens("text").alias("words")).withColumn("dl", F.size("words")))
        facts = self._facts(new)
        # A document whose text is empty now takes its old text away.
        empty = written(given.where("text = ''").select("doc_id"), "empty") if before.segments else None
        if facts["docs"] == 0:
            return before if empty is None else self.remove(empty)
        if self.store.read("words", before, [new]).groupBy("doc_id").count().where("count > 1").limit(1).count():
            raise ValueError("documents to add must have different ids")
        self._write_postings(new)
        added = Version(before.number, {**before.segments, new: facts}, before.dead, new)
        ids = self.store.read("words", before, [new]).select("doc_id")
        after = self._without(added, ids if empty is None else ids.unionByName(empty), but=new)
        done = self.store.commit(before, after)
        return self.merge() if merge else done

    def remove(self, ids: DataFrame) -> Version:
        """Takes documents away, by ids(doc_id); unknown ids are ignored."""
        before = self.store.version()
        after = self._without(Version(before.number, before.segments, before.dead, before.last), ids.select(F.col("doc_id").cast("long").alias("doc_id")))
        return before if after.dead == before.dead else self.store.commit(before, after)

    def _facts(self, segment: int) -> dict[str, int]:
        row = self.store.read("words", Version(), [segment]).agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        return {"docs": row["docs"], "words": row["words"], "dead_docs": 0, "dead_words": 0}

    def _write_postings(self, segment: int) -> None:
        """Postings in ranges of term and document, so that a term is found by the files' bounds, and the segment's own statistics."""
        words = self.store.read("words", Version(), [segment])
        each = lexical.postings(lexical.folded(words.select("doc_id", "words")))
        self.store.write("postings", segment, each.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
        held = self.store.read("postings", Version(), [segment])
        self.store.write("terms", segment, held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("top"), F.min("dl").alias("least")))

    def _without(self, version: Version, ids: DataFrame, but: int | None = None) -> Version:
        """``version`` without the documents of some ids in all segments but one: their ids and what they take off the statistics are written."""
        olds = [s for s in version.segments if s != but]
        if not olds:
            return version
        change = version.last + 1
        held = self.store.live("words", version, olds)
        gone = held.join(broadcast_if_small(ids.distinct()), "doc_id", "left_semi")
        # The words of deleted documents are read once more for the statistics; the ids alone are written here.
        self.store.write_dead(change, gone)
        marked = self.spark.read.parquet(f"{self.store.path}/dead/change={change}")
        counts = held.select("segment", "doc_id", "dl").join(broadcast_if_small(marked), ["segment", "doc_id"], "left_semi").groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).collect()  # one row per segment
        if not counts:
            return version
        words = held.join(broadcast_if_small(marked), ["segment", "doc_id"], "left_semi").select("segment", "words")
        less = lexical.postings(lexical.folded(words)).groupBy("segment", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        self.store.write("less", change, less.select(F.lit(None).cast("long").alias("doc_id"), F.col("segment").alias("of"), "term", "df", "cf"))
        segments = {k: dict(v) for k, v in version.segments.items()}
        for r in counts:
            segments[r["segment"]]["dead_docs"] += r["n"]
            segments[r["segment"]]["dead_words"] += r["words"]
        return Version(version.number, segments, (*version.dead, change), change)

    # --- merges -------------------------------------------------------------------------------------------------------

    def merge(self, everything: bool = False) -> Version:
        """Merges what the policy names, or all segments; the rows that count go into one new segment."""
        while True:
            before = self.store.version()
            chosen = sorted(before.segments) if everything else due(before, self.fanout)
            if not chosen or (everything and len(chosen) == 1 and not before.dead):
                return before
            new = before.last + 1
            self.store.write("words", new, self.store.live("words", before, chosen))
            facts = self._facts(new)
            kept = {s: f for s, f in before.segments.items() if s not in chosen}
            if facts["docs"]:
                self._write_postings(new)
                kept[new] = facts
            # Deletions count as long as a segment is there that they name.
            dead = before.dead if any(f["dead_docs"] for f in kept.values()) else ()
            self.store.commit(before, Version(before.number, kept, dead, new))
            if everything:
                return self.store.version()

    # --- reading ------------------------------------------------------------------------------------------------------

    def totals(self, version: Version | None = None) -> tuple[int, int]:
        """Documents and words that count."""
        v = version or self.store.version()
        return v.total("docs") - v.total("dead_docs"), v.total("words") - v.total("dead_words")

    def term_counts(self, version: Version | None = None, terms: DataFrame | None = None) -> DataFrame:
        """term, df, cf over all documents that count, or of ``terms``(term) alone: sums of the segments' statistics, less the deleted documents'."""
        v = version or self.store.version()
        more = self.store.read("terms", v).select("term", "df", "cf")
        if v.dead:
            less = self.store.read("less", Version(), list(v.dead)).where(F.col("of").isin(sorted(v.segments)))
            more = more.unionByName(less.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
        if terms is not None:
            more = more.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")
        return more.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    def postings(self, version: Version | None = None) -> DataFrame:
        """term, doc_id, tf, dl of the documents that count."""
        return self.store.live("postings", version or self.store.version()).select("term", "doc_id", "tf", "dl")

    def search(self, queries: DataFrame, k: int | None = 5, version: Version | None = None) -> DataFrame:
        """The best documents for each of queries(query_id, text), as ``ranking.bm25`` finds them. For few words only their postings are read."""
        v, wanted, held, n, words = self._asked(queries, version)
        many = k is not None and k > 0 and not is_small(wanted, FEW_WORDS)
        if many and lexical.whole_numbers(queries.schema["query_id"].dataType) and lexical.fits(wanted):
            kept = lexical.kept_words(self.store.live("words", v).select("doc_id", "words"), wanted)
            return lexical.best(kept, lexical.weighted(wanted, self.term_counts(v, wanted).select("term", "df"), n), k, words / max(1, n))
        return ranking.ranked(ranking.scores(held, wanted, self.term_counts(v, wanted).select("term", "df"), n, words), k, "doc_id")

    def search_pruned(self, queries: DataFrame, k: int = 5, version: Version | None = None) -> tuple[DataFrame, DataFrame]:
        """The rows of ``search``, and how many postings were added up for them (``pruned.best``)."""
        v, wanted, held, n, words = self._asked(queries, version)
        # Bounds of segments hold for what is left of them, too.
        bounds = self.store.read("terms", v).join(broadcast_if_small(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.max("top").alias("top"), F.min("least").alias("least"))
        return pruned.best(held, wanted, self.term_counts(v, wanted).join(bounds, "term"), n, words, k)

    def _asked(self, queries: DataFrame, version: Version | None) -> tuple[Version, DataFrame, DataFrame, int, int]:
        v = version or self.store.version()
        wanted = written(ranking.query_terms(queries), "wanted")
        held = self.postings(v).join(broadcast_if_small(wanted.select("term").distinct()), "term", "left_semi")
        return v, wanted, held, *self.totals(v)

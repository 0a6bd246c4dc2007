"""An index of chunks that is brought up to date with a folder: only what changed is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans import flows
from lodestone.plans.sizing import broadcast_if_small
from lodestone.plans.snapshots import FANOUT, Store, Version, due
from lodestone.plans.tables import written

_SCHEMAS = {
    "chunks": "source string, parent_id string, chunk_id string, page_number int, chunk_idx int, section_number string, section_title string, product string, section_inherited boolean, "
    "section_fallback boolean, see_also string, related_sections string, prerequisites string, dependencies_extracted boolean, dependency_method string, text string, parent_text string",
    "files": "source string, sha256_hash string",
}


class ChunkIndex:
    """Chunks of files in the folder ``path``; ``settings`` are those of ``flows.build_index``."""

    def __init__(self, spark: SparkSession, path: str, products: DataFrame, fanout: int = FANOUT, **settings):
        self.store, self.products, self.fanout, self.settings = Store(spark, path, "source", _SCHEMAS), products, fanout, settings

    def changes(self, files: DataFrame, version: Version | None = None) -> DataFrame:
        """source, sha256_hash, change (new, changed or deleted) and segment of the old chunks: files(source, sha256_hash) against what is indexed."""
        known = self.store.live("files", version or self.store.version()).select("source", F.col("sha256_hash").alias("_was"), "segment")
        now = files.where("source is not null").groupBy("source").agg(F.max("sha256_hash").alias("sha256_hash"))
        change = F.when(F.col("segment").isNull(), "new").when(F.col("sha256_hash").isNull(), "deleted").when(F.col("sha256_hash") != F.col("_was"), "changed")
        return now.join(known, "source", "full_outer").withColumn("change", change).where("change is not null").select("source", "sha256_hash", "change", "segment")

    def refresh(self, files: DataFrame, merge: bool = True) -> tuple[Version, dict[str, int]]:
        """Builds the chunks of new and changed files(source, page_number, text, sha256_hash), drops those of changed and deleted ones: (version, how many files of each kind).

        The files are all there are. Where nothing changed nothing is written and the version stays.
        """
        before = self.store.version()
        found = written(self.changes(files, before), "changes")
        counts = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}  # three rows at most
        if not counts:
            return before, counts
        segments, dead, last = {k: dict(v) for k, v in before.segments.items()}, before.dead, before.last
        fresh = found.where("change <> 'deleted'").select("source", "sha256_hash")
        if counts.keys() & {"new", "changed"}:
            last += 1
            pages = files.join(broadcast_if_small(fresh.select("source")), "source", "left_semi")
            self.store.write("chunks", last, flows.build_index(pages.select("source", "page_number", "text"), self.products, **self.settings))
            self.store.write("files", last, fresh)
            segments[last] = {"docs": counts.get("new", 0) + counts.get("changed", 0), "dead_docs": 0}
        if counts.keys() & {"deleted", "changed"}:
            last += 1
            old = found.where("segment is not null")
            self.store.write_dead(last, old)
            for r in old.groupBy("segment").count().collect():  # one row per segment
                segments[r["segment"]]["dead_docs"] += r["count"]
            dead = (*dead, last)
        done = self.store.commit(before, Version(before.number, segments, dead, last))
        return (self.merge() if merge else done), counts

    def merge(self) -> Version:
        """Merges what the policy names: the chunks that count go into one new segment."""
        while True:
            before = self.store.version()
            chosen = due(before, self.fanout)
            if not chosen:
                return before
            new, kept = before.last + 1, {s: f for s, f in before.segments.items() if s not in chosen}
            for table in _SCHEMAS:
                self.store.write(table, new, self.store.live(table, before, chosen))
            docs = self.store.read("files", Version(), [new]).count()
            if docs:
                kept[new] = {"docs": docs, "dead_docs": 0}
            self.store.commit(before, Version(before.number, kept, before.dead if any(f["dead_docs"] for f in kept.values()) else (), new))

    def read(self, sources: Sequence[str] | None = None, version: Version | None = None) -> DataFrame:
        """The chunks that count, of all sources or of some. Blank texts are left out."""
        rows = self.store.live("chunks", version or self.store.version()).drop("segment")
        rows = rows.where(F.col("source").isin(*sources)) if sources is not None else rows
        return rows.where(~tx.blank("text"))

"""Replay of a semantic cache: seeds, later queries, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import ranking
from lodestone.plans.numbering import numbered
from lodestone.plans.sizing import is_small
from lodestone.plans.tables import new_path, written

# Fixed values.
THRESHOLDS = (0.90, 0.95, 0.97)
FULL_MS, HIT_MS, OVERHEAD_TOKENS = 1200.0, 35.0, 1200
# Phrases that say nothing about the question.
LEADING = (r"подскажите[:,\s-]*", r"скажите[:,\s-]*", r"пожалуйста[:,\s-]*", r"инструкция[:,\s-]*", r"нужна\s+инструкция[:,\s-]*", r"нужны\s+шаги[:,\s-]*")
TRAILING = (r"[\s.?!,;:-]*нужны\s+краткие\s+шаги[\s.?!,;:-]*", r"[\s.?!,;:-]*нужна\s+краткая\s+инструкция[\s.?!,;:-]*", r"[\s.?!,;:-]*подробная\s+инструкция[\s.?!,;:-]*")


def normal_query(text: Column | str) -> Column:
    """Lower case, ё as е, noise phrases cut off once each in order, then words of digits and letters."""
    c = tx.strip(F.replace(F.lower(tx.text_or_empty(text)), F.lit("ё"), F.lit("е")))
    for p in LEADING:
        c = F.regexp_replace(c, r"(?U)^\s*" + p, "")
    for p in TRAILING:
        c = F.regexp_replace(c, "(?U)" + p + r"\n?\z", "")
    return F.array_join(F.regexp_extract_all(c, F.lit("[0-9a-zа-яё]+"), F.lit(0)), " ")


def _best_entries(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, entry_id, similarity: the most similar of entries(entry_id, embedding) for each of queries(query_id, embedding), the smallest entry_id among equals."""
    if is_small(entries, ranking.QUERY_BLOCK):
        return ranking.nearest_of_few(entries.select(F.col("entry_id").alias("doc_id"), "embedding"), queries.select("query_id", "embedding")).select("query_id", F.col("doc_id").alias("entry_id"), F.col("score").alias("similarity"))
    best = ranking.dense(entries.select(F.col("entry_id").alias("doc_id"), "embedding"), queries.select("query_id", "embedding"), 1)
    return best.select("query_id", F.col("doc_id").alias("entry_id"), F.col("score").alias("similarity"))


def static_replay(entries: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """queries(query_id, embedding, intent) against fixed entries(entry_id, embedding, intent): entry_id, similarity, hit, accurate."""
    out = queries.select("query_id", "intent").join(_best_entries(entries, queries), "query_id", "left").join(entries.select("entry_id", F.col("intent").alias("_intent")), "entry_id", "left")
    hit = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    return out.select("query_id", "entry_id", "similarity", hit.alias("hit"), (hit & F.coalesce(F.col("intent") == F.col("_intent"), F.lit(False))).alias("accurate"))


def seeded_replay(records: DataFrame, seeds: int, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """records(seq, embedding, intent) in order of seq against a cache of the first ``seeds``, which misses don't fill: the columns of ``online_replay``."""
    spark = records.sparkSession
    rows = written(numbered(records.where("embedding is not null").select("seq", "embedding", "intent"), ["seq"]), "replay")
    entries = rows.where(F.col("n") <= seeds).select(F.col("seq").alias("entry_id"), "embedding", "intent")
    best = _best_entries(entries, rows.where(F.col("n") > seeds).select(F.col("seq").alias("query_id"), "embedding"))
    best = best.join(rows.select(F.col("seq").alias("query_id"), "intent"), "query_id").join(F.broadcast(entries.select("entry_id", F.col("intent").alias("_intent"))) if seeds <= ranking.QUERY_BLOCK else entries.select("entry_id", F.col("intent").alias("_intent")), "entry_id")
    each = best.crossJoin(F.broadcast(spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")))  # a few thresholds
    hit = F.col("similarity") >= F.col("threshold")
    each = each.select("threshold", F.col("query_id").alias("seq"), F.col("entry_id").alias("entry_seq"), "similarity", hit.alias("hit"), (hit & F.coalesce(F.col("intent") == F.col("_intent"), F.lit(False))).alias("accurate"))
    return numbered(each, ["seq"], by=["threshold", "entry_seq"], name="cluster_size", of=F.col("hit").cast("long")).withColumn("cluster_size", F.col("cluster_size") + 1)


def _play(threshold: float):
    """Settles one block of records: each against the best entry from before the block, and against those that the block's misses added."""

    def play(frame: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        before = dict(zip(best.seq, zip(best.entry_id, best.similarity, strict=True), strict=True))
        vectors = np.zeros((len(frame), max((len(v) for v in frame.embedding), default=0)))
        for i, v in enumerate(frame.embedding):
            own = np.nan_to_num(np.asarray(v, float))
            vectors[i, : len(own)] = own / (np.linalg.norm(own) or 1.0)
        held, added, out = np.zeros_like(vectors), [], []
        for i, r in enumerate(frame.itertuples()):
            entry, similarity = before.get(r.seq, (None, -1.0))
            if added:
                near = np.round(held[: len(added)] @ vectors[i], 6)
                at = int(np.argmax(near))
                if near[at] > similarity:
                    entry, similarity = added[at], float(near[at])
            hit = entry is not None and similarity >= threshold
            if not hit:
                held[len(added)] = vectors[i]
                added.append(r.seq)
            out.append((threshold, r.seq, r.intent, entry, similarity, bool(hit), None if hit else r.embedding))
        return pd.DataFrame(out, columns=["threshold", "seq", "intent", "entry_seq", "similarity", "hit", "embedding"]).astype({"entry_seq": "Int64"})

    return play


def online_replay(records: DataFrame, seeds: int, thresholds: Sequence[float] = THRESHOLDS, block: int = ranking.QUERY_BLOCK) -> DataFrame:
    """records(seq, embedding, intent) in order of seq through one cache that misses fill: threshold, seq, entry_seq, similarity, hit, accurate, cluster_size.

    The first ``seeds`` records fill the cache and are not replayed. What a record meets depends on all records before it, so the records go
    by blocks: a block's best entries among all from before it are found by one search that is spread over the entries, and what its
    own misses add is settled inside the block, in one task of ``block`` rows. A block's outcome is written before the next one is begun,
    with the vectors that it adds, to one folder that the next search scans: no block joins anything to the blocks before it, and nothing
    is broadcast. Whether hits are accurate and how large clusters are follows from all outcomes at the end.
    Similarities have 6 digits; of equal entries the earliest counts.
    """
    spark = records.sparkSession
    asked = records.where("embedding is not null").select(F.col("seq").cast("long").alias("seq"), "embedding", "intent")
    folder, played = new_path(spark, "replay"), new_path(spark, "replayed")
    # Block -1 are the seeds.
    number = F.greatest(F.lit(-1), F.floor((F.col("n") - seeds - 1) / block).cast("int"))
    numbered(asked, ["seq"]).withColumn("block", number).drop("n").repartition("block").write.partitionBy("block").parquet(folder)
    read = lambda path, schema=asked.schema: spark.read.schema(schema).parquet(path)
    total = read(folder).count()
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("intent", "embedding")}
    outcome = f"threshold double, seq long, intent {kinds['intent']}, entry_seq long, similarity double, hit boolean, embedding {kinds['embedding']}"
    seeded = read(f"{folder}/block=-1") if min(seeds, total) > 0 else spark.createDataFrame([], asked.schema)
    paths = []
    for place, threshold in enumerate(map(float, thresholds) if total > seeds else ()):
        paths.append(f"{played}/{place}")
        for start in range(seeds, total, block):
            part = read(f"{folder}/block={(start - seeds) // block}")
            entries = seeded.select(F.col("seq").alias("doc_id"), "embedding")
            if start > seeds:
                entries = entries.unionByName(read(paths[-1], outcome).where("not hit").select(F.col("seq").alias("doc_id"), "embedding"))
            best = ranking.dense(entries, part.select(F.col("seq").alias("query_id"), "embedding"), 1)
            best = best.select(F.col("query_id").alias("seq"), F.col("doc_id").alias("entry_id"), F.col("score").alias("similarity"))
            pairs = part.groupBy(F.lit("")).cogroup(best.groupBy(F.lit("")))
            pairs.applyInPandas(_play(threshold), outcome).write.mode("append").parquet(paths[-1])
    every = spark.read.schema(outcome).parquet(*paths) if paths else spark.createDataFrame([], outcome)
    every = every.drop("embedding").join(read(folder).select(F.col("seq").alias("entry_seq"), F.col("intent").alias("_intent")), "entry_seq", "left")
    accurate = F.col("hit") & F.coalesce(F.col("intent") == F.col("_intent"), F.lit(False))
    every = every.select("threshold", "seq", "entry_seq", "similarity", "hit", accurate.alias("accurate"))
    sized = numbered(every, ["seq"], by=["threshold", "entry_seq"], name="cluster_size", of=F.col("hit").cast("long"))
    return sized.withColumn("cluster_size", F.when(F.col("entry_seq").isNull(), 0).otherwise(F.col("cluster_size") + 1))


def metrics(replayed: DataFrame, by: Sequence[str] = ("threshold",)) -> DataFrame:
    """Rates, latency and similarity of replayed rows(hit, accurate, similarity), by threshold."""
    n, hits, right = F.count("*"), F.count_if("hit"), F.count_if("accurate")
    ratio = lambda a, b, d=0.0: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(d)), 6)
    saved = hits * (FULL_MS - HIT_MS)
    return replayed.groupBy(*by).agg(
        n.alias("evaluated"), hits.alias("hits"), (n - hits).alias("misses"), right.alias("accurate_hits"), (hits - right).alias("false_positive_hits"),
        ratio(hits, n).alias("hit_rate"), ratio(right, n).alias("effective_hit_rate"), ratio(right, hits, 1.0).alias("hit_precision"), ratio(hits - right, n).alias("accuracy_impact"),
        F.round(saved, 6).alias("latency_savings_ms"), ratio(saved, n * FULL_MS).alias("latency_savings_rate"), F.round(F.avg("similarity"), 6).alias("mean_best_similarity"),
    )


def llm_tokens(query: Column | str, answer: Column | str, overhead: int = OVERHEAD_TOKENS) -> Column:
    return tx.estimate_tokens_ceil(query) + tx.estimate_tokens_ceil(answer) + max(0, overhead)


def recommended(results: DataFrame, precision: float = 0.95, impact: float = 0.05, prefer: float = 0.95) -> DataFrame:
    """The threshold to use: ``prefer`` if it is safe enough, else the safe one that hits most (the higher among equals), else the most precise one."""
    safe = (F.col("hit_precision") >= precision) & (F.col("accuracy_impact") <= impact)
    order = F.struct(
        F.when(safe & (F.col("threshold") == prefer), 2).when(safe, 1).otherwise(0).alias("a"),
        F.when(safe, F.col("effective_hit_rate")).otherwise(F.col("hit_precision")).alias("b"),
        F.when(safe, F.col("threshold")).otherwise(-F.col("accuracy_impact")).alias("c"),
    )
    return results.agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def decision(results: DataFrame, hit_rate: float = 0.30, precision: float = 0.95, impact: float = 0.05) -> DataFrame:
    """The recommended threshold and ``decision_gate``: reject if it misses any of the three targets, else candidate."""
    best = recommended(results, precision, impact)
    missed = (F.col("effective_hit_rate") < hit_rate) | (F.col("accuracy_impact") > impact) | (F.col("hit_precision") < precision)
    return best.withColumn("decision_gate", F.when(missed, "reject").otherwise("candidate"))


def stub_answer(sources: Column, substrings: Column) -> Column:
    """The answer that a replay stores: its sources and up to three markers."""
    joined = lambda c, none: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, ", ")).otherwise(none)
    return F.concat(F.lit("Stub answer grounded in "), joined(sources, "unknown source"), F.lit("; expected markers: "), joined(F.slice(substrings, 1, 3), "no markers"), F.lit("."))


def replay_records(items: DataFrame, minimum: int, augment: int = 2) -> DataFrame:
    """items(item_id, question, intent) as records: the questions first, then rounds of variants up to max(minimum, n * (1 + augment)): seq, item_id, query, intent, variant."""
    n = items.count()
    target = max(minimum, n * (1 + augment))
    rounds = -(-target // n) if n else 0
    every = numbered(items, ["item_id"], name="_n").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(max(0, rounds - 1)))))
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("", "Подскажите, ", "Пожалуйста, ", "Скажите, ")]), F.when(F.col("variant") > 0, (F.col("variant") - 1) % 3 + 2).otherwise(1))
    seq = F.col("variant") * n + F.col("_n") - 1
    return every.select(seq.cast("long").alias("seq"), "item_id", F.concat(prefix, F.col("question")).alias("query"), "intent", "variant").where(F.col("seq") < target)

"""Measures of classification and of retrieval."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import masking
from lodestone.functions import text as tx

STATUSES = ("Да", "Нет", "Частично", "НД")


def normal_id(c: Column | str) -> Column:
    """Ids as trimmed text, whole numbers without a fraction."""
    return F.regexp_replace(tx.strip((F.col(c) if isinstance(c, str) else c).cast("string")), r"^(-?\d+)\.0+\z", "$1")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, in the order of a column."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_last"))
    return last.select("_last.*")


def matched(gold: DataFrame, predicted: DataFrame, classes: Sequence[str] = STATUSES, order: str = "ord") -> DataFrame:
    """gold(id, status) and predicted(id, status) side by side: id, actual, predicted, side (both, missing, extra), valid.

    Of rows with one id the last counts: by the column ``order`` where there is one, else as the rows are read. Blank ids are left out.
    """

    def one_each(rows: DataFrame, name: str) -> DataFrame:
        at = F.col(order) if order in rows.columns else F.monotonically_increasing_id()
        rows = rows.select(normal_id("id").alias("id"), F.struct(tx.strip("status").alias(name)).alias("_s"), at.alias("_at")).where(~tx.blank("id"))
        return rows.groupBy("id").agg(F.max_by("_s", "_at").alias("_s")).select("id", f"_s.{name}")

    g, p = one_each(gold, "actual"), one_each(predicted, "predicted")
    side = F.when(F.col("p.id").isNull(), "missing").when(F.col("g.id").isNull(), "extra").otherwise("both")
    valid = F.coalesce(F.col("actual").isin(*classes) & F.col("predicted").isin(*classes), F.lit(False))
    return g.alias("g").join(p.alias("p"), F.col("g.id") == F.col("p.id"), "full_outer").select(F.coalesce("g.id", "p.id").alias("id"), "actual", "predicted", side.alias("side"), valid.alias("valid"))


def class_metrics(pairs: DataFrame, classes: Sequence[str] = STATUSES, strict: bool = False) -> DataFrame:
    """class, tp, fp, fn, support, precision, recall, f1 of every class. Strict: an actual row without a prediction is a miss.

    0 / 0 is 0; a class that is absent has zeros. All classes are counted in one aggregation.
    """
    kept = pairs.where("side = 'both' and valid") if not strict else pairs.where("side <> 'extra'")
    a, p = F.coalesce("actual", F.lit("")), F.coalesce("predicted", F.lit(""))
    sums = [F.count_if(x).alias(f"{n}{k}") for k, c in enumerate(classes) for n, x in (("tp", (a == c) & (p == c)), ("fp", (a != c) & (p == c)), ("fn", (a == c) & (p != c)))]
    flat = kept.agg(*sums)
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"), F.col(f"fn{k}").alias("fn")) for k, c in enumerate(classes)])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))
    out = flat.select(F.inline(rows)).withColumns({"support": tp + fn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def quality(pairs: DataFrame, classes: Sequence[str] = STATUSES, strict: bool = False) -> DataFrame:
    """One row: gold_total, matched, missing, extra, invalid, accuracy and macro_f1 (over all classes, absent ones counting 0)."""
    per = class_metrics(pairs, classes, strict).agg(F.round(F.sum("f1") / len(classes), 6).alias("macro_f1"))
    right = F.count_if((F.col("side") == "both") & F.col("valid") & (F.col("actual") == F.col("predicted")))
    gold = F.count_if(F.col("side") != "extra")
    both = F.count_if((F.col("side") == "both") & F.col("valid"))
    totals = pairs.agg(
        gold.alias("gold_total"), both.alias("matched"), F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra"),
        F.count_if((F.col("side") == "both") & ~F.col("valid")).alias("invalid"), F.round(F.coalesce(F.try_divide(right, gold if strict else both), F.lit(0.0)), 6).alias("accuracy"),
    )
    return totals.crossJoin(F.broadcast(per))  # one row each


def summary(pairs: DataFrame, classes: Sequence[str] = STATUSES, shown: int = 10) -> str:
    """The evaluation as text. What is read by the driver is a row a class, one of totals and ``shown`` ids of each side."""
    q = quality(pairs, classes).first()
    lines = [f"Matched records: {q.matched} / {q.gold_total}", f"Macro-F1: {q.macro_f1:.3f}", f"Accuracy: {q.accuracy:.3f}", "Per-class F1:"]
    per = {r["class"]: r for r in class_metrics(pairs, classes).collect()}
    lines += [f"  {c}: F1={per[c].f1:.2f} (P={per[c].precision:.2f}, R={per[c].recall:.2f}, support={per[c].support})" for c in classes]
    for side, title, n in (("missing", "Missing in predictions", q.missing), ("extra", "Unknown in predictions", q.extra)):
        if n:
            ids = [r.id for r in pairs.where(F.col("side") == side).orderBy("id").limit(shown).collect()]
            lines.append(f"{title}: {', '.join(ids)}" + (f", … (+{n - shown})" if n > shown else ""))
    return "\n".join([*lines, f"Unknown statuses: {q.invalid}"] if q.invalid else lines)


def missed_gates(report: DataFrame, least: Mapping[str, float]) -> DataFrame:
    """gate, value, least, passed of a one-row report's columns."""
    rows = F.array(*[F.struct(F.lit(c).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(v)).alias("least"), (F.col(c) >= v).alias("passed")) for c, v in least.items()])
    return report.select(F.inline(rows))


def csv_report(pairs: DataFrame, classes: Sequence[str] = STATUSES) -> DataFrame:
    """section, position, line of the evaluation as CSV: a line a class, an empty one, and the totals. Lines end with a carriage return."""
    per = class_metrics(pairs, classes)
    number = lambda c: F.format_string("%.4f", F.col(c))
    rows = per.select(F.lit(1).alias("section"), F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")).alias("position"), F.concat_ws(",", "class", *[F.col(c).cast("string") for c in ("support", "tp", "fp", "fn")], *map(number, ("precision", "recall", "f1"))).alias("line"))
    total = quality(pairs, classes).withColumn("pred_total", F.col("gold_total") - F.col("missing") + F.col("extra"))
    named = [F.concat(F.lit("macro_f1,"), number("macro_f1")), F.concat(F.lit("accuracy,"), number("accuracy")), *[F.concat(F.lit(f"{c},"), F.col(c).cast("string")) for c in ("matched", "gold_total", "pred_total")]]
    ends = total.select(F.lit(2).alias("section"), F.posexplode(F.array(F.lit(""), *named)).alias("position", "line"))
    top = pairs.sparkSession.createDataFrame([(0, 0, "label,support,tp,fp,fn,precision,recall,f1")], "section int, position long, line string")
    return top.unionByName(rows).unionByName(ends).withColumn("line", F.concat("line", F.lit("\r")))


def json_report(pairs: DataFrame, classes: Sequence[str] = STATUSES) -> DataFrame:
    """section, position, line of the evaluation as JSON, indented by two; ids that have no match, in order, have a line each, so there may be any number."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}\z", 1)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    total = quality(pairs, classes).withColumn("pred_total", F.col("gold_total") - F.col("missing") + F.col("extra"))
    fields = F.array(F.lit("{"), *[F.concat(F.lit(f'  "{c}": '), F.col(c).cast("string"), F.lit(",")) for c in ("matched", "gold_total", "pred_total")], *[F.concat(F.lit(f'  "{c}": '), F.round(c, 4).cast("string"), F.lit(",")) for c in ("macro_f1", "accuracy")], F.lit('  "per_class": {'))
    head = total.select(F.lit(0).alias("section"), F.posexplode(fields).alias("position", "line"))
    numbers = [F.concat(F.lit(f'"{c}": '), F.col(c).cast("string")) for c in ("support", "tp", "fp", "fn", "precision", "recall", "f1")]
    per = class_metrics(pairs, classes).withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})
    per = per.select(F.lit(1).alias("section"), place.alias("position"), F.concat(F.lit("    "), text("class"), F.lit(": {"), F.concat_ws(", ", *numbers), F.when(place < len(classes), "},").otherwise("}")).alias("line"))
    out = head.unionByName(per)
    for section, (side, name) in enumerate((("missing", "missing_in_pred"), ("extra", "extra_in_pred")), 2):
        rows = pairs.where(F.col("side") == side).select("id")
        last = rows.agg(F.max("id").alias("_last"))
        listed = rows.crossJoin(F.broadcast(last))  # one row
        listed = listed.select(F.lit(section).alias("section"), F.col("id").alias("_id"), F.concat(F.lit("    "), text("id"), F.when(F.col("id") < F.col("_last"), ",").otherwise("")).alias("line"))
        opened = pairs.sparkSession.createDataFrame([(section, None, ('  },' if section == 2 else "  ],") + f'\n  "{name}": [')], "section int, _id string, line string")
        out = (out if "_id" in out.columns else out.withColumn("_id", F.lit(None).cast("string"))).unionByName(opened.unionByName(listed).withColumn("position", F.lit(0)))
    end = pairs.sparkSession.createDataFrame([(4, 0, None, "  ]\n}")], "section int, position int, _id string, line string")
    return out.unionByName(end.select(*out.columns)).select("section", "position", F.coalesce("_id", F.lit("")).alias("id"), "line")


def record_report(report: DataFrame) -> DataFrame:
    """position, line of a one-row report as JSON, sanitised and indented by two."""
    clean = report.select(masking.sanitize(F.struct(*report.columns), T.StructType(report.schema.fields)).alias("r"))
    value = lambda n: F.regexp_extract(F.to_json(F.struct(F.col(f"r.{n}").alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}\z", 1)
    names = report.columns
    fields = [F.concat(F.lit(f'  "{n}": '), value(n), F.lit("," if n != names[-1] else "")) for n in names]
    return clean.select(F.posexplode(F.array(F.lit("{"), *fields, F.lit("}"))).alias("position", "line"))


def confusion(pairs: DataFrame, classes: Sequence[str] = STATUSES) -> DataFrame:
    """actual, predicted, n for every pair of classes."""
    seen = pairs.where("side = 'both' and valid").groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    grid = pairs.sparkSession.createDataFrame([(a, p) for a in classes for p in classes], "actual string, predicted string")
    return grid.join(seen, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hit_ranks(golden: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """query_id and rank of the first of the k hits(query_id, rank, source) from golden(query_id, expected_sources); null where there is none."""
    expected = golden.select("query_id", F.explode_outer(F.transform("expected_sources", F.lower)).alias("source"))
    best = hits.where(F.col("rank") <= k).select("query_id", F.lower("source").alias("source"), "rank").join(expected, ["query_id", "source"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return golden.select("query_id").join(best, "query_id", "left")


def retrieval(ranks: DataFrame) -> DataFrame:
    """questions, hits, hit_rate and mrr; zeros without questions."""
    n = F.greatest(F.count("*"), F.lit(1))
    return ranks.agg(F.count("*").alias("questions"), F.count("rank").alias("hits"), F.round(F.count("rank") / n, 6).alias("hit_rate"), F.round(F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)) / n, 6).alias("mrr"))


def context_recall(golden: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """query_id, needles, found and recall of golden(query_id, expected_substrings) in the joined text of k hits(query_id, rank, text); 1 without needles."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
    joined = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.lower(F.array_join(F.transform(rows, lambda r: r["text"]), "\n")).alias("_context"))
    out = golden.join(joined, "query_id", "left")
    needles = F.coalesce("expected_substrings", F.array().cast("array<string>"))
    found = F.filter(needles, lambda n: F.contains(F.coalesce("_context", F.lit("")), F.lower(n)))
    out = out.select("query_id", F.size(needles).alias("needles"), F.size(found).alias("found"))
    return out.withColumn("recall", F.round(F.when(F.col("needles") > 0, F.col("found") / F.col("needles")).otherwise(1.0), 6))

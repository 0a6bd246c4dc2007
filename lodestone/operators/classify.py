"""From retrieved contexts to validated classifications: gate, prompt, provider, payload, and what is counted."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import masking
from lodestone.functions import text as tx
from lodestone.operators.quality import STATUSES

ERROR = "Ошибка"
REVIEW_BELOW = 0.75
PAYLOAD = "classification string, confidence string, reasoning string, citations array<struct<source:string,section:string,quote:string>>, requires_ba_review boolean, recommendations string"
#: (system prompt, user message) -> raw answer
Provider = Callable[[str, str], str]


def gate(contexts: DataFrame, minimum: float = 0.30, score: str = "score", enabled: bool = True) -> DataFrame:
    """contexts(query_id, chunks: array of structs) plus gate: why no model is to be asked, or null.

    ``empty_context`` without chunks; ``low_score`` where every chunk's number is below ``minimum``; chunks without numbers pass.
    """
    best = F.array_max(F.transform("chunks", lambda c: c[score].cast("double")))
    three = lambda c: F.format_string("%.3f", c)
    low = F.concat(F.lit("low_score(max="), three(best), F.lit(" < "), three(F.lit(float(minimum))), F.lit(")"))
    why = F.when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, "empty_context").when(best < minimum, low)
    return contexts.withColumn("gate", why if enabled else F.lit(None).cast("string"))


def context_text(chunks: Column | str) -> Column:
    """``[source — page]`` and text of each chunk(source, page, text), with a blank line between."""
    chunks = F.col(chunks) if isinstance(chunks, str) else chunks
    head = lambda c: F.concat(F.lit("["), F.coalesce(c["source"], F.lit("unknown")), F.when(~tx.blank(c["page"]), F.concat(F.lit(" — "), c["page"])).otherwise(""), F.lit("]"))
    blocks = F.transform(chunks, lambda c: F.concat(head(c), F.lit("\n"), tx.strip(tx.text_or_empty(c["text"]))))
    return F.when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, "(контекст отсутствует)").otherwise(F.array_join(blocks, "\n\n"))


def user_message(requirement: Column, context: Column, requirement_id: Column) -> Column:
    ident = F.when(~tx.blank(requirement_id), F.concat(F.lit(' id="'), requirement_id, F.lit('"'))).otherwise("")
    return F.concat(F.lit("<requirement"), ident, F.lit(">"), requirement, F.lit("</requirement>\n<context>\n"), context, F.lit("\n</context>\nRespond with the JSON object only."))


def stub(system: str, user: str) -> str:
    """The offline provider: nothing is known."""
    return json.dumps({"classification": "НД", "confidence": 0.0, "reasoning": "Провайдер не настроен: требуется ручная проверка.", "citations": [], "requires_ba_review": True, "recommendations": ""}, ensure_ascii=False)


def extract_json(raw: Column | str) -> Column:
    """The text if it is JSON, else what is from the first ``{`` to the last ``}`` if that is; else null."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & (tx.strip(c) != ""), c)
    return F.coalesce(valid(raw), valid(inner))


def validate(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` plus payload (typed), violations (array of codes) and ok.

    Classes are the four known ones; the reasoning must not be blank; the confidence is a number from 0 to 1; all but ``НД``
    need a citation, and citations a source. Review is asked for below a confidence of 0.75 unless the payload says otherwise.
    """
    out = rows.withColumn("_json", extract_json(raw)).withColumn("_p", F.from_json("_json", PAYLOAD))
    p, number = F.col("_p"), F.col("_p.confidence").try_cast("double")
    number = F.when(p["confidence"].isNull(), F.lit(0.0)).otherwise(number)
    cited = F.coalesce(p["citations"], F.array().cast("array<struct<source:string,section:string,quote:string>>"))
    checks = [
        (F.col("_json").isNull(), "invalid_json"),
        (F.col("_json").isNotNull() & ~F.coalesce(p["classification"].isin(*STATUSES), F.lit(False)), "invalid_classification"),
        (F.col("_json").isNotNull() & tx.blank(p["reasoning"]), "empty_reasoning"),
        (F.col("_json").isNotNull() & (number.isNull() | (number < 0) | (number > 1)), "invalid_confidence"),
        (F.col("_json").isNotNull() & (p["classification"] != "НД") & (F.size(cited) == 0), "no_citations"),
        (F.exists(cited, lambda c: tx.blank(c["source"])), "citation_without_source"),
    ]
    violations = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks]))
    payload = F.struct(
        p["classification"].alias("classification"), number.alias("confidence"), p["reasoning"].alias("reasoning"), cited.alias("citations"),
        F.coalesce(p["requires_ba_review"], number < REVIEW_BELOW).alias("requires_ba_review"), F.coalesce(p["recommendations"], F.lit("")).alias("recommendations"),
    )
    out = out.withColumn("violations", violations).withColumn("ok", F.size("violations") == 0)
    return out.withColumn("payload", F.when(F.col("ok"), payload)).drop("_json", "_p")


def validate_reflection(raw: Column | str) -> Column:
    """(sufficient, follow_up, confidence) of a judge's JSON; null unless sufficient is a JSON boolean and the confidence is from 0 to 1."""
    text = extract_json(raw)
    flag, sure = F.get_json_object(text, "$.sufficient"), F.get_json_object(text, "$.confidence").try_cast("double")
    quoted = text.rlike(r'"sufficient"\s*:\s*"')
    fine = flag.isin("true", "false") & ~quoted & sure.between(0, 1)
    follow = F.get_json_object(text, "$.follow_up")
    return F.when(fine, F.struct((flag == "true").alias("sufficient"), F.when(~tx.blank(follow), tx.strip(follow)).alias("follow_up"), sure.alias("confidence")))


def classify(requests: DataFrame, providers: Mapping[str, Provider], order: Sequence[str], system: str = "", retries: int = 1, retriable: tuple = (ConnectionError, TimeoutError), wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests(query_id, text, chunks, gate) -> query_id, gate, status, confidence, reasoning, citations, requires_ba_review, provider, error.

    Gated and blank rows never reach a provider. Prompts are masked. Providers are tried in order, each ``retries`` times for the errors
    that are worth it, after waits that grow; an answer that doesn't validate moves on to the next; unknown names are skipped. One row's failure is its own.
    The result calls providers each time it is computed: write it before it is used twice.
    """
    prompt = masking.mask(user_message(tx.text_or_empty("text"), context_text("chunks"), F.col("query_id").cast("string")))
    todo = requests.where("gate is null").where(~tx.blank("text")).select("query_id", prompt.alias("prompt"))
    chain = [(n, providers[n]) for n in order if n in providers]

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lodestone.operators import providers as providers_

        for frame in frames:
            rows = []
            for qid, text in zip(frame.query_id, frame.prompt, strict=True):
                tries, failures = [], []
                for name, call in chain:
                    said = providers_.tried(name, call, system, text, retries, retriable, wait, failures)
                    if said is not None:
                        tries.append((name, said))
                rows += [(qid, k, n, r, "; ".join(failures)) for k, (n, r) in enumerate(tries)] or [(qid, 0, None, None, "; ".join(failures) or "no provider")]
            yield pd.DataFrame(rows, columns=["query_id", "_try", "provider", "raw", "_failure"])

    answers = validate(todo.mapInPandas(ask, "query_id long, _try int, provider string, raw string, _failure string"))
    chosen = answers.groupBy("query_id").agg(
        F.min_by(F.struct("payload", "provider"), F.when(F.col("ok"), F.col("_try"))).alias("_a"),
        F.concat_ws("; ", F.max("_failure"), F.array_join(F.flatten(F.collect_list("violations")), ", ")).alias("_why"),
    )
    out = requests.join(chosen, "query_id", "left")
    p, blank = F.col("_a.payload"), tx.blank("text")
    error = F.when(F.col("gate").isNotNull(), F.lit(None)).when(blank, "empty requirement").when(p.isNull(), F.coalesce(F.nullif("_why", F.lit("")), F.lit("invalid payload")))
    none = F.array().cast("array<struct<source:string,section:string,quote:string>>")
    return out.withColumn("error", error).select(
        "query_id", "gate",
        F.when(F.col("gate").isNotNull(), "НД").when(F.col("error").isNotNull(), ERROR).otherwise(p["classification"]).alias("status"),
        F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"),
        F.when(F.col("gate").isNotNull(), F.concat(F.lit("Контекст не прошёл проверку: "), F.col("gate"))).otherwise(F.coalesce(p["reasoning"], F.lit(""))).alias("reasoning"),
        F.coalesce(p["citations"], none).alias("citations"),
        F.coalesce(p["requires_ba_review"], F.lit(True)).alias("requires_ba_review"),
        F.when(F.col("gate").isNotNull(), "strict_mode").otherwise(F.coalesce("_a.provider", F.lit("none"))).alias("provider"),
        "error",
    )


def pipeline_stats(results: DataFrame) -> DataFrame:
    """total, success, errors, nd (part of success) and by_provider of results(status, provider)."""
    per = results.groupBy(F.coalesce("provider", F.lit("none")).alias("provider")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == ERROR).alias("e"), F.count_if(F.col("status") == "НД").alias("nd"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - F.col("e")), F.lit(0)).alias("success"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("nd"), F.lit(0)).alias("nd"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "n")))).alias("by_provider"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def retry_merge(rows: DataFrame, redone: DataFrame, key: Sequence[str] = ("sheet", "row"), columns: Sequence[str] = ("status", "comment", "confidence", "run_id")) -> DataFrame:
    """``rows`` with the error rows' columns patched from ``redone`` by key; rows that weren't errors stay."""
    new = redone.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_redone")).dropDuplicates(list(key))
    out = rows.join(new, list(key), "left")
    hit = F.coalesce(F.col("_redone"), F.lit(False)) & (F.col("status") == ERROR)
    return out.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])

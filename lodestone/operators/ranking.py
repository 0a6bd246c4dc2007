"""BM25 and dense retrieval, reciprocal-rank fusion, parent contexts, multi-hop merging and rewrites.

A hit has query_id, a document key, score and rank (from 1). Scores are rounded to 6 digits before they order anything, and ties
go to the smaller key, so that the order in which a cluster adds numbers can't change a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans.sizing import broadcast_if_small, is_small
from lodestone.plans.tables import new_path, read_part, written

K1, B = 1.5, 0.75
RRF_K = 60
PARENT_CHARS = 6000
#: Query vectors that are held by every task at once, and vectors that they meet at once.
QUERY_BLOCK, DENSE_ROWS = 4096, 1024
#: Vectors that a task holds while all queries pass.
HELD_ROWS = 65_536


def ranked(hits: DataFrame, k: int | None, *ties: str) -> DataFrame:
    """Positions by descending score; at most ``k`` of a query where k is given."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *ties))
    out = hits.withColumn("rank", order)
    return out if k is None else out.where(F.col("rank") <= max(0, k))


def term_statistics(docs: DataFrame) -> DataFrame:
    """term, df, cf and idf over documents(doc_id, text)."""
    words = docs.select("doc_id", F.explode(tx.tokens("text")).alias("term"))
    n = docs.count()
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per_doc = words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("idf", F.round(idf, 6))


def postings_of(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """A kept index of documents(doc_id, text): term, doc_id, tf, dl, of all terms or of those in ``terms``(term), read from a written table.

    Each document has one more row, of the term ``''``, which no text has, so that documents and their lengths are counted out of the same
    pass over the texts. Only these rows are shuffled: documents' words meet the terms before they are counted.
    """
    rows = docs.select("doc_id", tx.tokens("text").alias("_w")).select("doc_id", F.size("_w").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "_w")).alias("term"))
    if terms is not None:
        every = terms.select("term").distinct()
        marked = every.unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
        rows = rows.join(broadcast_if_small(marked), "term")
    return written(rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), "postings")


def with_documents(index: DataFrame, docs: DataFrame) -> DataFrame:
    """A kept index with more documents, which replace those of the same doc_id; texts without words are left out."""
    new = postings_of(docs.where(F.size(tx.tokens("text")) > 0))
    return written(index.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new), "postings")


def by_terms(kept: DataFrame) -> DataFrame:
    """A kept index by documents (``lexical.kept``) as postings: term, doc_id, tf, dl, with a row of the term ``''`` for each document."""
    each = F.explode(F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(1).alias("tf"))), F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf"))))
    return kept.select("doc_id", "dl", each.alias("_p")).select("_p.term", "doc_id", F.col("_p.tf").cast("long").alias("tf"), "dl")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf of queries(query_id, text)."""
    return queries.select("query_id", F.explode(tx.tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(postings: DataFrame, wanted: DataFrame, df: DataFrame, n: int, words: int, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score above 0 by BM25 of postings(term, doc_id, tf, dl) for wanted(query_id, term, qtf), given df(term, df) and how many documents and words there are."""
    mean = words / max(1, n)
    weighted = wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    # As many rows as query words at most, and only these are counted.
    weighted = F.broadcast(weighted) if is_small(wanted) else weighted
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean if mean else F.lit(1.0)))
    return postings.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def _by_documents(docs: DataFrame | None, queries: DataFrame, index: DataFrame | None) -> tuple[DataFrame, DataFrame] | None:
    """A kept index by documents and query words, where documents can stay whole: ids are whole numbers, and no index by terms was given."""
    from lodestone.operators import lexical

    if index is not None and "terms" not in index.columns:
        return None
    if not lexical.whole_numbers(queries.schema["query_id"].dataType, (docs if index is None else index).schema["doc_id"].dataType):
        return None
    wanted = written(query_terms(queries), "wanted")
    return (lexical.kept(docs, wanted) if index is None else index, wanted) if lexical.fits(wanted) else None


def bm25_scores(docs: DataFrame | None, queries: DataFrame, index: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score of all of documents(doc_id, text), or of a kept ``index`` of them, that share a word with one of queries(query_id, text)."""
    from lodestone.operators import lexical

    whole = _by_documents(docs, queries, index)
    if whole is not None:
        return lexical.bm25(*whole, None, k1, b)
    wanted = query_terms(queries)
    index = postings_of(docs, wanted) if index is None else by_terms(index) if "terms" in index.columns else index
    n, words = index.where("term = ''").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return scores(index, wanted, index.groupBy("term").agg(F.count("*").alias("df")), n, words, k1, b)


def bm25(docs: DataFrame | None, queries: DataFrame, k: int | None = 5, k1: float = K1, b: float = B, index: DataFrame | None = None) -> DataFrame:
    """The best of documents(doc_id, text), or of a kept ``index`` of them, for each of queries(query_id, text).

    A query word that is repeated counts again. Texts are cut into words once; everything else reads the written postings of query words.
    Where ids are whole numbers documents stay whole (``lexical``); a kept index is of either kind, ``lexical.kept`` or ``postings_of``.
    """
    from lodestone.operators import lexical

    whole = _by_documents(docs, queries, index) if k is not None and k > 0 else None
    if whole is not None:
        return lexical.bm25(*whole, k, k1, b)
    return ranked(bm25_scores(docs, queries, index, k1, b), k, "doc_id")


def _unit_rows(vectors: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of unit length, or of zeros; with ``width``, cut or filled up to it after scaling."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    wide = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), wide))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    norms = np.linalg.norm(out, axis=1)
    out /= np.where(norms > 0, norms, 1.0)[:, None]
    if width is None or width == wide:
        return out
    return out[:, :width] if width < wide else np.pad(out, ((0, 0), (0, width - wide)))


def query_blocks(queries: DataFrame, label: str = "query-vectors") -> tuple[str, int]:
    """Writes queries(query_id, embedding, …) in blocks of about QUERY_BLOCK that tasks read: (folder, number of blocks)."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    path = new_path(queries.sparkSession, label)
    queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
    return path, blocks


def held_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """A task's rows in tables of some ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def best_pairs(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query's pairs: by score, of equal ones the smaller document."""
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], d[keep], s[keep]


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The nearest of vectors(doc_id, embedding) for each of queries(query_id, embedding) by cosine similarity.

    Vectors are read once: a task holds some of its rows at a time and takes all queries past them, block by block from where they are
    written, and keeps the k best of its rows for each. Zero vectors have similarity 0; vectors of another length than the
    query's are compared over the shorter one. ``neighbours`` has an index of vectors for many searches.
    """
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    path, blocks = query_blocks(queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held_rows(batches, HELD_ROWS):
            who = rows["doc_id"].to_numpy()
            for block in range(blocks):
                asked = read_part(path, f"block={block}", ["query_id", "embedding"])
                if asked is None:
                    continue
                ids, unit = asked["query_id"].to_numpy(), _unit_rows(asked["embedding"])
                q, d, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for a in range(0, rows.num_rows, DENSE_ROWS):
                    sims = np.round(_unit_rows(rows["embedding"].slice(a, DENSE_ROWS), unit.shape[1]) @ unit.T, 6)
                    least = np.partition(sims, -k, axis=0)[-k] if len(sims) > k else np.full(len(ids), -np.inf)
                    i, j = np.nonzero(sims >= least)
                    q, d, s = best_pairs(np.concatenate([q, j]), np.concatenate([d, who[a + i]]), np.concatenate([s, sims[i, j]]), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(d), pa.array(s)], ["query_id", "doc_id", "score"])

    rows = vectors.where("embedding is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return ranked(rows.mapInArrow(nearest, "query_id long, doc_id long, score double"), k, "doc_id")


def nearest_of_few(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score: the nearest of a few vectors(doc_id, embedding), at most ``QUERY_BLOCK``, for each of any number of queries(query_id, embedding)."""
    path = new_path(vectors.sparkSession, "few-vectors")
    few = vectors.where("embedding is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    few.coalesce(1).write.parquet(f"{path}/all")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = read_part(path, "all", ["doc_id", "embedding"])
        if held is None or not held.num_rows:
            return
        held = held.sort_by("doc_id")
        ids, unit = held["doc_id"].to_numpy(), _unit_rows(held["embedding"])
        for batch in batches:
            for a in range(0, batch.num_rows, DENSE_ROWS):
                part = batch.slice(a, DENSE_ROWS)
                sims = np.round(_unit_rows(part.column("embedding"), unit.shape[1]) @ unit.T, 6)
                at = sims.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("query_id"), pa.array(ids[at]), pa.array(sims[np.arange(len(at)), at])], ["query_id", "doc_id", "score"])

    rows = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(nearest, "query_id long, doc_id long, score double")


def result_key(chunk_id: Column, source: Column, page: Column, text: Column) -> Column:
    """``id::`` key where there is an id, else one of source, page and text."""
    return F.when(~tx.blank(chunk_id), F.concat(F.lit("id::"), chunk_id)).otherwise(F.concat_ws("::", F.lit("sp"), F.coalesce(source, F.lit("")), F.coalesce(page, F.lit("")), F.coalesce(text, F.lit(""))))


def keyed(hits: DataFrame) -> DataFrame:
    """hits(chunk_id?, source, page, text) plus ``key``, under which lists of several searches are fused."""
    ident = F.col("chunk_id").cast("string") if "chunk_id" in hits.columns else F.lit(None).cast("string")
    return hits.withColumn("key", result_key(ident, F.col("source"), F.col("page").cast("string"), F.col("text")))


def fuse(lists: Sequence[DataFrame], key: str = "doc_id", k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists(query_id, key, rank): sum of 1 / (k + rank), with first_list and first_rank.

    A key that a list repeats counts at each of its ranks. Ties: the list that comes first, then the better rank there.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    every = None
    for number, hits in enumerate(lists):
        part = hits.select("query_id", key, F.col("rank").cast("int").alias("_rank"), F.lit(number).alias("_list"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("_rank"))), 6).alias("score"), F.min(F.struct("_list", "_rank")).alias("_first"))
    fused = fused.select("query_id", key, "score", F.col("_first._list").alias("first_list"), F.col("_first._rank").alias("first_rank"))
    return ranked(fused, top, "first_list", "first_rank", key)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 5, rrf_k: int = RRF_K, index: DataFrame | None = None, candidates: int | None = -1) -> DataFrame:
    """BM25 and dense hits fused and cut to k; the dense similarity is attached where there is one.

    Each list is cut to ``candidates`` first, 2k by default; None fuses all that BM25 finds with all vectors (``fusion.uncut``).
    """
    if candidates is None:
        from lodestone.operators import fusion

        return fusion.uncut(docs, vectors, queries, query_vectors, k, rrf_k, index)[0]
    cut = 2 * k if candidates == -1 else candidates
    near = written(dense(vectors, query_vectors, cut), "near")
    fused = fuse([bm25(docs, queries, cut, index=index), near], "doc_id", rrf_k, k)
    return fused.join(near.select("query_id", "doc_id", F.col("score").alias("similarity")), ["query_id", "doc_id"], "left")


def collapse_parents(hits: DataFrame, limit: int = PARENT_CHARS) -> DataFrame:
    """One context per (query_id, parent_id) of hits(query_id, doc_id, parent_id, text, parent_text, score, rank).

    The best-ranked child lends its text where there is no parent text; the score is the children's greatest; contexts are
    numbered in the order in which their first child is ranked.
    """
    child = F.struct("rank", "doc_id", "score")
    body = F.coalesce(F.when(~tx.blank("parent_text"), F.col("parent_text")), F.col("text"))
    grouped = hits.groupBy("query_id", "parent_id").agg(
        F.min("rank").alias("_at"),
        F.max("score").alias("score"),
        F.min_by("doc_id", "rank").alias("doc_id"),
        tx.bounded(F.min_by(body, "rank"), limit).alias("text"),
        F.transform(F.array_sort(F.collect_list(child)), lambda c: c["doc_id"]).alias("children"),
    )
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "parent_id"))
    return grouped.withColumn("rank", order).drop("_at")


def parent_search(search: Callable[[DataFrame], DataFrame], passages: DataFrame, k: int, limit: int = PARENT_CHARS) -> Callable[[DataFrame], DataFrame]:
    """A search for passages(doc_id, parent_id, text, parent_text) that returns their parents, once each, at most ``k`` of a query."""

    def found(queries: DataFrame) -> DataFrame:
        hits = search(queries).select("query_id", "doc_id", "score", "rank")
        return collapse_parents(hits.join(passages.select("doc_id", "parent_id", "text", "parent_text"), "doc_id"), limit).where(F.col("rank") <= max(0, k))

    return found


def append_new(known: DataFrame, more: DataFrame, key: Sequence[str] = ("query_id", "doc_id")) -> DataFrame:
    """``known`` followed by the rows of ``more`` whose key is neither there nor earlier in ``more``. ``known`` is taken as it is."""
    key = list(key)
    first = F.row_number().over(Window.partitionBy(*key).orderBy("hop", "rank"))
    fresh = more.withColumn("_n", first).where("_n = 1").drop("_n").join(known.select(*key).distinct(), key, "left_anti")
    return known.unionByName(fresh)


#: (queries with query_id and text, hits so far) -> query_id, sufficient, confidence, follow_up
Reflect = Callable[[DataFrame, DataFrame], DataFrame]


def multi_hop(search: Callable[[DataFrame], DataFrame], queries: DataFrame, reflect: Reflect, max_hops: int = 2, enough: float = 0.8) -> DataFrame:
    """Hits of up to ``max_hops`` rounds. All queries advance together; one stops when the judge finds its hits sufficient with
    confidence ``enough``, gives no new follow-up, or gives no answer. Columns are the search's plus hop.
    """
    current = queries.select("query_id", "text")
    asked = current.select("query_id", F.lower(tx.collapse("text")).alias("_asked"))
    # The judge, the next hop and the merge read a hop's hits: they are written once.
    found = written(search(current).withColumn("hop", F.lit(1)), "hop")
    for hop in range(2, max_hops + 1):
        answer = reflect(current, found).where(~(F.col("sufficient") & (F.col("confidence") >= enough)) & ~tx.blank("follow_up"))
        fresh = answer.select("query_id", F.col("follow_up").alias("text"), F.lower(tx.collapse("follow_up")).alias("_asked")).join(asked, ["query_id", "_asked"], "left_anti")
        fresh = written(fresh, "follow-ups")
        current = fresh.select("query_id", "text")
        asked = asked.unionByName(fresh.select("query_id", "_asked"))
        found = written(append_new(found, search(current).withColumn("hop", F.lit(hop))), "hops")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "rank"))
    return found.withColumn("position", order)


def parse_rewrites(answers: DataFrame, most: int = 4) -> DataFrame:
    """query_id, variant, text out of answers(query_id, text, answer): a JSON list of strings or of objects with ``query``, or such a list
    under ``queries``, ``expansions`` or ``rewrites``, with or without a code fence. Doubles and the original are left out.
    """
    bare = F.regexp_replace(tx.strip("answer"), r"(?s)^```[a-zA-Z]*\s*|\s*```\z", "")
    lists = [F.from_json(bare, "array<string>"), *(F.from_json(F.get_json_object(bare, f"$.{k}"), "array<string>") for k in ("queries", "expansions", "rewrites"))]
    items = answers.select("query_id", "text", F.posexplode(F.coalesce(*lists, F.array().cast("array<string>"))).alias("_pos", "_item"))
    said = tx.collapse(F.coalesce(F.get_json_object("_item", "$.query"), F.col("_item")))
    items = items.withColumn("_said", said).withColumn("_key", F.lower("_said")).where(~tx.blank("_said") & (F.col("_key") != F.lower(tx.collapse("text"))))
    first = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("_pos"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("_pos"))
    return items.withColumn("_n", first).where("_n = 1").withColumn("variant", order).where(F.col("variant") <= most).select("query_id", "variant", F.col("_said").alias("text"))


def expanded(search: Callable[[DataFrame], DataFrame], queries: DataFrame, rewrites: DataFrame, top: int = 5, k: int = RRF_K) -> DataFrame:
    """Hits of the query and its rewrites(query_id, variant, text), fused; a query without rewrites keeps its own hits and scores.

    Variants run as queries of one plan, numbered query_id * 16 + variant.
    """
    plain = queries.select(F.col("query_id").alias("_q"), F.lit(0).alias("_v"), "text").unionByName(rewrites.select(F.col("query_id").alias("_q"), F.col("variant").alias("_v"), "text"))
    hits = search(plain.select((F.col("_q") * 16 + F.col("_v")).alias("query_id"), "text"))
    hits = written(hits.select(F.floor(F.col("query_id") / 16).cast("long").alias("query_id"), (F.col("query_id") % 16).cast("int").alias("variant"), "doc_id", "score", "rank"), "variants")
    many = rewrites.select("query_id").distinct()
    alone = hits.join(many, "query_id", "left_anti").where(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank")
    several = hits.join(many, "query_id", "left_semi")
    fused = several.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("variant", "rank")).alias("_first"))
    return ranked(fused.select("query_id", "doc_id", "score", "_first"), top, "_first", "doc_id").select("query_id", "doc_id", "score", "rank").unionByName(alone)


def composed(search: Callable[[DataFrame], DataFrame], k: int, reflect: Reflect | None = None, rewrite: Callable[[DataFrame], DataFrame] | None = None, passages: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """parents(rewrites(hops(search))), each only where it is given: a judge, a source of rewrites, passages with parents.

    What the hops and the parents find is numbered anew from 1, as ``rank``.
    """
    inner = search
    if reflect is not None:
        hops = search

        def inner(queries: DataFrame) -> DataFrame:
            return multi_hop(hops, queries, reflect).select("query_id", "doc_id", "score", F.col("position").alias("rank"))

    outer = inner
    if rewrite is not None:

        def outer(queries: DataFrame) -> DataFrame:
            return expanded(inner, queries, rewrite(queries), k)

    return outer if passages is None else parent_search(outer, passages, k)


def reflection_prompt(question: Column, current: Column, chunks: Column) -> Column:
    """A judge's message: the question, the present query where it differs, and numbered chunks(source, chunk_idx, page, text)."""

    def block(c: Column, i: Column) -> Column:
        ident = F.when(c["chunk_idx"].isNotNull(), F.concat(F.lit(" chunk_idx="), c["chunk_idx"].cast("string"))).otherwise("")
        page = F.when(~tx.blank(c["page"]), F.concat(F.lit(" page="), c["page"])).otherwise("")
        source = F.coalesce(F.nullif(c["source"], F.lit("")), F.lit("unknown"))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] source="), source, ident, page, F.lit("\n"), tx.strip(tx.text_or_empty(c["text"])))

    context = F.when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, "(no context)").otherwise(F.array_join(F.transform(chunks, block), "\n\n"))
    now, asked = tx.strip(tx.text_or_empty(current)), tx.strip(tx.text_or_empty(question))
    query = F.when((now != asked) & (tx.text_or_empty(current) != ""), F.concat(F.lit("\n<current_query>"), now, F.lit("</current_query>"))).otherwise("")
    return F.concat(F.lit("<question>"), asked, F.lit("</question>"), query, F.lit("\n\n<context>\n"), context, F.lit("\n</context>"))


def rewrite_prompt(text: Column | str, most: int) -> Column:
    """The message that asks for rewrites of a query."""
    return F.concat(F.lit("<query>"), tx.strip(tx.text_or_empty(text)), F.lit(f"</query>\nReturn exactly {most} query rewrites as a JSON array of strings."))


def page_label(page: Column, section: Column, chapter: Column) -> Column:
    """The first of page, section and chapter that isn't blank; ``''`` where none is."""
    return F.coalesce(*[F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit("")) for c in (page, section, chapter)], F.lit(""))


def overlap_search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Documents by the number of distinct white-space tokens that they share with the query."""
    from lodestone.operators import lexical

    tokens = tx.whitespace_tokens(F.lower("text"))
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens)).alias("term"))
    if k > 0 and lexical.whole_numbers(queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType) and lexical.fits(wanted):
        return lexical.best(lexical.kept(docs, wanted, tokens), wanted.select("query_id", "term", F.lit(1.0).alias("w")), k)
    held = docs.select("doc_id", F.explode(F.array_distinct(tokens)).alias("term"))
    return ranked(held.join(broadcast_if_small(wanted), "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score")), k, "doc_id")

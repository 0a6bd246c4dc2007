"""The registered queries of the library's operators, each with SQL that states its rows independently."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import masking, vectors
from lodestone.functions import text as tx
from lodestone.operators import atoms, cache, chat, classify, dependencies, export, growing, ledger, lexical, neighbours, providers, pruned, quality, ranking, sections
from lodestone.plans import builds, flows
from lodestone.plans.scans import Run, scan
from lodestone.plans.sizing import broadcast_if_small
from lodestone.plans.tables import new_path, written
from lodestone.sources import formats, office
from lodestone.streaming import conversations as arriving_turns
from lodestone.streaming import requirements as arriving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RUN_ID = "6f1c2b1e-3a4d-4c55-9a77-0b5c9f1e2d3a"
WORD = r"[\p{L}\p{N}\p{M}_]+"
_STRIPPED = r"regexp_replace(regexp_replace({}, '^[\s\x0b\x85\p{{Z}}]+', ''), '[\s\x0b\x85\p{{Z}}]+$', '')".format


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- text ----------------------------------------------------------------------------------------------------------


@query(rf"""
SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{WORD}'), lambda x: lower(x)) AS w FROM documents)
""")
def tokenize_stats(spark, sf_dir):
    w = _t(spark, sf_dir, "documents").select("doc_id", tx.tokens("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


_TF = rf"""
words AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS term FROM documents),
tf AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY ALL),
stats AS (SELECT count(*) AS n, (SELECT count(*) FROM words) / count(*) AS mean FROM documents)
"""


@query(f"""
WITH {_TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
FROM tf, stats GROUP BY term
""")
def term_statistics(spark, sf_dir):
    return ranking.term_statistics(_t(spark, sf_dir, "documents"))


def _bm25_sql(queries: str, name: str = "bm25", k: int | None = 5) -> str:
    cut = f"WHERE rank <= {k}" if k else ""
    return rf"""
{name}_q AS (SELECT query_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS term FROM ({queries})),
{name}_s AS (
  SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM (SELECT query_id, term, count(*) AS qtf FROM {name}_q GROUP BY ALL)
  JOIN tf USING (term) JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)
  JOIN (SELECT doc_id, count(*) AS dl FROM words GROUP BY doc_id) USING (doc_id), stats GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s WHERE score > 0) {cut})
"""


_ITEMS = "SELECT item_id AS query_id, text FROM benchmark"


@query(f"WITH {_TF}, {_bm25_sql(_ITEMS)} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_topk(spark, sf_dir):
    return ranking.bm25(_t(spark, sf_dir, "documents"), _items(spark, sf_dir), 5)


@query(SQL["bm25_topk"])
def pruned_topk(spark, sf_dir):
    return pruned.bm25(_t(spark, sf_dir, "documents"), _items(spark, sf_dir), 5)[0]


def _dense_sql(queries: str, k: int) -> str:
    return f"""
dense AS (SELECT * FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.query_id, d.vec_id AS doc_id,
      round(list_inner_product(q.e, d.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 6) AS score
    FROM ({queries}) q, embeddings d)) WHERE rank <= {k})
"""


@query(f"WITH {_dense_sql('SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0', 5)} SELECT query_id, doc_id, score, rank, round(1 / (1 + sqrt(greatest(0, 2 - 2 * score))), 6) AS similarity FROM dense")
def dense_topk(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    hits = ranking.dense(e, e.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 5)
    return hits.withColumn("similarity", F.round(vectors.distance_similarity(F.sqrt(F.greatest(F.lit(0), 2 - 2 * F.col("score")))), 6))


@query(f"WITH {_dense_sql('SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0', 5)} SELECT query_id, doc_id, score, rank FROM dense")
def cells_topk(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return neighbours.Cells.build(e).search(e.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 5)[0]


@query(rf"""
WITH words AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS term FROM documents),
buckets AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 7))::BIGINT % 256)::INT AS bucket, count(*) AS n FROM words GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM buckets
""")
def hash_embed(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", tx.tokens("text").alias("w"))
    return vectors.hashed_counts(docs, "doc_id", "w").withColumn("weight", F.round("weight", 6))


_HYBRID = f"""
WITH {_TF}, {_bm25_sql(_ITEMS, k=10)}, {_dense_sql('SELECT item_id AS query_id, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = item_id', 10)},
lists AS (SELECT query_id, doc_id, rank, 0 AS list FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 1 FROM dense),
summed AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(list * 100000 + rank) AS first FROM lists GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM summed) WHERE rank <= 5)
"""


def _hybrid(spark, sf_dir, **more):
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    items = _items(spark, sf_dir)
    near = e.withColumnRenamed("doc_id", "query_id").join(broadcast_if_small(items.select("query_id")), "query_id")
    return ranking.hybrid(_t(spark, sf_dir, "documents"), e, items, near, 5, **more)


@query(f"{_HYBRID} SELECT f.query_id, f.doc_id, f.score, f.rank, d.score AS similarity FROM fused f LEFT JOIN dense d USING (query_id, doc_id)")
def hybrid_rrf_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "doc_id", "score", "rank", "similarity")


_UNCUT = _HYBRID.replace("WHERE rank <= 10)\n", ")\n").replace("WHERE rank <= 10),", "),")


@query(f"{_UNCUT} SELECT f.query_id, f.doc_id, f.score, f.rank, d.score AS similarity FROM fused f LEFT JOIN dense d USING (query_id, doc_id)")
def hybrid_uncut(spark, sf_dir):
    return _hybrid(spark, sf_dir, candidates=None).select("query_id", "doc_id", "score", "rank", "similarity")


@query(f"""
WITH {_TF}, {_bm25_sql(_ITEMS, k=5)},
o AS (SELECT q.query_id, d.doc_id, count(*)::DOUBLE AS score FROM (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS token FROM benchmark) q
  JOIN (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS token FROM documents) d USING (token) GROUP BY ALL),
overlap AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o QUALIFY rank <= 5),
lists AS (SELECT query_id, doc_id, rank, 0 AS list FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 1 FROM overlap),
named AS (SELECT l.*, CASE WHEN doc_id % 2 = 0 THEN 'id::' || doc_id ELSE 'sp::' || d.source || '::' || d.lang || '::' || coalesce(d.text, '') END AS key FROM lists l JOIN documents d USING (doc_id)),
summed AS (SELECT query_id, key, round(sum(1.0 / (60 + rank)), 6) AS score, min(list * 100000 + rank) AS first FROM named GROUP BY ALL)
SELECT query_id, sha256(key) AS key_sha256, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, key) AS rank FROM summed) WHERE rank <= 5
""")
def fused_by_key(spark, sf_dir):
    docs, items = _t(spark, sf_dir, "documents"), _items(spark, sf_dir)
    named = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("chunk_id"), "source", F.col("lang").alias("page"), "text")
    lists = [ranking.keyed(hits.select("query_id", "doc_id", "rank").join(named, "doc_id")) for hits in (ranking.bm25(docs, items, 5), ranking.overlap_search(docs, items, 5))]
    return ranking.fuse(lists, key="key", top=5).select("query_id", tx.sha256("key").alias("key_sha256"), "score", "rank")


_VARIANTS = f"""
SELECT item_id * 16 AS query_id, text FROM benchmark UNION ALL
SELECT item_id * 16 + 1, array_to_string(list_slice(w, 1, len(w) // 2), ' ') FROM (SELECT item_id, regexp_extract_all(text, '{WORD}') AS w FROM benchmark) UNION ALL
SELECT item_id * 16 + 2, array_to_string(list_slice(w, len(w) // 2 + 1, len(w)), ' ') FROM (SELECT item_id, regexp_extract_all(text, '{WORD}') AS w FROM benchmark)
"""


def _search5(spark, sf_dir, k=5):
    docs = _t(spark, sf_dir, "documents")
    return lambda q: ranking.bm25(docs, q, k)


def _halves(items):
    w = F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0))
    half = F.floor(F.size(w) / 2).cast("int")
    cut = F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))
    return items.select("query_id", F.posexplode(cut).alias("variant", "text")).withColumn("variant", F.col("variant") + 1)


@query(f"""
WITH {_TF}, {_bm25_sql(_VARIANTS, k=5)},
summed AS (SELECT query_id // 16 AS query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min((query_id % 16) * 100000 + rank) AS first FROM bm25 GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM summed) WHERE rank <= 5
""")
def rrf_multi_list(spark, sf_dir):
    items = _items(spark, sf_dir)
    return ranking.expanded(_search5(spark, sf_dir), items, _halves(items), 5)


@query(f"""
WITH {_TF}, {_bm25_sql(_ITEMS, k=20)},
hits AS (SELECT b.query_id, b.doc_id, b.score, b.rank, d.source || '::' || d.lang AS parent_id, d.text FROM bm25 b JOIN documents d USING (doc_id)),
grouped AS (SELECT query_id, parent_id, min(rank) AS best, max(score) AS score, arg_min(doc_id, rank) AS doc_id, arg_min(text, rank) AS text, string_agg(doc_id, ',' ORDER BY rank) AS children FROM hits GROUP BY ALL)
SELECT query_id, parent_id, score, doc_id, children, row_number() OVER (PARTITION BY query_id ORDER BY best, parent_id) AS rank,
  sha256(CASE WHEN length(text) > 6000 THEN regexp_replace(substr(text, 1, 6000), '\\s+$', '') ELSE text END) AS text_sha256 FROM grouped
""".replace("\\\\", "\\"))
def parent_collapse(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    hits = ranking.bm25(docs, _items(spark, sf_dir), 20).join(docs.select("doc_id", "text", F.concat_ws("::", "source", "lang").alias("parent_id"), F.lit(None).cast("string").alias("parent_text")), "doc_id")
    out = ranking.collapse_parents(hits)
    return out.select("query_id", "parent_id", "score", "doc_id", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"), "rank", tx.sha256("text").alias("text_sha256"))


@query(f"""
WITH {_TF}, {_bm25_sql(_ITEMS, 'one', 5)},
follow AS (SELECT o.query_id, d.text FROM one o JOIN documents d USING (doc_id) WHERE rank = 1 AND o.query_id % 2 = 0),
{_bm25_sql('SELECT * FROM follow', 'two', 5)},
fresh AS (SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.query_id = two.query_id AND one.doc_id = two.doc_id))
SELECT query_id, doc_id, score, rank, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop, rank) AS position
FROM (SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM fresh)
""")
def multi_hop_merge(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")

    def judge(queries, hits):
        top = hits.where("rank = 1").join(docs.select("doc_id", "text"), "doc_id")
        return top.select("query_id", (F.col("query_id") % 2 == 1).alias("sufficient"), F.lit(0.9).alias("confidence"), F.col("text").alias("follow_up"))

    return ranking.multi_hop(_search5(spark, sf_dir), _items(spark, sf_dir), judge).select("query_id", "doc_id", "score", "rank", "hop", "position")


@query(r"""
WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS token FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS token FROM documents),
s AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM q JOIN d USING (token) GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5
""")
def overlap_topk(spark, sf_dir):
    return ranking.overlap_search(_t(spark, sf_dir, "documents"), _items(spark, sf_dir), 5)


# --- masking -------------------------------------------------------------------------------------------------------

_PHONE = r"(\+7|8)[\s\-]?\(?[0-9]{3}\)?[\s\-]?[0-9]{3}[\s\-]?[0-9]{2}[\s\-]?[0-9]{2}"


def _mask_sql(c: str) -> str:
    email, _, ip, domain = (r[1] for r in masking.RULES)
    q = lambda p: p.replace("'", "''")
    c = f"regexp_replace({c}, '{q(email)}', '[EMAIL]', 'g')"
    for _ in range(2):
        c = f"regexp_replace({c}, '(^|[^0-9]){_PHONE}([^0-9]|$)', '\\1[PHONE]\\3', 'g')"
    return f"regexp_replace(regexp_replace({c}, '{q(ip)}', '[IP]', 'g'), '{q(domain)}', '[DOMAIN]', 'g')"


@query(f"SELECT doc_id, sha256({_mask_sql('text')}) AS masked_sha256 FROM documents")
def mask_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.sha256(masking.mask("text")).alias("masked_sha256"))


@query(f"SELECT conv_id, turn, {_mask_sql('text')} AS text FROM conversations")
def mask_conversations(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", masking.mask("text").alias("text"))


def _pii_sql() -> str:
    """Matches of each rule on what the rules before it leave, as the number of replacements that are new."""
    email, _, ip, domain = (r[1].replace("'", "''") for r in masking.RULES)
    phone = lambda c: f"regexp_replace({c}, '(^|[^0-9]){_PHONE}([^0-9]|$)', '\\1[PHONE]\\3', 'g')"
    times = lambda c, mark: f"(length({c}) - length(replace({c}, '{mark}', ''))) // {len(mark)}"
    return f"""
WITH a AS (SELECT source, coalesce(text, '') AS t0 FROM documents), b AS (SELECT *, regexp_replace(t0, '{email}', '[EMAIL]', 'g') AS t1 FROM a),
c AS (SELECT *, {phone(phone('t1'))} AS t2 FROM b), d AS (SELECT *, regexp_replace(t2, '{ip}', '[IP]', 'g') AS t3 FROM c), e AS (SELECT *, regexp_replace(t3, '{domain}', '[DOMAIN]', 'g') AS t4 FROM d)
SELECT source, sum({times('t1', '[EMAIL]')} - {times('t0', '[EMAIL]')})::BIGINT AS email, sum({times('t2', '[PHONE]')} - {times('t1', '[PHONE]')})::BIGINT AS phone_ru,
  sum({times('t3', '[IP]')} - {times('t2', '[IP]')})::BIGINT AS ip_address, sum({times('t4', '[DOMAIN]')} - {times('t3', '[DOMAIN]')})::BIGINT AS internal_domain FROM e GROUP BY source
"""


@query(_pii_sql())
def pii_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(*[F.sum(c).alias(name) for name, c in masking.counts("text").items()])


@query("""
SELECT event_id, 'EVENT ' || array_to_string(list_filter(['status="' || event_type || '"', 'page=' || to_json(json_extract_string(props, '$.page')), 'ref=' || to_json(json_extract_string(props, '$.ref')), 'value=' || value], lambda x: x IS NOT NULL), ' ') AS line FROM (SELECT event_id, event_type, props, CAST(user_id AS VARCHAR) AS value FROM events)
""")
def audit_lines(spark, sf_dir):
    record = _t(spark, sf_dir, "events").select("event_id", F.struct(F.col("user_id").alias("value"), F.get_json_object("props", "$.ref").alias("ref"), F.get_json_object("props", "$.page").alias("page"), F.col("event_type").alias("status")).alias("r"))
    return record.select("event_id", masking.audit_line(F.lit("EVENT"), F.col("r"), record.schema["r"].dataType).alias("line"))


@query("""
SELECT event_id, event_type, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events
""")
def audit_events(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    record = events.select("event_id", F.struct("event_type", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref")).alias("r"))
    return record.select("event_id", masking.sanitize(F.col("r"), record.schema["r"].dataType).alias("r")).select("event_id", "r.event_type", "r.page", "r.ref")


# --- sections and chunks -------------------------------------------------------------------------------------------


def _page_text(spark, sf_dir):
    """Pages as Markdown: the heading as ``# ``, paragraphs as lines, scripts and tags left out."""
    c = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    c = F.regexp_replace(F.regexp_replace(c, r"<h1>", "\n# "), r"</h1>|</p>|<br>|</li>|</div>", "\n")
    return _t(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".md")).alias("source"), F.lit(1).alias("page_number"), F.regexp_replace(c, r"<[^>]*>", "").alias("text"))


_PAGES = r"""
pg AS (SELECT 'page-' || page_id || '.md' AS source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<h1>', chr(10) || '# ', 'g'), '</h1>|</p>|<br>|</li>|</div>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages),
marked AS (SELECT source, regexp_replace(text, '(?m)^(#{1,6}[ \t]+\S|[\s]*\d+(?:\.\d+){0,4}\.?\s+[^\n]{1,200}$|(?i:\s*(?:Раздел|Section)\s+\d+(?:\.\d+){0,4}\s+[^\n]{1,200}$)|\s*[A-ZА-ЯЁ][A-ZА-ЯЁ0-9 \-]{4,}$)', chr(1) || '\1', 'g') AS text FROM pg),
secs AS (SELECT source, regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '') AS section, pos FROM (SELECT source, unnest(string_split(text, chr(1))) AS s, unnest(range(len(string_split(text, chr(1))))) AS pos FROM marked)),
kept AS (SELECT source, section, (row_number() OVER (PARTITION BY source ORDER BY pos) - 1)::INT AS section_pos FROM secs WHERE section <> '')
"""


@query(f"WITH {_PAGES} SELECT source, section_pos, sha256(section) AS section_sha256 FROM kept")
def section_split(spark, sf_dir):
    return _page_text(spark, sf_dir).select("source", F.posexplode(sections.split_sections("text")).alias("section_pos", "s")).select("source", "section_pos", tx.sha256("s").alias("section_sha256"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 64, 1), 448)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, (s // 448)::INT AS window_pos, len(list_slice(w, s + 1, s + 512))::INT AS n_words, sha256(array_to_string(list_slice(w, s + 1, s + 512), ' ')) AS chunk_sha256 FROM s
""")
def chunk_windows(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(sections.windows(tx.whitespace_tokens("text"), 512, 64)).alias("window_pos", "t"))
    return docs.select("doc_id", "window_pos", (F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1).alias("n_words"), tx.sha256("t").alias("chunk_sha256"))


def _line_chunks(spark, sf_dir):
    """Each line of a document as a chunk, two to a page; a line that begins with a one-letter word is taken as a numbered heading."""
    return _propagated(_t(spark, sf_dir, "documents").select(F.concat(F.lit("kb-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_idx", "line")))


def _propagated(lines):
    head = F.col("line").rlike("^[A-Za-z] ")
    raw = F.when(head, F.concat((F.col("chunk_idx") + 1).cast("string"), F.lit(".1 "), F.col("line"))).otherwise(F.col("line"))
    lines = lines.select("source", "chunk_idx", F.floor(F.col("chunk_idx") / 2).cast("int").alias("page_number"), raw.alias("text"))
    h = sections.heading("text")
    return sections.propagate(lines.withColumn("_h", h).select("source", "chunk_idx", "page_number", F.col("_h.number").alias("number"), F.col("_h.title").alias("title"), "text"))


_LINES = r"""
ln AS (SELECT 'kb-' || doc_id || '.md' AS source, 'kb ' || doc_id AS fallback, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS chunk_idx FROM documents),
ch AS (SELECT source, fallback, chunk_idx, (chunk_idx // 2)::INT AS page_number, CASE WHEN regexp_matches(line, '^[A-Za-z] ') THEN (chunk_idx + 1) || '.1 ' || line ELSE line END AS text FROM ln),
hd AS (SELECT *, nullif(regexp_extract(text, '(?m)^\s*(\d+(?:\.\d+){0,4})\.?\s+([A-ZА-ЯЁ][^\n]{0,200})', 1), '') AS number,
  substr(regexp_replace(trim(regexp_replace(regexp_extract(text, '(?m)^\s*(\d+(?:\.\d+){0,4})\.?\s+([A-ZА-ЯЁ][^\n]{0,200})', 2), '\s+', ' ', 'g')), '\.+$', ''), 1, 200) AS title FROM ch),
pr AS (SELECT *, last_value(CASE WHEN number IS NOT NULL THEN {'n': number, 't': title, 'p': page_number} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY chunk_idx ROWS UNBOUNDED PRECEDING) AS l FROM hd),
st AS (SELECT *, CASE WHEN number IS NOT NULL THEN 'heading' WHEN l IS NULL THEN 'unassigned' WHEN page_number - l.p <= 6 THEN 'inherited' ELSE 'stale' END AS state FROM pr)
"""


@query(f"""
WITH {_LINES} SELECT source, chunk_idx, state, CASE WHEN state IN ('heading', 'inherited') THEN l.n ELSE 'document' END AS section_number,
  CASE WHEN state IN ('heading', 'inherited') THEN l.t ELSE fallback END AS section_title FROM st
""")
def section_propagation(spark, sf_dir):
    return _line_chunks(spark, sf_dir).select("source", "chunk_idx", "state", "section_number", "section_title")


@query(f"WITH {_LINES} SELECT count(*) AS chunks, count_if(state = 'heading')::BIGINT AS headings, count_if(state = 'inherited')::BIGINT AS inherited, count_if(state = 'stale')::BIGINT AS stale, count_if(state = 'unassigned')::BIGINT AS unassigned, count_if(state IN ('stale', 'unassigned'))::BIGINT AS fallback FROM st")
def section_stats(spark, sf_dir):
    return sections.section_stats(_line_chunks(spark, sf_dir))


_HOT_LINES = (
    _LINES.replace("'kb-' || doc_id || '.md' AS source, 'kb ' || doc_id AS fallback, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS chunk_idx FROM documents",
    "source, source AS fallback, line, (row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1)::INT AS chunk_idx FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)")
)


@query(f"""
WITH {_HOT_LINES} SELECT source, chunk_idx, state, CASE WHEN state IN ('heading', 'inherited') THEN l.n ELSE 'document' END AS section_number,
  CASE WHEN state IN ('heading', 'inherited') THEN l.t ELSE fallback END AS section_title FROM st
""")
def hot_source_sections(spark, sf_dir):
    """All lines of a source as one file: the largest source has a third of them."""
    lines = _t(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = scan(lines, ["source"], ["doc_id", "pos"], {"n": Run("count")}).withColumn("chunk_idx", (F.col("n") - 1).cast("int"))
    return _propagated(lines).select("source", "chunk_idx", "state", "section_number", "section_title")


_PRODUCTS = (("src1", "Telephony"), ("src10", "Analytics"), ("src2", "Contact centre"), ("kb", "Knowledge base"))


def _products(spark):
    return spark.createDataFrame(list(_PRODUCTS), "prefix string, product string")


@query(f"""
WITH p(prefix, product) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PRODUCTS)})
SELECT doc_id, coalesce((SELECT arg_max(product, length(prefix)) FROM p WHERE starts_with(lower(source), prefix)), 'unknown') AS product FROM documents
""")
def product_inference(spark, sf_dir):
    return sections.infer_product(_t(spark, sf_dir, "documents"), _products(spark)).select("doc_id", "product")


@query(f"WITH {_LINES} SELECT count(*) AS chunks, count_if(page_number > 0 OR true)::BIGINT AS complete, 1.0::DOUBLE AS coverage FROM st".replace("count_if(page_number > 0 OR true)::BIGINT", "count_if(CASE WHEN state IN ('heading', 'inherited') THEN trim(l.t) <> '' ELSE true END)::BIGINT").replace("1.0::DOUBLE", "round(coalesce(avg((CASE WHEN state IN ('heading', 'inherited') THEN trim(l.t) <> '' ELSE true END)::INT), 0), 6)"))
def metadata_coverage(spark, sf_dir):
    chunks = _line_chunks(spark, sf_dir)
    return sections.coverage(sections.metadata(sections.infer_product(chunks, _products(spark))))


@query(f"""
WITH {_LINES}, ids AS (SELECT source, chunk_idx, text, source || '::' || CASE WHEN state IN ('heading', 'inherited') THEN l.n || '::' || l.t ELSE 'document::' || fallback END AS parent_id FROM st)
SELECT source, parent_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx)) AS parent_sha256 FROM ids GROUP BY ALL
""")
def parent_text(spark, sf_dir):
    chunks = _line_chunks(spark, sf_dir).withColumn("parent_id", sections.parent_id(F.col("source"), F.col("section_number"), F.col("section_title")))
    return sections.parent_texts(chunks).select("source", "parent_id", tx.sha256("parent_text").alias("parent_sha256"))


@query("""
WITH files AS (SELECT source || '_' || doc_id || '.txt' AS filename, sha256(text) AS h, doc_id FROM documents)
SELECT filename, CASE WHEN doc_id % 3 = 0 THEN '2.0' ELSE '1.0' END AS version, h AS sha256_hash,
  CASE WHEN doc_id % 2 = 0 THEN '2026-01-02' ELSE '2025-01-01' END AS indexed_date, CASE WHEN doc_id % 2 = 0 THEN 'Indexed' ELSE 'Pending' END AS status,
  CASE WHEN doc_id % 3 = 0 THEN 'full' ELSE '' END AS coverage FROM files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
""")
def source_registry(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), tx.sha256("text").alias("sha256_hash"))
    old = files.where("doc_id % 3 = 0").select("filename", F.lit("2.0").alias("version"), "sha256_hash", F.lit("2025-01-01").alias("indexed_date"), F.lit("Pending").alias("status"), F.lit("full").alias("coverage"))
    return sections.upsert_registry(old, files.where("doc_id % 2 = 0").select("filename", "sha256_hash"), "2026-01-02")


# --- dependencies and atoms ----------------------------------------------------------------------------------------


def _reference_chunks(spark, sf_dir):
    """Lines of the documents with references put before them, as manuals have."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_idx", "line"))
    n, m = F.col("doc_id") % 9 + 1, F.col("chunk_idx") % 7 + 1
    head = F.concat(F.lit("См. раздел "), n.cast("string"), F.lit("."), m.cast("string"), F.lit(". Требуется настройка модуля "), m.cast("string"), F.lit("; "))
    return lines.select(F.concat(F.lit("kb-"), F.col("doc_id").cast("string")).alias("source"), "chunk_idx", F.when(F.col("chunk_idx") % 3 == 0, F.concat(head, "line")).otherwise(F.col("line")).alias("text"))


_REFERENCES = r"""
c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS i FROM documents),
t AS (SELECT 'kb-' || doc_id AS source, i AS chunk_idx, CASE WHEN i % 3 = 0 THEN 'См. раздел ' || (doc_id % 9 + 1) || '.' || (i % 7 + 1) || '. Требуется настройка модуля ' || (i % 7 + 1) || '; ' || line ELSE line END AS text FROM c),
m AS (SELECT *, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}\p{M}_])(см|смотрите|предварительн[\p{L}\p{N}\p{M}_]*|требуется|необходимо|нужно|зависит|зависим[\p{L}\p{N}\p{M}_]*)($|[^\p{L}\p{N}\p{M}_])') AS has_marker,
  CASE WHEN starts_with(text, 'См. раздел') THEN regexp_extract_all(substr(text, 11, 220), '\b[0-9]+(?:\.[0-9]+)+\b') ELSE [] END AS numbers FROM t),
d AS (SELECT source, chunk_idx, has_marker, list_transform(list_filter(numbers, lambda x, k: list_position(numbers, x) = k), lambda x: source || '::' || x) AS related,
  list_filter([regexp_extract(text, 'Требуется (настройка модуля \d+);', 1)], lambda x: x <> '') AS prerequisites FROM m)
"""


@query(f"""
WITH {_REFERENCES} SELECT source, chunk_idx, has_marker, array_to_string(related, ';') AS related, array_to_string(prerequisites, ';') AS prerequisites, CASE WHEN has_marker THEN 'regex' ELSE 'none' END AS method FROM d
""")
def dependency_mining(spark, sf_dir):
    d = dependencies.extract(_reference_chunks(spark, sf_dir))
    return d.select("source", "chunk_idx", "has_marker", dependencies.encode(F.col("related")).alias("related"), dependencies.encode(F.col("prerequisites")).alias("prerequisites"), "method")


@query(f"""
WITH {_REFERENCES} SELECT count(*) AS chunks, count_if(has_marker)::BIGINT AS markers, count_if(has_marker AND len(related) > 0)::BIGINT AS with_related,
  round(CASE WHEN count_if(has_marker) = 0 THEN 1 ELSE count_if(has_marker AND len(related) > 0) / count_if(has_marker) END, 6)::DOUBLE AS coverage FROM d
""")
def dependency_stats(spark, sf_dir):
    return dependencies.stats(dependencies.extract(_reference_chunks(spark, sf_dir)))


def _blocks(spark, sf_dir):
    """Each document's lines as a numbered list: ``1.a``, ``1.b`` and so on under ``1)``."""
    lines = F.split("text", "\n", -1)
    listed = F.transform(lines, lambda line, i: F.concat(F.when(i == 0, F.lit("1) ")).otherwise(F.concat(F.lit("1.x"), i.cast("string"), F.lit(" "))), F.lit("w"), line))
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.array_join(listed, "\n").alias("text"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
p AS (SELECT doc_id, i, CASE WHEN i = 0 THEN '1) ' ELSE '1.x' || i || ' ' END || 'w' || line AS part FROM l),
s AS (SELECT doc_id, i, regexp_replace(part, '[\s\x0b\x85\p{Z}]+$', '') AS text, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, CASE WHEN i = 0 THEN '1' ELSE '1.x' || i END AS marker FROM p)
SELECT doc_id AS block_id, (i + 1)::INT AS span_no, start, start + length(text)::INT AS "end", marker, text FROM s
""")
def atom_spans(spark, sf_dir):
    return atoms.spans(_blocks(spark, sf_dir)).select("block_id", "span_no", "start", "end", "marker", "text")


@query(r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id AS block_id, (i + 1)::INT AS span_no, CASE WHEN i = 0 THEN NULL ELSE 1 END AS parent_no FROM l
""")
def atom_parents(spark, sf_dir):
    rows = atoms.with_parents(atoms.spans(_blocks(spark, sf_dir)).withColumn("parent_marker", F.lit(None).cast("string")))
    ids = rows.select(F.col("atom_id").alias("parent_id"), F.col("span_no").alias("parent_no"))
    return rows.join(ids, "parent_id", "left").select("block_id", "span_no", "parent_no")


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'персональн|152-фз|фз\s*№?\s*152|шифр|безопас|защит') THEN 'security'
  WHEN regexp_matches(lower(text), 'интеграц|api|вебсервис|web[- ]?service|sip|h\.323|crm|мис') THEN 'integration'
  WHEN regexp_matches(lower(text), 'отказоустойчив|доступност|производительн|sla|круглосуточ|n\+1|уровн[ья] защищенности') THEN 'non-functional' ELSE 'functional' END AS type FROM documents
""")
def requirement_type(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", atoms.requirement_type("text").alias("type"))


# --- classification ------------------------------------------------------------------------------------------------


@query(f"""
{_HYBRID}, best AS (SELECT query_id, max(score) AS m FROM fused GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN m IS NULL THEN 'empty_context' WHEN m < 0.03 THEN 'low_score(max=' || printf('%.3f', m) || ' < 0.030)' END AS gate FROM benchmark LEFT JOIN best ON query_id = item_id
""")
def strict_gate(spark, sf_dir):
    hits = _hybrid(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("chunks"))
    return classify.gate(_items(spark, sf_dir).join(hits, "query_id", "left"), minimum=0.03).select("query_id", "gate")


def _answers(spark, sf_dir):
    """A model's answers, made of the labels: some well formed, some not."""
    l = _t(spark, sf_dir, "labels")
    status = F.element_at(F.array(*[F.lit(s) for s in (*quality.STATUSES, "Возможно")]), (F.col("doc_id") % 5 + 1).cast("int"))
    cited = F.when(F.col("toxic") == 1, F.array().cast("array<struct<source:string,section:string,quote:string>>")).otherwise(F.array(F.struct(F.lit("a.md").alias("source"), F.lit("1").alias("section"), F.lit("q").alias("quote"))))
    sure = F.when(F.col("doc_id") % 7 == 0, 1.5).otherwise((F.col("doc_id") % 100) / 100)
    reason = F.when(F.col("quality") == 1, "because").otherwise(" ")
    body = F.to_json(F.struct(status.alias("classification"), sure.alias("confidence"), reason.alias("reasoning"), cited.alias("citations")))
    raw = F.when(F.col("doc_id") % 11 == 0, F.left(body, F.lit(9))).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Answer: "), body, F.lit(" done"))).otherwise(body)
    return l.select(F.col("doc_id").alias("query_id"), raw.alias("raw"))


@query("""
WITH a AS (SELECT doc_id, quality, toxic, ['Да', 'Нет', 'Частично', 'НД', 'Возможно'][(doc_id % 5 + 1)::INT] AS s, CASE WHEN doc_id % 7 = 0 THEN 1.5 ELSE (doc_id % 100) / 100 END AS c FROM labels)
SELECT doc_id AS query_id, CASE WHEN doc_id % 11 = 0 THEN 'invalid_json' ELSE array_to_string(list_filter([
    CASE WHEN s = 'Возможно' THEN 'invalid_classification' END, CASE WHEN quality <> 1 THEN 'empty_reasoning' END, CASE WHEN c > 1 THEN 'invalid_confidence' END,
    CASE WHEN s <> 'НД' AND toxic = 1 THEN 'no_citations' END], lambda x: x IS NOT NULL), ',') END AS violations,
  CASE WHEN doc_id % 11 <> 0 AND s <> 'Возможно' AND quality = 1 AND c <= 1 AND (s = 'НД' OR toxic <> 1) THEN c < 0.75 END AS requires_ba_review FROM a
""")
def classification_validate(spark, sf_dir):
    return classify.validate(_answers(spark, sf_dir)).select("query_id", F.array_join("violations", ",").alias("violations"), F.col("payload.requires_ba_review").alias("requires_ba_review"))


def _results(spark, sf_dir):
    d = F.col("doc_id")
    return _t(spark, sf_dir, "labels").select(
        (d + 1).alias("id"), F.element_at(F.array(*[F.lit(s) for s in (*quality.STATUSES, classify.ERROR)]), (d % 5 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*[F.lit(s) for s in ("stub", "alpha", "strict_mode")]), (d % 3 + 1).cast("int")).alias("provider"), d.alias("doc_id"),
    )


_RESULTS = "res AS (SELECT doc_id + 1 AS id, ['Да', 'Нет', 'Частично', 'НД', 'Ошибка'][(doc_id % 5 + 1)::INT] AS status, ['stub', 'alpha', 'strict_mode'][(doc_id % 3 + 1)::INT] AS provider, doc_id FROM labels)"


@query(f"""
WITH {_RESULTS}, p AS (SELECT provider, count(*) AS n FROM res GROUP BY provider)
SELECT count(*) AS total, count_if(status <> 'Ошибка')::BIGINT AS success, count_if(status = 'Ошибка')::BIGINT AS errors, count_if(status = 'НД')::BIGINT AS nd,
  (SELECT string_agg(provider || '=' || n, ',' ORDER BY provider) FROM p) AS by_provider FROM res
""")
def pipeline_stats(spark, sf_dir):
    s = classify.pipeline_stats(_results(spark, sf_dir))
    return s.withColumn("by_provider", F.array_join(F.transform(F.array_sort(F.map_entries("by_provider")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query(f"WITH {_RESULTS} SELECT status, count(*) AS n FROM res GROUP BY status")
def status_counts(spark, sf_dir):
    return classify.status_counts(_results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT doc_id % 20 AS sheet, id AS row, CASE WHEN status = 'Ошибка' AND id % 2 = 0 THEN 'Да' ELSE status END AS status, CASE WHEN status = 'Ошибка' AND id % 2 = 0 THEN 'retried' ELSE 'first' END AS comment FROM res")
def retry_merge(spark, sf_dir):
    rows = _results(spark, sf_dir).select((F.col("doc_id") % 20).alias("sheet"), F.col("id").alias("row"), "status", F.lit("first").alias("comment"))
    redone = rows.where("row % 2 = 0").withColumns({"status": F.lit("Да"), "comment": F.lit("retried")})
    return classify.retry_merge(rows, redone, columns=("status", "comment"))


@query(f"""
WITH {_TF}, {_bm25_sql(_ITEMS, k=3)}, j AS (SELECT b.query_id, string_agg('[' || d.source || ' — ' || d.lang || ']' || chr(10) || trim(regexp_replace(regexp_replace(d.text, '^\\s+', ''), '\\s+$', '')), chr(10) || chr(10) ORDER BY rank) AS c FROM bm25 b JOIN documents d USING (doc_id) GROUP BY 1)
SELECT item_id AS query_id, sha256('<requirement id="' || item_id || '">' || text || '</requirement>' || chr(10) || '<context>' || chr(10) || coalesce(c, '(контекст отсутствует)') || chr(10) || '</context>' || chr(10) || 'Respond with the JSON object only.') AS prompt_sha256 FROM benchmark LEFT JOIN j ON query_id = item_id
""".replace("\\\\", "\\"))
def prompts(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    hits = ranking.bm25(docs, _items(spark, sf_dir), 3).join(docs.select("doc_id", "source", F.col("lang").alias("page"), "text"), "doc_id")
    c = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "page", "text"))).alias("chunks"))
    rows = _items(spark, sf_dir).join(c, "query_id", "left")
    return rows.select("query_id", tx.sha256(classify.user_message(F.col("text"), classify.context_text("chunks"), F.col("query_id").cast("string"))).alias("prompt_sha256"))


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 4 = 0 THEN 'НД' WHEN doc_id % 4 = 1 THEN 'Да' ELSE 'Ошибка' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'strict_mode' WHEN doc_id % 4 = 1 THEN 'second' ELSE 'none' END AS provider FROM labels")
def classify_requests(spark, sf_dir):
    def broken(system, user):
        return "no json"

    def second(system, user):
        if 'id="' in user and int(user.split('id="')[1].split('"')[0]) % 4 == 1:
            return '{"classification": "Да", "reasoning": "r", "confidence": 0.8, "citations": [{"source": "a.md"}]}'
        raise ConnectionError("down")

    chunk = F.array(F.struct(F.lit("a.md").alias("source"), F.lit("1").alias("page"), F.lit("text").alias("text"), F.when(F.col("doc_id") % 4 == 0, 0.1).otherwise(0.9).alias("score")))
    rows = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 4 == 2, " ").otherwise("needs").alias("text"), chunk.alias("chunks"))
    return classify.classify(classify.gate(rows), {"broken": broken, "second": second}, ["missing", "broken", "second"]).select("query_id", "status", "provider")


# --- quality -------------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """Labels as a gold set, and predictions of which some ids are said twice: the first time otherwise, and once without an id."""
    l = _t(spark, sf_dir, "labels")
    name = lambda c: F.element_at(F.array(*[F.lit(s) for s in (*quality.STATUSES, "?")]), (c % 5 + 1).cast("int"))
    gold = l.where("doc_id % 10 <> 3").select(F.col("doc_id").cast("string").alias("id"), name(F.col("quality") * 2 + F.col("toxic")).alias("status"), F.lit(2).alias("ord"))
    gold = gold.unionByName(l.where("doc_id % 10 = 6").select(F.col("doc_id").cast("string").alias("id"), F.lit("Да").alias("status"), F.lit(1).alias("ord")))
    said = l.where("doc_id % 10 <> 4").select(F.col("doc_id").cast("double").cast("string").alias("id"), name(F.col("doc_id") % 5).alias("status"), F.lit(2).alias("ord"))
    before = l.where("doc_id % 10 in (1, 2)").select(F.when(F.col("doc_id") % 10 == 1, F.col("doc_id").cast("string")).otherwise(" ").alias("id"), F.lit("НД").alias("status"), F.lit(1).alias("ord"))
    return quality.matched(gold, said.unionByName(before))


_PAIRS = """
g1 AS (SELECT doc_id::VARCHAR AS id, ['Да', 'Нет', 'Частично', 'НД', '?'][((quality * 2 + toxic) % 5 + 1)::INT] AS actual, 2 AS ord FROM labels WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id::VARCHAR, 'Да', 1 FROM labels WHERE doc_id % 10 = 6),
p1 AS (SELECT doc_id::VARCHAR AS id, ['Да', 'Нет', 'Частично', 'НД', '?'][(doc_id % 5 + 1)::INT] AS predicted, 2 AS ord FROM labels WHERE doc_id % 10 <> 4
  UNION ALL SELECT CASE WHEN doc_id % 10 = 1 THEN doc_id::VARCHAR ELSE ' ' END, 'НД', 1 FROM labels WHERE doc_id % 10 IN (1, 2)),
g AS (SELECT id, arg_max(actual, ord) AS actual FROM g1 WHERE trim(id) <> '' GROUP BY id), p AS (SELECT id, arg_max(predicted, ord) AS predicted FROM p1 WHERE trim(id) <> '' GROUP BY id),
j AS (SELECT coalesce(g.id, p.id) AS id, actual, predicted, g.id IS NOT NULL AS has_g, p.id IS NOT NULL AS has_p FROM g FULL JOIN p ON g.id = p.id),
v AS (SELECT * FROM j WHERE has_g AND has_p AND actual <> '?' AND predicted <> '?'),
c(class) AS (VALUES ('Да'), ('Нет'), ('Частично'), ('НД'))
"""


def _metrics_sql(rows: str) -> str:
    return f"""
m AS (SELECT class, (SELECT count(*) FROM {rows} WHERE actual = class AND predicted = class) AS tp, (SELECT count(*) FROM {rows} WHERE coalesce(actual, '') <> class AND predicted = class) AS fp,
  (SELECT count(*) FROM {rows} WHERE actual = class AND coalesce(predicted, '') <> class) AS fn FROM c),
k AS (SELECT class, tp, fp, fn, tp + fn AS support, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM m)
"""


@query(f"WITH {_PAIRS}, {_metrics_sql('v')} SELECT * FROM k")
def class_metrics(spark, sf_dir):
    return quality.class_metrics(_pairs(spark, sf_dir))


def _quality_sql(rows: str, total: str) -> str:
    return f"""
WITH {_PAIRS}, {_metrics_sql(rows)}
SELECT count_if(has_g)::BIGINT AS gold_total, (SELECT count(*) FROM v) AS matched, count_if(NOT has_p)::BIGINT AS missing, count_if(NOT has_g)::BIGINT AS extra,
  count_if(has_g AND has_p AND (actual = '?' OR predicted = '?'))::BIGINT AS invalid, round((SELECT count(*) FROM v WHERE actual = predicted) / {total}, 6) AS accuracy,
  (SELECT round(sum(f1) / 4, 6) FROM k) AS macro_f1 FROM j
"""


@query(_quality_sql("v", "(SELECT count(*) FROM v)"))
def quality_metrics(spark, sf_dir):
    return quality.quality(_pairs(spark, sf_dir))


@query(_quality_sql("(SELECT * FROM j WHERE has_g)", "count_if(has_g)"))
def quality_strict(spark, sf_dir):
    return quality.quality(_pairs(spark, sf_dir), strict=True)


@query(f"WITH {_PAIRS} SELECT a.class AS actual, p.class AS predicted, (SELECT count(*) FROM v WHERE actual = a.class AND predicted = p.class) AS n FROM c a, c p")
def confusion_matrix(spark, sf_dir):
    return quality.confusion(_pairs(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT id, CASE WHEN has_g THEN 'missing' ELSE 'extra' END AS side FROM j WHERE NOT (has_g AND has_p)")
def id_mismatch(spark, sf_dir):
    return _pairs(spark, sf_dir).where("side <> 'both'").select("id", "side")


def _golden(spark, sf_dir):
    source = F.concat(F.lit("SRC"), F.col("item_id") % 20)
    needles = F.filter(F.split("text", " "), lambda w: w != "")
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.array(source).alias("expected_sources"), needles.alias("expected_substrings"))


_RANKS = f"WITH {_TF}, {_bm25_sql(_ITEMS, k=5)}, r AS (SELECT item_id AS query_id, (SELECT min(rank) FROM bm25 b JOIN documents d USING (doc_id) WHERE b.query_id = item_id AND lower(d.source) = 'src' || (item_id % 20)) AS rank FROM benchmark)"


def _hits(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return ranking.bm25(docs, _items(spark, sf_dir), 5).join(docs.select("doc_id", "source", "text"), "doc_id")


@query(f"{_RANKS} SELECT query_id, rank FROM r")
def hit_ranks(spark, sf_dir):
    return quality.hit_ranks(_golden(spark, sf_dir), _hits(spark, sf_dir))


@query(f"{_RANKS} SELECT count(*) AS questions, count(rank) AS hits, round(count(rank) / count(*), 6) AS hit_rate, round(coalesce(sum(1.0 / rank), 0) / count(*), 6) AS mrr FROM r")
def hit_rate_mrr(spark, sf_dir):
    return quality.retrieval(quality.hit_ranks(_golden(spark, sf_dir), _hits(spark, sf_dir)))


@query(f"""
WITH {_TF}, {_bm25_sql(_ITEMS, k=5)}, c AS (SELECT query_id, lower(string_agg(text, chr(10) ORDER BY rank)) AS ctx FROM bm25 JOIN documents USING (doc_id) GROUP BY 1),
g AS (SELECT item_id AS query_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS needles FROM benchmark)
SELECT query_id, len(needles)::INT AS needles, len(list_filter(needles, lambda w: contains(coalesce(ctx, ''), lower(w))))::INT AS found,
  round(CASE WHEN len(needles) > 0 THEN len(list_filter(needles, lambda w: contains(coalesce(ctx, ''), lower(w)))) / len(needles) ELSE 1 END, 6) AS recall FROM g LEFT JOIN c USING (query_id)
""")
def context_recall(spark, sf_dir):
    return quality.context_recall(_golden(spark, sf_dir), _hits(spark, sf_dir))


# --- chat ----------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def history_tail(spark, sf_dir):
    return chat.tail(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query(r"""
SELECT conv_id, sha256(string_agg(CASE WHEN lower(role) = 'assistant' THEN 'Ассистент' ELSE 'Пользователь' END || ': ' || regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10) ORDER BY turn)) AS history_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 AND trim(text) <> '' GROUP BY conv_id
""")
def history_render(spark, sf_dir):
    return chat.rendered(chat.tail(_t(spark, sf_dir, "conversations"))).select("conv_id", tx.sha256("history").alias("history_sha256"))


@query(f"""
SELECT conv_id, sha256(string_agg(CASE WHEN lower(role) = 'user' THEN '### Вопрос' ELSE '### Ответ' END || chr(10) || {_mask_sql("regexp_replace(regexp_replace(text, '^[[:space:]]+', ''), '[[:space:]]+$', '')")}, chr(10) || chr(10) ORDER BY turn)) AS markdown_sha256
FROM conversations WHERE lower(role) IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id
""")
def chat_qa_blocks(spark, sf_dir):
    return chat.markdown(_t(spark, sf_dir, "conversations")).select("conv_id", tx.sha256("markdown").alias("markdown_sha256"))


@query(f"""
SELECT conv_id, sha256('\ufeff' || string_agg(CASE WHEN lower(role) = 'user' THEN '### Вопрос' ELSE '### Ответ' END || chr(10) || {_mask_sql("regexp_replace(regexp_replace(text, '^[[:space:]]+', ''), '[[:space:]]+$', '')")}, chr(10) || chr(10) ORDER BY turn)) AS content_sha256
FROM conversations WHERE lower(role) IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id
""")
def chat_files(spark, sf_dir):
    return chat.markdown_files(_t(spark, sf_dir, "conversations")).select("conv_id", F.sha2("content", 256).alias("content_sha256"))


@query("SELECT conv_id, max(turn) FILTER (lower(role) = 'assistant') AS turn FROM conversations GROUP BY conv_id")
def latest_assistant(spark, sf_dir):
    return chat.latest_assistant(_t(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS floor_tokens, greatest(1, ceil(length(coalesce(text, '')) / 4))::BIGINT AS ceil_tokens FROM conversations")
def token_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.estimate_tokens_floor("text").alias("floor_tokens"), tx.estimate_tokens_ceil("text").alias("ceil_tokens"))


@query(f"""
WITH {_TF}, {_bm25_sql(_ITEMS, k=5)}, f AS (SELECT b.query_id, d.source || '.pdf' AS source, arg_min(d.doc_id % 3, rank) AS page FROM bm25 b JOIN documents d USING (doc_id) GROUP BY ALL),
l AS (SELECT query_id, source, '[' || source || CASE WHEN page > 0 THEN ', стр. ' || page ELSE '' END || '](http://kb/' || source || CASE WHEN page > 0 THEN '#page=' || page ELSE '' END || ')' AS link FROM f)
SELECT item_id AS query_id, 'See ' || coalesce((SELECT link FROM l WHERE query_id = item_id AND source = 'src0.pdf'), '[src0.pdf]') || ' and [none.pdf] and [src0.pdf](x).' AS answer FROM benchmark
""")
def citation_links(spark, sf_dir):
    hits = _hits(spark, sf_dir).select("query_id", "rank", F.concat("source", F.lit(".pdf")).alias("source"), (F.col("doc_id") % 3).alias("page"), F.lit("").alias("signature"))
    answers = _items(spark, sf_dir).select("query_id", F.lit("See [src0.pdf] and [none.pdf] and [src0.pdf](x).").alias("answer"))
    return chat.linkify(answers, chat.first_per_source(hits), "http://kb")


@query(f"""
WITH {_TF}, {_bm25_sql(_ITEMS, k=5)}, f AS (SELECT b.query_id, d.source, min(rank) AS best FROM bm25 b JOIN documents d USING (doc_id) GROUP BY ALL)
SELECT query_id, string_agg(source, '; ' ORDER BY best) AS sources, 'НД' AS status FROM f GROUP BY 1
""")
def query_export_rows(spark, sf_dir):
    return chat.export_row(_hits(spark, sf_dir))


# --- cache ---------------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 100 <> 0 AND vec_id % 10 = 1), q AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, round(list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v))), 6) AS similarity, q.label = e.label AS same FROM q, e)
SELECT query_id, entry_id, similarity, similarity >= 0.3 AS hit, similarity >= 0.3 AND same AS accurate FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) = 1
""".replace(" AND vec_id % 10 = 1", ""))
def cache_static(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("intent"))
    return cache.static_replay(e.where("vec_id % 100 <> 0").withColumnRenamed("vec_id", "entry_id"), e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 0.3)


def _records(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), "embedding", F.col("label").alias("intent"))


_SEEDS, _LEVELS = 32, (0.2, 0.3, 0.4)
_SEEDED = f"""
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
s AS (SELECT q.vec_id AS seq, e.vec_id AS entry_seq, round(list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v))), 6) AS similarity, q.label = e.label AS same
  FROM e q, e WHERE q.n > {_SEEDS} AND e.n <= {_SEEDS}),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY seq ORDER BY similarity DESC, entry_seq) = 1),
r AS (SELECT threshold, seq, entry_seq, similarity, similarity >= threshold AS hit, similarity >= threshold AND same AS accurate FROM b, (SELECT unnest([{', '.join(map(str, _LEVELS))}])::DOUBLE AS threshold))
"""
_CACHE_METRICS = f"""
m AS (SELECT threshold, count(*) AS evaluated, count_if(hit)::BIGINT AS hits, count_if(NOT hit)::BIGINT AS misses, count_if(accurate)::BIGINT AS accurate_hits, count_if(hit AND NOT accurate)::BIGINT AS false_positive_hits,
  round(count_if(hit) / count(*), 6) AS hit_rate, round(count_if(accurate) / count(*), 6) AS effective_hit_rate, round(CASE WHEN count_if(hit) = 0 THEN 1 ELSE count_if(accurate) / count_if(hit) END, 6) AS hit_precision,
  round(count_if(hit AND NOT accurate) / count(*), 6) AS accuracy_impact, round(count_if(hit) * {cache.FULL_MS - cache.HIT_MS}::DOUBLE, 6) AS latency_savings_ms,
  round(count_if(hit) * {cache.FULL_MS - cache.HIT_MS}::DOUBLE / (count(*) * {cache.FULL_MS}::DOUBLE), 6) AS latency_savings_rate, round(avg(similarity), 6) AS mean_best_similarity FROM r GROUP BY threshold)
"""


@query(f"WITH {_SEEDED} SELECT threshold, seq, entry_seq, similarity, hit, accurate, (1 + count_if(hit) OVER (PARTITION BY threshold, entry_seq ORDER BY seq))::BIGINT AS cluster_size FROM r")
def cache_seeded(spark, sf_dir):
    return cache.seeded_replay(_records(spark, sf_dir), _SEEDS, _LEVELS).select("threshold", "seq", "entry_seq", "similarity", "hit", "accurate", "cluster_size")


@query()
def cache_replay(spark, sf_dir):
    return cache.online_replay(_records(spark, sf_dir), _SEEDS, _LEVELS)


@query(f"WITH {_SEEDED}, {_CACHE_METRICS} SELECT * FROM m")
def cache_metrics(spark, sf_dir):
    return cache.metrics(cache.seeded_replay(_records(spark, sf_dir), _SEEDS, _LEVELS))


@query(f"""
WITH {_SEEDED}, {_CACHE_METRICS}, o AS (SELECT *, hit_precision >= 0.95 AND accuracy_impact <= 0.05 AS safe FROM m)
SELECT threshold, hit_precision, CASE WHEN effective_hit_rate < 0.3 OR accuracy_impact > 0.05 OR hit_precision < 0.95 THEN 'reject' ELSE 'candidate' END AS decision_gate FROM o
ORDER BY CASE WHEN safe THEN 1 ELSE 0 END DESC, CASE WHEN safe THEN effective_hit_rate ELSE hit_precision END DESC, CASE WHEN safe THEN threshold ELSE -accuracy_impact END DESC LIMIT 1
""")
def cache_decision(spark, sf_dir):
    return cache.decision(cache.metrics(cache.seeded_replay(_records(spark, sf_dir), _SEEDS, _LEVELS))).select("threshold", "hit_precision", "decision_gate")


@query("SELECT conv_id, turn, greatest(1, ceil(length(text) / 4))::BIGINT + greatest(1, ceil(length(role) / 4))::BIGINT + 1200 AS tokens FROM conversations")
def llm_token_cost(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", cache.llm_tokens("text", "role").alias("tokens"))


@query(r"""
WITH r AS (SELECT unnest(range(3)) AS variant), n AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS total FROM benchmark)
SELECT (variant * total + n)::BIGINT AS seq, item_id, array_to_string(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[0-9a-zа-яё]+'), ' ') AS query, variant::INT AS variant FROM n, r
""")
def replay_variants(spark, sf_dir):
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.col("item_id").alias("intent"))
    return cache.replay_records(items, 50).select("seq", "item_id", cache.normal_query("query").alias("query"), "variant")


# --- export --------------------------------------------------------------------------------------------------------


def _export(spark, sf_dir):
    d = F.col("doc_id")
    locator = F.from_json(F.to_json(F.struct(F.lit("cell").alias("type"), F.lit('A"b').alias("sheet_name"), d.alias("row"), F.lit("Требование").alias("column"))), export.LOCATOR)
    rows = _t(spark, sf_dir, "documents").select((d + 1).alias("id"), "text", F.when(d % 3 == 0, "Да").when(d % 3 == 1, "").alias("status"), F.lit("a|b*c").alias("comment"), ((d % 8) / 4).alias("confidence"), F.when(d % 4 == 0, "boom").alias("error"), locator.alias("locator"))
    return export.rows(rows, RUN_ID)


_EXPORT = rf"""
x AS (SELECT doc_id + 1 AS id, 'sheet="A\"b", row=' || doc_id || ', col="Требование"' AS ref, coalesce(text, '') AS source_text,
  CASE WHEN doc_id % 3 = 0 THEN 'Да' WHEN doc_id % 4 = 0 THEN 'Ошибка' ELSE 'НД' END AS status, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN 'Ошибка обработки: boom' ELSE 'a|b*c' END AS comment,
  (doc_id % 8) / 4 AS confidence, '{RUN_ID}' AS run_id FROM documents)
"""


@query(f"WITH {_EXPORT} SELECT * FROM x")
def export_rows(spark, sf_dir):
    return _export(spark, sf_dir)


@query(f"WITH {_EXPORT} SELECT id, array_to_string(list_filter([CASE WHEN confidence > 1 THEN 'confidence' END, CASE WHEN NOT regexp_matches(source_text, '[^\\s\\x0b\\x85\\p{{Z}}]') THEN 'text' END], lambda v: v IS NOT NULL), ',') AS violations FROM x")
def export_violations(spark, sf_dir):
    return export.violations(_export(spark, sf_dir)).select("id", F.array_join("violations", ",").alias("violations"))


def _cell_sql(c: str) -> str:
    for a, b in (("'\\'", "'\\\\'"), ("'|'", "'\\|'"), ("'*'", "'\\*'"), ("chr(13) || chr(10)", "'<br>'"), ("chr(10)", "'<br>'"), ("chr(13)", "'<br>'")):
        c = f"replace({c}, {a}, {b})"
    return rf"regexp_replace(regexp_replace({c}, '^[\s\x0b\x85\p{{Z}}]+', ''), '[\s\x0b\x85\p{{Z}}]+$', '')"


_MARKDOWN = rf"""
md AS (SELECT id, '| ' || id || ' | ' || {_cell_sql('ref')} || ' | ' || {_cell_sql('source_text')} || ' | ' || status || ' | ' || {_cell_sql('comment')} || ' | ' || printf('%.2f', confidence) || ' | ' || run_id || ' |' AS line FROM x)
"""


@query(f"WITH {_EXPORT}, {_MARKDOWN} SELECT id, line FROM md")
def markdown_rows(spark, sf_dir):
    return export.markdown_rows(_export(spark, sf_dir))


_REPORT_HEAD = f"""
head AS (SELECT unnest(range(11)) AS position, unnest(['---', 'run_id: {RUN_ID}', 'date: ' || chr(39) || '2026-01-02T03:04:05Z' || chr(39), 'source: in/tz 1.xlsx', 'schema_version: ' || chr(39) || '1.0' || chr(39), '---', '', '# Результат анализа ТЗ — tz 1.xlsx', '',
  '| № | Ref | Исходное требование | [Статус] | [Комментарий] | [Confidence] | [RunID] |', '|---:|---|---|---|---|---:|---|']) AS line)
"""


@query(f"""
WITH {_EXPORT}, {_MARKDOWN}, {_REPORT_HEAD}
SELECT position, line FROM head UNION ALL SELECT 10 + row_number() OVER (ORDER BY id), line FROM md
""")
def markdown_report(spark, sf_dir):
    return export.markdown_report(_export(spark, sf_dir), RUN_ID, "2026-01-02T03:04:05Z", "in/tz 1.xlsx")


@query(f"""
WITH {_EXPORT}, w AS (SELECT *, CASE WHEN id % 5 = 0 THEN '' ELSE run_id END AS own FROM x)
SELECT id, ref, source_text, status, comment, confidence, CASE WHEN own = '' THEN 'filled' ELSE own END AS run_id FROM w
""")
def passed_rows(spark, sf_dir):
    rows = _export(spark, sf_dir).withColumn("run_id", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("run_id")))
    return export.passed_through(rows.toDF("id", "ref", "source_text", *export.RESULT_COLUMNS), "filled")


@query(f"""
WITH e AS (SELECT 'run-' || conv_id AS run_id, turn, role AS provider, text AS message, min(text) OVER (PARTITION BY conv_id) AS q FROM conversations),
g AS (SELECT run_id, any_value({_mask_sql('q')}) AS query, count(*) AS n, lower(string_agg({_mask_sql('message')}, ' ')) AS low FROM e GROUP BY run_id)
SELECT run_id, query, 'Все провайдеры недоступны (' || n || ' из 3)' AS reason, CASE WHEN regexp_matches(low, '401|auth|token') THEN 'auth' WHEN regexp_matches(low, 'timeout|connection') THEN 'network' WHEN contains(low, '400') THEN 'request' ELSE 'default' END AS recommendation FROM g
""")
def error_reports(spark, sf_dir):
    errors = _t(spark, sf_dir, "conversations").select(F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("run_id"), F.col("text").alias("query"), F.col("role").alias("provider"), F.lit("Error").alias("error_type"), F.col("text").alias("message"))
    return export.error_report(errors, 3, "2026-01-02T03:04:05Z").select("run_id", "query", "reason", "recommendation")


@query(f"WITH {_EXPORT} SELECT doc_id % 20 AS sheet, doc_id AS row_idx, coalesce(x.status, '') AS status, coalesce(x.confidence, 0) AS confidence FROM documents LEFT JOIN x ON x.id = doc_id + 1 AND doc_id % 2 = 0")
def source_merge(spark, sf_dir):
    d = F.col("doc_id")
    source = _t(spark, sf_dir, "documents").select((d % 20).alias("sheet"), d.alias("row_idx"))
    rows = _export(spark, sf_dir).where("(id - 1) % 2 = 0").select(((F.col("id") - 1) % 20).alias("sheet"), (F.col("id") + 1).alias("row"), F.col("id").alias("ord"), "status", "comment", "confidence")
    twice = rows.unionByName(rows.withColumns({"ord": F.col("ord") - 1_000_000_000, "status": F.lit("old")}))
    return export.merge_into_source(source, twice, RUN_ID).select("sheet", "row_idx", "status", "confidence")


@query(f"SELECT conv_id::VARCHAR AS conv_id, {_mask_sql('text')} AS text, NULL::VARCHAR AS missing FROM conversations")
def masked_export(spark, sf_dir):
    return export.masked(_t(spark, sf_dir, "conversations"), ["conv_id", "text", "missing"])


# --- sources -------------------------------------------------------------------------------------------------------


def _cells(spark, sf_dir):
    """Documents as rows of their source's workbook: an id, a short code and the whole text."""
    base = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("book-"), F.col("source"), F.lit(".xlsx")).alias("path"), F.array(F.col("doc_id").cast("string"), F.col("lang"), F.col("text")).alias("v"))
    body = base.select("path", F.lit(0).cast("long").alias("sheet_no"), F.lit("Лист1").alias("sheet"), (F.col("doc_id") + 2).alias("row"), F.posexplode("v").alias("col", "value"))
    head = base.select("path").distinct().select("path", F.lit(0).cast("long").alias("sheet_no"), F.lit("Лист1").alias("sheet"), F.lit(1).cast("long").alias("row"), F.posexplode(F.array(F.lit("N"), F.lit("Lang"), F.lit("Text"))).alias("col", "value"))
    return head.unionByName(body).withColumn("col", F.col("col") + 1)


@query(r"""
WITH c AS (SELECT source, unnest([1, 2, 3]) AS col, unnest([doc_id::VARCHAR, lang, regexp_replace(regexp_replace(text, '^[\s\x0b\x85\p{Z}]+', ''), '[\s\x0b\x85\p{Z}]+$', '')]) AS v FROM documents),
s AS (SELECT source, col, count(*) AS n, avg(length(v)) AS m FROM c WHERE length(v) >= 5 GROUP BY ALL)
SELECT 'book-' || source || '.xlsx' AS path, arg_max(col, n * 1e9 + m * 1000 - col)::INT AS col FROM s GROUP BY source
""")
def column_detection(spark, sf_dir):
    return office.detect_columns(_cells(spark, sf_dir)).select("path", "col")


@query(r"""
WITH l AS (SELECT source, doc_id, regexp_replace(regexp_replace(text, '^[\s\x0b\x85\p{Z}]+', ''), '[\s\x0b\x85\p{Z}]+$', '') AS v FROM documents)
SELECT 'book-' || source || '.xlsx' AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS id, v AS text, (doc_id + 2)::INT AS row FROM l WHERE length(v) >= 5
""")
def workbook_requirements(spark, sf_dir):
    return office.requirements_of_cells(_cells(spark, sf_dir)).select("path", "id", "text", "locator.row")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') AS t FROM l),
c AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\s*[-–—•]\s+', ''), '^\s*\d+[.)]\s+', ''), '^\s*[a-zа-я][.)]\s+', ''), '^\s+', ''), '\s+$', '') AS t FROM t)
SELECT 'doc-' || doc_id || '.docx' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS id, sha256(t) AS text_sha256 FROM c WHERE length(t) >= 5 AND NOT regexp_matches(t, '^[-–—\s]+$')
""")
def paragraph_requirements(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), F.lit(0).cast("long").alias("ord"), F.lit("paragraph").alias("kind"),
        *[F.lit(None).cast("long").alias(c) for c in ("table", "row", "col")], F.lit(0).cast("long").alias("paragraph"), F.lit(False).alias("list_style"), F.regexp_replace("text", "[\r\x0b\x0c\x85\u2028\u2029]", " ").alias("text"), F.lit(None).cast("string").alias("error"),
    )
    return office.requirements_of_paragraphs(rows).select("path", "id", tx.sha256("text").alias("text_sha256"))


BOOK = 500


def _books(spark, sf_dir, name, content):
    """Writes files of BOOK documents each, by their doc_id, in tasks: ``content(rows)`` gives a file's parts out of (doc_id, lang, text) rows."""
    path = new_path(spark, name)

    def write(key, table):
        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        fs.create_dir(base)
        rows = sorted(zip(*(table[c].to_pylist() for c in ("doc_id", "lang", "text")), strict=True))
        with fs.open_output_stream(f"{base}/book-{key[0].as_py()}.{name}") as out:
            made = io.BytesIO()
            with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
                for part, xml in content(rows):
                    z.writestr(part, xml)
            out.write(made.getvalue())
        return pa.table({"book": [key[0]]})

    # What XML can't hold becomes a space.
    docs = _t(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / BOOK).alias("book"), "doc_id", "lang", F.regexp_replace("text", "[\\x00-\\x08\\x0b-\\x1f\\x85\\u2028\\u2029\\ufffe\\uffff]", " ").alias("text"))
    docs.groupBy("book").applyInArrow(write, "book long").count()
    formats.register(spark)
    return path


_PLAIN = "regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x{85}\\x{2028}\\x{2029}\\x{fffe}\\x{ffff}]', ' ', 'g')"


def _workbook(rows):
    """Two sheets, of documents with even and with odd ids."""
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    yield "xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="even" r:id="a0"/><sheet name="odd" r:id="a1"/></sheets></workbook>'
    yield "xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a0" Target="worksheets/s0.xml"/><Relationship Id="a1" Target="worksheets/s1.xml"/></Relationships>'
    for k in (0, 1):
        own = [(d, lang, text or "") for d, lang, text in rows if d % 2 == k]
        cells = ['<row r="1"><c r="A1" t="inlineStr"><is><t>N</t></is></c><c r="C1" t="inlineStr"><is><t>Описание</t></is></c></row>']
        cells += [f'<row r="{n}"><c r="A{n}"><v>{d}</v></c><c r="C{n}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c></row>' for n, (d, _, text) in enumerate(own, 2)]
        yield f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{s}"><sheetData>{"".join(cells)}</sheetData></worksheet>'


@query(rf"""
WITH d AS (SELECT doc_id, doc_id // {BOOK} AS book, doc_id % 2 AS odd, {_STRIPPED(_PLAIN)} AS t FROM documents),
n AS (SELECT *, (1 + row_number() OVER (PARTITION BY book, odd ORDER BY doc_id))::INT AS row FROM d)
SELECT 'book-' || book || '.xlsx' AS path, CASE WHEN odd = 1 THEN 'odd' ELSE 'even' END AS sheet, row, row_number() OVER (PARTITION BY book ORDER BY odd, row) AS id, sha256(t) AS text_sha256 FROM n WHERE length(t) >= 5 AND lower(t) <> 'nan'
""")
def workbook_files(spark, sf_dir):
    cells = spark.read.format("workbooks").load(_books(spark, sf_dir, "xlsx", _workbook)).where("error is null")
    found = office.requirements_of_cells(cells)
    return found.select(F.substring_index("path", "/", -1).alias("path"), "locator.sheet_name", "locator.row", "id", tx.sha256("text").alias("text_sha256")).withColumnRenamed("sheet_name", "sheet")


_UNMARKED = r"regexp_replace(regexp_replace(regexp_replace(t, '^\s*[-–—•]\s+', ''), '^\s*\d+[.)]\s+', ''), '^\s*[a-zа-я][.)]\s+', '')"


def _document(rows):
    """Documents of other languages than English in a table with a row each, before the paragraphs of the others; lines are breaks."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda text: "<w:p><w:r>" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in (text or "").split("\n")) + "</w:r></w:p>"
    table = "".join(f"<w:tr><w:tc>{p(str(d))}</w:tc><w:tc>{p(text)}</w:tc></w:tr>" for d, lang, text in rows if lang != "en")
    yield "word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{table}</w:tbl>{"".join(p(text) for _, lang, text in rows if lang == "en")}</w:body></w:document>'


@query(rf"""
WITH d AS (SELECT doc_id, doc_id // {BOOK} AS book, coalesce(lang, '') <> 'en' AS tabled, {_PLAIN} AS text FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY book, tabled ORDER BY doc_id) AS nth FROM d),
l AS (SELECT book, tabled, nth, 2 AS col, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM n UNION ALL SELECT book, tabled, nth, 1, doc_id::VARCHAR, 0 FROM n WHERE tabled),
t AS (SELECT book, tabled, nth, col, i, {_STRIPPED('raw')} AS t FROM l),
c AS (SELECT book, tabled, nth, col, i, {_STRIPPED(_UNMARKED)} AS t FROM t)
SELECT 'book-' || book || '.docx' AS path, row_number() OVER (PARTITION BY book ORDER BY tabled, nth, col, i) AS id, CASE WHEN tabled THEN 'table' ELSE 'paragraph' END AS kind, nth::INT AS place, CASE WHEN tabled THEN col END::INT AS col, sha256(t) AS text_sha256
FROM c WHERE length(t) >= 5 AND NOT regexp_matches(t, '^[-–—\s]+$')
""")
def document_files(spark, sf_dir):
    rows = spark.read.format("word_documents").load(_books(spark, sf_dir, "docx", _document)).where("error is null")
    found = office.requirements_of_paragraphs(rows)
    return found.select(F.substring_index("path", "/", -1).alias("path"), "id", F.col("locator.type").alias("kind"), F.coalesce("locator.index", "locator.row").alias("place"), "locator.col", tx.sha256("text").alias("text_sha256"))


@query(f"""
WITH {_EXPORT}, {_MARKDOWN}, {_REPORT_HEAD}
SELECT position, line FROM head UNION ALL SELECT 10 + row_number() OVER (ORDER BY id), line FROM md
""")
def report_file(spark, sf_dir):
    """The Markdown report as one file, read back."""
    path = new_path(spark, "report") + ".md"
    export.write_report(_export(spark, sf_dir), RUN_ID, "2026-01-02T03:04:05Z", path, source_file="in/tz 1.xlsx", one_file=True)
    lines = scan(spark.read.text(path.removeprefix("file://")).select("value", F.lit(0).alias("k"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at")), ["k"], ["block", "at"], {"n": Run("count")})
    return lines.select((F.col("n") - 1).alias("position"), F.col("value").alias("line"))


# --- flows and streams ---------------------------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may match one file or a folder of files


_MASKED_TEXT = _mask_sql("text")


@query(f"WITH {_TF}, {_bm25_sql(f'SELECT item_id AS query_id, {_MASKED_TEXT} AS text FROM benchmark')} SELECT query_id, doc_id, score, rank FROM bm25")
def stream_match(spark, sf_dir):
    out = new_path(spark, "stream-match")
    asked = _stream(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    arriving.match(asked, _t(spark, sf_dir, "documents"), f"{out}/hits", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/hits").select("query_id", "doc_id", "score", F.col("rank"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def stream_event_rates(spark, sf_dir):
    out = new_path(spark, "stream-rates")
    rates = arriving.event_rates(_stream(spark, sf_dir, "events"))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rates/batch={number}")

    rates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{out}/rates").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("r"))  # a window is written again when it changes
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "r.n", "r.value")


@query(f"""
WITH m AS (SELECT c.conv_id, c.turn, c.text AS question, p.turn AS before, p.role, p.text, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY p.turn DESC) AS n
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn WHERE c.role = 'user')
SELECT conv_id, turn, any_value(question) AS question, coalesce(string_agg(CASE WHEN lower(role) = 'assistant' THEN 'Ассистент' ELSE 'Пользователь' END || ': ' || {_STRIPPED('text')}, chr(10) ORDER BY before) FILTER ({_STRIPPED("coalesce(text, '')")} <> ''), '') AS history
FROM m WHERE n <= 6 GROUP BY conv_id, turn
""")
def stream_histories(spark, sf_dir):
    out = new_path(spark, "stream-histories")
    asked = arriving_turns.questions(_stream(spark, sf_dir, "conversations"), idle_ms=None)
    asked.writeStream.format("parquet").option("path", f"{out}/questions").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/questions")


def _index(spark, sf_dir):
    return flows.build_index(_page_text(spark, sf_dir), _products(spark))


@query(rf"""
WITH {_PAGES}, w AS (SELECT source, section_pos, list_filter(regexp_split_to_array(section, '\s+'), lambda x: x <> '') AS w FROM kept),
s AS (SELECT source, section_pos, w, unnest(range(0, greatest(len(w) - 64, 1), 448)) AS s FROM w WHERE len(w) > 0)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY section_pos, s) - 1)::INT AS chunk_idx, sha256(array_to_string(list_slice(w, s + 1, s + 512), ' ')) AS chunk_sha256,
  source || '::document::' || replace(regexp_replace(source, '\.md$', ''), '-', ' ') AS parent_id FROM s
""".replace("\\\\", "\\"))
def index_chunks(spark, sf_dir):
    return _index(spark, sf_dir).select("source", "chunk_idx", tx.sha256("text").alias("chunk_sha256"), "parent_id")


def _said(system, user):
    """A model's answer made of its whole prompt: the first chunk decides and is cited, and the reason is a digest of all that the model was given."""
    import hashlib
    import json
    import re

    first = re.search(r"<context>\n\[(.*?) — (.*?)\]\n", user)
    cited = [{"source": first[1], "section": first[2], "quote": ""}] if first else []
    return json.dumps({"classification": "Да" if first and first[2] == "en" else "НД", "confidence": 0.5, "reasoning": hashlib.sha256(user.encode()).hexdigest(), "citations": cited}, ensure_ascii=False)


@query(f"""
WITH {_TF}, {_bm25_sql(_ITEMS, k=5)}, j AS (SELECT b.query_id, arg_min(d.lang, rank) AS lang, string_agg('[' || d.source || ' — ' || d.lang || ']' || chr(10) || {_STRIPPED('d.text')}, chr(10) || chr(10) ORDER BY rank) AS c FROM bm25 b JOIN documents d USING (doc_id) GROUP BY 1),
p AS (SELECT item_id AS id, lang, '<requirement id="' || item_id || '">' || text || '</requirement>' || chr(10) || '<context>' || chr(10) || coalesce(c, '(контекст отсутствует)') || chr(10) || '</context>' || chr(10) || 'Respond with the JSON object only.' AS prompt FROM benchmark LEFT JOIN j ON query_id = item_id)
SELECT id, CASE WHEN lang = 'en' THEN 'Да' ELSE 'НД' END AS status, sha256({_mask_sql('prompt')}) AS comment, 0.5::DOUBLE AS confidence FROM p
""")
def analyse_requirements(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("page"), "text")
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(None).cast("string").alias("error_note"))
    _, rows, _ = flows.analyse(asked, docs, {"said": _said}, ["unknown", "said"], run_id=RUN_ID)
    return rows.select("id", "status", "comment", "confidence")


def _digest(system, user):
    import hashlib

    return "[src0.pdf] " + hashlib.sha256(user.encode()).hexdigest()


@query(f"""
WITH {_TF}, asked AS (SELECT conv_id AS query_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1), {_bm25_sql('SELECT * FROM asked')},
f AS (SELECT query_id, d.source || '.pdf' AS source, arg_min(d.doc_id % 4, rank) AS page FROM bm25 b JOIN documents d USING (doc_id) GROUP BY ALL),
x AS (SELECT query_id, string_agg('[' || rank || '] ' || d.source || '.pdf' || CASE WHEN d.doc_id % 4 > 0 THEN ' стр. ' || d.doc_id % 4 ELSE '' END || chr(10) || {_STRIPPED("coalesce(d.text, '')")}, chr(10) || chr(10) ORDER BY rank) AS ctx FROM bm25 b JOIN documents d USING (doc_id) GROUP BY 1),
h AS (SELECT conv_id AS query_id, string_agg(CASE WHEN lower(role) = 'assistant' THEN 'Ассистент' ELSE 'Пользователь' END || ': ' || {_STRIPPED('text')}, chr(10) ORDER BY turn) AS hist
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 AND {_STRIPPED("coalesce(text, '')")} <> '' GROUP BY 1),
p AS (SELECT query_id, '<context>' || chr(10) || coalesce(ctx, '(no context)') || chr(10) || '</context>' || coalesce(chr(10) || chr(10) || '<history>' || chr(10) || hist || chr(10) || '</history>', '') || chr(10) || chr(10) || '<question>' || {_STRIPPED("coalesce(text, '')")} || '</question>' AS prompt
  FROM asked LEFT JOIN x USING (query_id) LEFT JOIN h USING (query_id))
SELECT query_id, coalesce((SELECT '[src0.pdf' || CASE WHEN page > 0 THEN ', стр. ' || page ELSE '' END || '](http://kb/src0.pdf' || CASE WHEN page > 0 THEN '#page=' || page ELSE '' END || ')' FROM f WHERE f.query_id = p.query_id AND source = 'src0.pdf'), '[src0.pdf]') || ' ' || sha256({_mask_sql('prompt')}) AS answer FROM p
""")
def consultation(spark, sf_dir):
    messages = _t(spark, sf_dir, "conversations")
    asked = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text")).select(F.col("conv_id").alias("query_id"), "conv_id", "text")
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".pdf")).alias("source"), (F.col("doc_id") % 4).cast("string").alias("page"), "text")

    def down(system, user):
        raise ConnectionError("down")

    return flows.consult(messages, asked, docs, {"down": down, "digest": _digest}, "http://kb", order=["unknown", "down", "digest"]).select("query_id", "answer")


@query(f"""
WITH p AS (SELECT conv_id * 100 + turn AS query_id, {_mask_sql('text')} AS prompt FROM conversations)
SELECT query_id, sha256(prompt) AS answer, 'echo' AS provider FROM p
""")
def ledger_answers(spark, sf_dir):
    """Every message is put to a model, in two runs over one ledger: half of them are known to the second."""

    def echo(system, user):
        import hashlib

        return hashlib.sha256(user.encode()).hexdigest()

    asked = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("prompt"))
    book = ledger.Ledger(spark, new_path(spark, "ledger"), every=64)
    book.answers(asked.where("query_id % 2 = 0"), {"echo": echo}, ["echo"])
    return book.answers(asked, {"echo": echo}, ["echo"]).select("query_id", "answer", "provider")


@query(f"""
WITH {_TF}, {_bm25_sql(_VARIANTS, 'one', 5)},
follow AS (SELECT o.query_id, d.text FROM one o JOIN documents d USING (doc_id) WHERE rank = 1 AND o.query_id % 2 = 0),
{_bm25_sql('SELECT * FROM follow', 'two', 5)},
fresh AS (SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.query_id = two.query_id AND one.doc_id = two.doc_id)),
hops AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY hop, rank) AS rank FROM (SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM fresh)),
summed AS (SELECT query_id // 16 AS query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min((query_id % 16) * 100000 + rank) AS first FROM hops GROUP BY ALL),
fused AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM summed) WHERE rank <= 5),
hits AS (SELECT f.*, d.source || '::' || d.lang AS parent_id FROM fused f JOIN documents d USING (doc_id)),
grouped AS (SELECT query_id, parent_id, min(rank) AS best, max(score) AS score, arg_min(doc_id, rank) AS doc_id, string_agg(doc_id, ',' ORDER BY rank) AS children FROM hits GROUP BY ALL)
SELECT query_id, parent_id, score, doc_id, children, row_number() OVER (PARTITION BY query_id ORDER BY best, parent_id) AS rank FROM grouped
""")
def search_chain(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    passages = docs.select("doc_id", "text", F.concat_ws("::", "source", "lang").alias("parent_id"), F.lit(None).cast("string").alias("parent_text"))
    index = lexical.kept(docs)

    def judge(queries, hits):
        top = hits.where("rank = 1 and hop = 1").join(docs.select("doc_id", "text"), "doc_id")
        return top.select("query_id", (F.col("query_id") % 2 == 1).alias("sufficient"), F.lit(0.9).alias("confidence"), F.col("text").alias("follow_up"))

    search = ranking.composed(lambda q: ranking.bm25(None, q, 5, index=index), 5, judge, _halves, passages)
    return search(_items(spark, sf_dir)).select("query_id", "parent_id", "score", "doc_id", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"), "rank")


@query(f"""
WITH {_TF}, {_bm25_sql(_ITEMS, k=5)}, one AS (SELECT item_id AS query_id, text FROM benchmark),
x AS (SELECT query_id, string_agg('[' || rank || '] source=' || d.source || ' chunk_idx=' || d.doc_id || ' page=' || d.lang || chr(10) || {_STRIPPED("coalesce(d.text, '')")}, chr(10) || chr(10) ORDER BY rank) AS ctx FROM bm25 b JOIN documents d USING (doc_id) GROUP BY 1),
p AS (SELECT query_id, '<question>' || {_STRIPPED('text')} || '</question>' || chr(10) || chr(10) || '<context>' || chr(10) || coalesce(ctx, '(no context)') || chr(10) || '</context>' AS reflect, '<query>' || {_STRIPPED('text')} || '</query>' || chr(10) || 'Return exactly 3 query rewrites as a JSON array of strings.' AS rewrite FROM one LEFT JOIN x USING (query_id))
SELECT query_id, sha256({_mask_sql('reflect')}) AS reflect_sha256, sha256({_mask_sql('rewrite')}) AS rewrite_sha256 FROM p
""")
def search_prompts(spark, sf_dir):
    def echo(system, user):
        import hashlib
        import json

        sha = hashlib.sha256(user.encode()).hexdigest()
        return json.dumps([sha]) if user.startswith("<query>") else json.dumps({"sufficient": False, "confidence": 0.1, "follow_up": sha})

    docs, items = _t(spark, sf_dir, "documents"), _items(spark, sf_dir)
    passages = docs.select("doc_id", "source", F.col("doc_id").alias("chunk_idx"), F.col("lang").alias("page"), "text")
    hits = ranking.bm25(docs, items, 5).withColumn("hop", F.lit(1))
    judged = providers.reflector({"echo": echo}, ["echo"], passages, written)(items, hits)
    said = providers.rewriter({"echo": echo}, ["echo"], written)(items)
    return judged.select("query_id", F.col("follow_up").alias("reflect_sha256")).join(said.select("query_id", F.col("text").alias("rewrite_sha256")), "query_id")


@query(f"""
{_RANKS}, k AS (SELECT b.query_id, lower(string_agg(text, chr(10) ORDER BY rank)) AS ctx FROM bm25 b JOIN documents USING (doc_id) GROUP BY 1),
g AS (SELECT item_id AS query_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS needles FROM benchmark),
n AS (SELECT round(CASE WHEN len(needles) > 0 THEN len(list_filter(needles, lambda w: contains(coalesce(ctx, ''), lower(w)))) / len(needles) ELSE 1 END, 6) AS recall FROM g LEFT JOIN k USING (query_id)),
v AS (SELECT 'hit_rate' AS gate, (SELECT round(count(rank) / count(*), 6) FROM r) AS value, 0.5::DOUBLE AS least UNION ALL SELECT 'mrr', (SELECT round(coalesce(sum(1.0 / rank), 0) / count(*), 6) FROM r), 0.0 UNION ALL SELECT 'recall', (SELECT round(avg(recall), 6) FROM n), 0.25)
SELECT gate, value, least, value >= least AS passed FROM v
""")
def retrieval_gates(spark, sf_dir):
    return flows.evaluated(_golden(spark, sf_dir), _hits(spark, sf_dir), {"hit_rate": 0.5, "recall": 0.25})[1]


@query(SQL["index_chunks"])
def index_store(spark, sf_dir):
    store = builds.ChunkIndex(spark, new_path(spark, "index"), _products(spark))
    store.refresh(_files(spark, sf_dir))
    return store.read().select("source", "chunk_idx", tx.sha256("text").alias("chunk_sha256"), "parent_id")


def _files(spark, sf_dir):
    """Pages as files of a folder, with hashes."""
    return _page_text(spark, sf_dir).withColumn("sha256_hash", tx.sha256("text"))


@query(SQL["index_chunks"])
def refreshed_index(spark, sf_dir):
    """The index of an earlier state of the pages, brought up to date: some were missing then, some were other, some have gone since."""
    now = _files(spark, sf_dir)
    number = F.crc32(F.col("source").cast("binary"))
    then = now.where(number % 5 > 0).withColumn("text", F.when(number % 7 == 0, F.concat("text", F.lit("\nas it was"))).otherwise(F.col("text")))
    then = then.unionByName(now.where(number % 11 == 0).withColumn("source", F.concat(F.lit("gone-"), F.col("source")))).withColumn("sha256_hash", tx.sha256("text"))
    store = builds.ChunkIndex(spark, new_path(spark, "index"), _products(spark))
    store.refresh(then)
    store.refresh(now)
    return store.read().select("source", "chunk_idx", tx.sha256("text").alias("chunk_sha256"), "parent_id")


_TF_GIVEN = _TF.replace("FROM documents", "FROM (SELECT * FROM documents WHERE text <> '')")


def _grown(spark, sf_dir):
    """An index that began with other texts of some documents, without some, and with some that are taken away again."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    turn = F.col("doc_id") % 3
    first = docs.where(turn < 2).withColumn("text", F.when(turn == 1, F.concat("text", F.lit(" and more words of old"))).otherwise(F.col("text")))
    gone = docs.where("doc_id % 4 = 1").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    index = growing.GrowingIndex(spark, new_path(spark, "growing"))
    index.add(first.unionByName(gone))
    index.add(docs.where(turn > 0))
    index.remove(gone)
    return index


@query(f"WITH {_TF_GIVEN}, {_bm25_sql(_ITEMS)} SELECT query_id, doc_id, score, rank FROM bm25")
def growing_topk(spark, sf_dir):
    return _grown(spark, sf_dir).search(_items(spark, sf_dir), 5)


@query(f"WITH {_TF_GIVEN}, {_bm25_sql(_ITEMS)} SELECT query_id, doc_id, score, rank FROM bm25")
def growing_pruned_topk(spark, sf_dir):
    return _grown(spark, sf_dir).search_pruned(_items(spark, sf_dir), 5)[0]


@query(f"WITH {_TF_GIVEN} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def growing_statistics(spark, sf_dir):
    return _grown(spark, sf_dir).term_counts()


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR WHEN doc_id % 3 = 1 AND source <> '' THEN source ELSE coalesce(lang, '') END AS label FROM documents")
def page_labels(spark, sf_dir):
    d = F.col("doc_id")
    return _t(spark, sf_dir, "documents").select("doc_id", ranking.page_label(F.when(d % 3 == 0, d.cast("string")).when(d % 3 == 1, ""), F.when(d % 3 == 1, F.col("source")), F.col("lang")).alias("label"))


@query()
def feature_embedding(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", vectors.feature_hashed(cache.normal_query("text")).alias("embedding"))


@query("""
WITH d AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
SELECT item_id, 'Stub answer grounded in SRC' || (item_id % 20) || '; expected markers: ' || CASE WHEN len(list_filter(w, lambda x: x <> '')) > 0 THEN array_to_string(list_slice(list_filter(w, lambda x: x <> ''), 1, 3), ', ') ELSE 'no markers' END || '.' AS answer FROM d
""")
def stub_answers(spark, sf_dir):
    return _golden(spark, sf_dir).select(F.col("query_id").alias("item_id"), cache.stub_answer(F.col("expected_sources"), F.col("expected_substrings")).alias("answer"))

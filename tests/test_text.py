import hashlib
import math
import uuid

from pyspark.sql import functions as F

from lodestone.functions import masking, vectors
from lodestone.functions import text as tx
from lodestone.operators import chat


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_tokens_are_unicode_and_lower(spark):
    assert one(spark, "Битрикс24: Größe_1 x", tx.tokens("t")) == ["битрикс24", "größe_1", "x"]
    assert one(spark, None, tx.tokens("t")) == []


def test_trimming_takes_every_white_space(spark):
    assert one(spark, "  a\t b  \n", tx.strip("t")) == "a\t b"
    assert one(spark, " a \n  b ", tx.collapse("t")) == "a b"
    assert one(spark, " ", tx.blank("t")) and one(spark, None, tx.blank("t")) and not one(spark, "0", tx.blank("t"))


def test_lengths(spark):
    assert one(spark, "abc def", tx.bounded("t", 4)) == "abc" and one(spark, "abc", tx.bounded("t", 0)) == "abc"
    assert one(spark, "x" * 700, tx.preview("t")) == "x" * 600 + "..."
    assert [one(spark, t, tx.estimate_tokens_floor("t")) for t in ("", "a", "abcdefg")] == [0, 1, 1]
    assert [one(spark, t, tx.estimate_tokens_ceil("t")) for t in ("", "a", "abcde")] == [1, 1, 2]


def test_names(spark):
    assert one(spark, "sip_trunk-manual.v2.pdf", tx.title_from_source("t")) == "sip trunk manual.v2"
    assert one(spark, "a.b.XLSX", tx.extension("t")) == "xlsx" and one(spark, "none", tx.extension("t")) == ""
    assert one(spark, "ключ", tx.uuid5("6ba7b8119dad11d180b400c04fd430c8", "t")) == str(uuid.uuid5(uuid.NAMESPACE_URL, "ключ"))


def test_masking(spark):
    m = lambda t: one(spark, t, masking.mask("t"))
    assert m("пишите a.b@mail.example.com сейчас") == "пишите [EMAIL] сейчас"
    assert m("+7 (495) 123-45-67 и 8 495 123 45 67") == "[PHONE] и [PHONE]"
    assert m("8 495 123 45 67,8 495 123 45 67") == "[PHONE],[PHONE]"
    assert m("10.0.0.1 host.corp.ru") == "[IP] [DOMAIN]"
    assert m("256.1.1.1") == "256.1.1.1"
    assert m("почтаa@b.ru") == "почтаa@b.ru"
    assert m(m("a@b.ru +7 495 123 45 67")) == m("a@b.ru +7 495 123 45 67")
    assert m(None) is None


def test_rules_from_a_file():
    rules = masking.compile_rules([{"name": "a", "regex": "x+", "replacement": "$1"}, {"pattern": "y"}, {"regex": "("}, {}])
    assert rules == [("a", "x+", "$1"), ("", "y", "[MASKED]")]


def test_sanitising(spark):
    df = spark.sql("SELECT named_struct('run_id', 'a@b.ru', 'OPENAI_API_KEY', 'k', 'message', 'a@b.ru', 'payload', repeat('я', 20000), 'n', 5, 'list', array('a@b.ru'), 'm', map('X_TOKEN', 't', 'q', 'a@b.ru')) AS r")
    r = df.select(masking.sanitize(F.col("r"), df.schema["r"].dataType).alias("r")).first().r
    assert (r.run_id, r.OPENAI_API_KEY, r.message, r.n, r["list"], r.m) == ("a@b.ru", "***REDACTED***", "[EMAIL]", 5, ["[EMAIL]"], {"X_TOKEN": "***REDACTED***", "q": "[EMAIL]"})
    assert r.payload == "я" * 16384 + "…[TRUNCATED:40000B]"


def test_vectors(spark):
    df = spark.sql("SELECT array(3f, 4f) a, array(3f, 4f, 9f) b, array(0f, 0f) z")
    r = df.select(vectors.cosine("a", "a").alias("same"), vectors.dot("a", "b").alias("dot"), vectors.cosine("a", "z").alias("zero"), vectors.distance_similarity(F.lit(1.0)).alias("s")).first()
    assert (round(r.same, 9), r.dot, r.zero, r.s) == (1.0, 25.0, 0.0, 0.5)


def test_hashed_vectors_have_length_one(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "id long, w array<string>")
    v = vectors.to_vector(vectors.hashed_counts(rows, "id", "w"), "id").collect()
    assert len(v) == 1 and abs(sum(x * x for x in v[0].embedding) - 1) < 1e-9


def test_feature_vectors(spark):
    texts = ["как настроить елку", "", None, "a"]
    got = [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).select("k", vectors.feature_hashed("t", 16).alias("x")).orderBy("k").collect()]

    def one(text):
        out = [0.0] * 16
        words = (text or "").split()
        line = " ".join(words)
        for name, w in [*((f"tok:{x}", 1.0) for x in words), *((f"tri:{line[k : k + 3]}", 0.35) for k in range(len(line) - 2) if line[k : k + 3].strip())]:
            d = hashlib.blake2b(name.encode(), digest_size=8).digest()
            out[int.from_bytes(d[:4], "little") % 16] += w if d[4] & 1 else -w
        size = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / size for x in out]

    assert all(abs(a - b) < 1e-12 for g, t in zip(got, texts, strict=True) for a, b in zip(g, one(t), strict=True))


def test_audit_lines(spark):
    df = spark.createDataFrame([("mail a@b.ru", "gpt", {"seed": "1"}, 3, "k", None)], "user_prompt string, provider string, decoding_params map<string,string>, attempt int, api_key string, zebra string").select(F.struct("*").alias("r"))
    line = df.select(masking.audit_line(F.lit("LLM_REQUEST"), F.col("r"), df.schema["r"].dataType).alias("x")).first().x
    assert line == 'LLM_REQUEST provider="gpt" attempt=3 decoding_params={"seed":"1"} user_prompt="mail [EMAIL]" api_key="***REDACTED***"'


def test_masked_chunks_and_signatures(spark):
    df = spark.createDataFrame([([("s", "call 10.0.0.1"), ("t", None)],)], "c array<struct<source:string,text:string>>")
    assert [tuple(x) for x in df.select(masking.mask_chunks(F.col("c")).alias("c")).first().c] == [("s", "call [IP]"), ("t", None)]
    rows = spark.createDataFrame([("1", "T", False), ("1", "", False), ("", "T", False), ("1", "T", True)], "n string, t string, f boolean")
    assert [r.x for r in rows.select(chat.section_signature(F.col("n"), F.col("t"), F.col("f")).alias("x")).collect()] == ["§1 T", "§1", "T", "раздел: T"]
    lists = spark.createDataFrame([(["a", "a"], [], ["c"])], "p array<string>, r array<string>, s array<string>")
    assert lists.select(chat.dependency_context(F.col("p"), F.col("r"), F.col("s")).alias("x")).first().x == "Предварительные условия: a\nСм. также: c"

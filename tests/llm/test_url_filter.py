from lodestone.llm import url_filter as uf


def test_parts_rules_and_terms(spark):
    cases = [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"),
        ("HTTP://WWW.Example.com/en/a?x=1", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("https://blog.example.com/en/7#t", "blog.example.com", "/en/7", "example.com/en/", "block"),
        ("https://example.com/de/7", "example.com", "/de/7", "com/", "allow"), ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("https://a.net/es/", "a.net", "/es/", "net/es/", "block"), ("https://a.net?x", "a.net", "", None, "allow"), ("https://net/fr/x", "net", "/fr/x", "net/fr/", "block"),
        ("https://a.org/casino/x", "a.org", "/casino/x", None, "block"), ("https://a.org/casinoss", "a.org", "/casinoss", None, "allow"), ("https://a.org/x?q=Glücksspiel", "a.org", "/x", None, "block"), ("https://a.org/poker-hack", "a.org", "/poker-hack", None, "block"), ("https://a.org/poker", "a.org", "/poker", None, "allow"),
        ("https://a.org/free-bonus", "a.org", "/free-bonus", None, "allow"), ("https://a.org/free-bonus/Win", "a.org", "/free-bonus/Win", None, "block"), ("https://a.org/free/free/free", "a.org", "/free/free/free", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0], "h", 1) for k, c in enumerate(cases)], "page_id long, url string, html string, host int")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages).collect())
    assert got == [(k, *c[1:]) for k, c in enumerate(cases)]


def test_rows_are_judged_one_by_one(spark):
    pages = spark.createDataFrame([(1, "http://a.org"), (1, "http://a.org"), (None, "http://xxx.org/" + "a" * 10_000)], "page_id long, url string")
    assert sorted(r.verdict for r in uf.judge(pages).collect()) == ["allow", "allow", "block"]
    assert uf.judge(pages.limit(0)).count() == 0


def test_own_terms_and_the_vocabulary(spark):
    pages = spark.createDataFrame([(1, "http://a.org/alpha"), (2, "http://a.org/beta?gamma"), (3, "http://a.org/beta/beta"), (4, "http://a.org/casino")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.n_strict, r.n_soft, r.soft_weight) for r in uf.judge(pages, strict=["alpha"], soft={"beta": 5, "gamma": 1}).collect()}
    assert got == {1: ("block", 1, 0, 0), 2: ("block", 0, 2, 6), 3: ("allow", 0, 1, 5), 4: ("allow", 0, 0, 0)}
    assert {r.verdict for r in uf.judge(pages, strict=[], soft={}).collect()} == {"allow"}
    strict, soft = uf.vocabulary()
    assert len(strict) > 25 and len(soft) > 90 and not {*strict} & {t for t, _ in soft} and all(t == t.lower() for t in strict)

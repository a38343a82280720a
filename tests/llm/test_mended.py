"""Inputs that once broke an operator or its contract."""

import time

import pytest

from cairnspark.llm import html_text, langid, licenses, toxicity, url_filter

WORDS = "It rained for nine days and the river rose above the lower meadows."


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body><div data-y="12px"><p>' + WORDS + "</p></div><div data-y><p>" + WORDS + "</p></div>", f"{WORDS}\n{WORDS}"),
        ('<body><script>var a="<body class=x>"; alert("evil words")</script><article><p>' + WORDS + "</p></article>", WORDS),
        ("<head><style>/* <body> red */ a{}</style><title>T</title></head><body><article><p>" + WORDS + "</p></article>", WORDS),
        ("<article><p>" + WORDS + "</p><p>See <a href=x>one long sentence that is linked as a whole</a></p></article>", WORDS + "\nSee one long sentence that is linked as a whole"),
        ("<article><p>" + WORDS + "</p><p><a href=x>" + WORDS + "</a></p></article>", f"{WORDS}\n{WORDS}"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_a_small_article_does_not_beat_the_page():
    posts = "".join(f'<div class="post"><p>{WORDS} {i}</p></div>' for i in range(2))
    assert [f"{WORDS} {i}" in html_text.main_text(posts + "<article><p>hi there</p></article>") for i in range(2)] == [True, True]


def edges(spark, html, url="http://a.b/c/d"):
    return sorted(r.b for r in url_filter.alias_edges(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).collect())


@pytest.mark.parametrize(
    "html, found",
    [
        ('<link title="a>b" rel=canonical href="http://q.r/s">', ["q.r/s"]),
        ("<link title='x<y>z' rel=canonical href=/k><link rel=canonical href=n>", ["a.b/c/n", "a.b/k"]),
        ('<script>"<link rel=canonical href=http://no/x>"</script ><LINK REL="Canonical x" HREF=/z>', ["a.b/z"]),
        ("<!-- <link rel=canonical href=/no> --><meta http-equiv=refresh content=\"0; url='/m'\">", ["a.b/m"]),
        ('<link title="5" tall" rel=canonical href=/u>', ["a.b/u"]),
        ("<link rel=canonical href=/cut", []),
        ("<textarea><link rel=canonical href=/no></textarea><title><link rel=canonical href=/no>", []),
    ],
)
def test_links_as_a_page_has_them(spark, html, found):
    assert edges(spark, html) == found


def test_a_path_with_a_line_break_keeps_its_rule(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a", '<link rel=canonical href="http://example.org/es/a\nb">'), (2, "http://x.net/b", '<link title="a>b" rel=canonical href="http://example.org/es/c">')], "page_id long, url string, html string")
    rules = spark.createDataFrame([("example.org", "/es/", "block")], "rule_host string, rule_path string, action string")
    out = url_filter.judge_urls(pages.select("page_id", "url"), rules, url_filter.alias_edges(pages))
    assert [r.verdict for r in out.orderBy("page_id").collect()] == ["block", "block"]


@pytest.mark.parametrize("piece", ["<script ", "<link ", '<a title="', '<link title="canonical', "<!-- "])
def test_what_a_page_leaves_open_costs_its_length_alone(spark, piece):
    begin = time.time()
    assert edges(spark, "<link rel=canonical href=/g>" + piece * (1_000_000 // len(piece))) == ["a.b/g"]
    assert time.time() - begin < 20


def test_every_language_is_learned(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 4 * 230)]
    rows = [(i * 10 + k, "".join(letters[4 * i : 4 * i + 4]) * 3 + " " + letters[4 * i + k % 4], f"l{i:03}") for i in range(230) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, docs.doc_id.isNotNull())
    assert len(model.langs) == 230
    out = langid.identify(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.95 * len(out)


def test_ids_that_are_all_null_are_sampled_like_others(spark):
    docs = spark.createDataFrame([(None, f"aab ab{'a' * (i % 7)} {i}" if i % 2 else f"ccd dc{'d' * (i % 7)} {i}", "x" if i % 2 else "y") for i in range(400)], "doc_id long, text string, lang string")
    model = langid.train(docs, docs.text.isNotNull(), per_lang=50)
    assert model.predict(*next(langid.gram_counts(["aab ab"])))[0] == "x" and model.predict(*next(langid.gram_counts(["ccd dc"])))[0] == "y"


def test_names_that_clash_in_another_case(spark):
    docs = spark.createDataFrame([(1, "the mit license", "a", 2.0, "b")], "doc_id long, text string, Labels string, Score double, Lang_Pred string")
    for out in (toxicity.score(docs, None), langid.identify(docs, langid.fit([], None, [])), licenses.scan(docs)):
        assert len({c.lower() for c in out.columns}) == len(out.columns) and out.collect()[0].doc_id == 1
    pages = spark.createDataFrame([(1, "<p>x</p>", "y")], "page_id long, html string, Text string")
    assert html_text.extract(pages).collect()[0].input_Text == "y"

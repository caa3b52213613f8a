"""What a page's article keeps, what the template takes away, and which texts have a language."""

import pytest

from cohortlens.llm import htmltext, langid


def texts(spark, sources, url="http://host.example/{}"):
    rows = [(i, url.format(i), s) for i, s in enumerate(sources)]
    out = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(out, key=lambda r: r.page_id)]


SHARED = [f"Shared paragraph number {i} of the story." for i in range(4)]


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div>{}</div>"])
def test_near_copies_keep_what_they_share(spark, frame):
    own = [(f"Title {i}", f"Own ending number {i}.") for i in range(4)]
    pages = ["<html><body><nav><a href=x>Home</a></nav>" + frame.format(f"<h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in SHARED) + f"<p>{e}</p>") + "<footer>Imprint</footer></body></html>" for t, e in own]
    assert texts(spark, pages) == [" ".join([t, *SHARED, e]) for t, e in own]


def test_what_all_pages_of_a_host_repeat_goes_where_no_article_marks_the_text(spark):
    body = lambda i: f"<div><h1>Headline {i}</h1><p>{'Some words that only page %d has. ' % i * 3}</p></div>"
    pages = [f"<html><body><div><p>Welcome to our site</p></div>{body(i)}<div><p>All rights are ours</p></div></body></html>" for i in range(5)]
    assert texts(spark, pages) == [" ".join(f"Headline {i} {'Some words that only page %d has. ' % i * 3}".split()) for i in range(5)]


def test_what_some_pages_repeat_in_one_slot_goes_too(spark):
    body = lambda i: f"<div><h1>Headline {i}</h1><p>{'Some words that only page %d has. ' % i * 3}</p></div>"
    some = lambda i: "<p>We are closed on Mondays</p>" if i % 2 else ""
    pages = [f"<html><body><section>Welcome{some(i)}</section>{body(i)}<footer>F</footer></body></html>" for i in range(8)]
    assert texts(spark, pages) == [" ".join(f"Headline {i} {'Some words that only page %d has. ' % i * 3}".split()) for i in range(8)]


def test_links_that_articles_repeat_go(spark):
    pages = [f"<body><article><p>Text of page {i} and more of it</p><p><a href=/all>All of our articles</a></p></article></body>" for i in range(4)]
    assert texts(spark, pages) == [f"Text of page {i} and more of it" for i in range(4)]


@pytest.mark.parametrize(
    "inside, kept",
    [
        ('<div class="related-work"><p>Work by others</p></div>', "Work by others"),
        ('<section class="search-results"><p>We found it</p></section>', "We found it"),
        ('<div class="related"><p>As said in <a href=x>there</a>, related prose is text</p></div>', "As said in there, related prose is text"),
        ('<div class="related"><a href=x>One more</a> <a href=y>Two more</a></div>', ""),
        ('<div class="ads-and-society"><p>Of ads</p></div>', "Of ads"),
        ('<div class="ad">Buy</div>', ""),
        ('<div class="notice">We use cookies</div>', ""),
        ('<div id="comments"><p>First!</p></div>', ""),
    ],
)
def test_names_within_an_article(spark, inside, kept):
    assert texts(spark, [f"<body><article><p>Body of the text</p>{inside}</article></body>"]) == [f"Body of the text {kept}".strip()]


def test_a_teaser_is_not_the_text(spark):
    long = "A long text that nothing marks as an article. " * 5
    page = f'<body><article>Read this</article><div id="content"><p>{long}</p></div><footer>F</footer></body>'
    assert texts(spark, [page]) == [f"Read this {long}".strip()]
    assert texts(spark, ["<body><article><p>The text itself, of some length</p></article><div>Small print</div></body>"]) == ["The text itself, of some length"]


@pytest.mark.parametrize("text", ["½", "²", "Ⅷ", "①", "½ ² Ⅷ ①", "12 _ !", "", None])
def test_a_text_without_letters_has_no_language(spark, text):
    docs = spark.createDataFrame([(i, "plain words of a language", "en") for i in range(9)] + [(20, text, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.language_digest(docs).collect()}[20] == "und"
    assert 20 not in {r.doc_id for r in langid.keep_identified(docs).collect()}


@pytest.mark.parametrize("at_once", [5000, 400])
def test_no_language_is_left_out(spark, monkeypatch, at_once):
    monkeypatch.setattr(langid, "LANGUAGES", at_once)
    word = lambda i: "".join(chr(0x4E00 + 3 * i + k) for k in range(3))
    docs = spark.createDataFrame([(i, word(i), f"l{i:04d}") for i in range(1003)], "doc_id long, text string, lang string").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.selectExpr("text", "lang", "xxhash64(doc_id) AS __order"))
    assert len(profiles) == 1003
    said = {r.doc_id: r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), profiles).collect()}
    assert said == {i: f"l{i:04d}" for i in range(1003)}

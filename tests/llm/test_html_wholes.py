import pytest

from folio.llm.html_extraction import Page, main_texts

TEXT = "The article has a sentence that is long enough to count as text. " * 4
SMALL = "<nav><a href=x>menu</a></nav>"
WANT = TEXT.strip()


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><meta charset=x><body>{SMALL}<div><p>{TEXT}</div>",
        f"<html><head><title>t</title><div><p>{TEXT}</div>",
        f"<body><div class='page with-sidebar'>{SMALL}<div><p>{TEXT}</div><div class=sidebar>aside</div></div>",
        f"<body class=no-comments><div class=has-header><p>{TEXT}</div><div id=comments><p>me too</div>",
        f"<body><form action=x>{SMALL}<div><p>{TEXT}</div></form>",
        f"<body>{SMALL}<div style='overflow:hidden'><p>{TEXT}</div>",
        f"<body>{SMALL}<div><p data-hidden='0'>{TEXT}</div>",
        f"<body>{SMALL}<div data-id='comments' data-class=menu><p>{TEXT}</div>",
        f"<body>{SMALL}<div><p title='role=dialog here' alt=\"class='menu' hidden\">{TEXT}</div>",
        f"<body>{SMALL}<div><p>{TEXT}<p hidden>x<p HIDDEN=''>y<p aria-hidden = 'true'>z</div>",
        f"<body><div id=menu>{SMALL}<div><p>{TEXT}</div></div>",
    ],
)
def test_article_stays(page):
    page = Page(page)
    assert page.text([]) == WANT


def test_headings_and_sections_stay():
    page = f"<body><article><p>{TEXT}</p><h2 id=related-work>Others</h2><section id=related-work><p>More.</p></section><h2 id=search>Find</h2><div class='share-buttons'>x</div><div class=AdSlot>y</div></article>"
    assert Page(page).text([]) == f"{WANT} Others More. Find"


def test_page_of_a_second_template(spark):
    usual = f"<body><div class=story><p>{TEXT}</div>"
    other = f"<body><div class=story><p>Short note.</div><div class=body2><p>{TEXT}{TEXT}</div>"
    rows = spark.createDataFrame([*((i, "http://a.b/c", usual) for i in range(5)), (9, "http://a.b/d", other)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in main_texts(rows).collect()}
    assert f"{WANT} {WANT}" in found.pop(9)
    assert found == {i: WANT for i in range(5)}


def test_deep_pages_take_memory_by_their_nodes():
    import tracemalloc

    page = "<body>" + "<div class=a>" * 40_000 + f"<p>{TEXT}"
    tracemalloc.start()
    assert Page(page).text([]) == WANT
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_page_without_elements_and_paths_it_lacks():
    assert Page("plain <b>text</b>").text(["/body/div.x"]) == "plain text"
    assert Page(f"<body><div class='w-1/2'><p>{TEXT}</div>").containers(1)[0][0] == "/body/div.w-"

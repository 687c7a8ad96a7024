import random

import pytest

from kindling.llm import html_text
from kindling.llm.html_text import extract_text, lines_of, main_text, surges

CASES = {
    "<article><h1>A  b</h1><p>One <b>two<br>three</b>&amp;&eacute;<p>Four</article>": "A b\n\nOne two three&é\n\nFour",
    "<nav><ul><li>Home</nav><div class='ad x'>Buy <p>now</p></div><main><p>Text</p><aside>no</aside><p>more</main><footer>c</footer>": "Text\n\nmore",
    "<body><p>Plain page</p><p>of two blocks</p></body>": "Plain page\n\nof two blocks",
    "<article><header><h1>Title</h1></header><p>Body</p><section id=comments><p>me too</p></section></article>": "Title\n\nBody",
    "<article><p>a &lt;b&gt; &#x41;&nbsp;c<!-- <p>no --></p><script>var t='</p>';</script><style>p{}</style></article>": "a <b> A c",
    "<article><p title='a>b'>kept</p><form><input><p>field</p></form></article>": "kept",
    "<div class=cookie-notice>We use cookies</div><div><p>Only this</p></div>": "Only this",
    "<p>never closed": "never closed",
    "<article></article>": "",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_main_text(page):
    assert main_text(page) == CASES[page]


def test_null_page_and_broken_markup():
    assert main_text(None) == ""
    assert main_text("a < b and c > d <<>> </nothing>") != ""
    assert main_text("<" * 5000) is not None


def test_surge_and_dive_points():
    assert surges([0, 0, 5, 3, 0, 2, 0, 0, 0, 4], 3) == [(2, 6), (9, 10)]
    assert surges([], 3) == [] and surges([0, 0], 3) == []
    assert surges([1], 3) == [(0, 1)]


def test_lines_know_where_they_are():
    lines = [x for x in lines_of("<nav>n</nav><article>t</article>") if x[0]]
    assert lines == [("n", True, False), ("t", False, True)]


def test_very_long_page():
    page = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    assert main_text(page).count("\n\n") == 19_999


LONG = "A paragraph of running text that goes on for a while, as those of articles do on most pages."


def test_window_sums_decide_without_names():
    menu = "<table>" + "".join(f"<tr><td>{w}</td></tr>" for w in ("Home", "About us", "Contact", "Jobs")) + "</table>"
    links = "<div>" + "".join(f"<div><a href=x>A long headline of another page number {i}</a></div>" for i in range(6)) + "</div>"
    footer = "<div>Imprint</div><div>Terms</div><div>Privacy</div><div>2024</div>"
    text = f"<div><h1>Title</h1><div>{LONG}</div><div>Short.</div><div>{LONG} <a href=y>link</a></div></div>"
    assert main_text(f"<body>{menu}{links}{text}{links}{footer}</body>") == f"Title\n\n{LONG}\n\nShort.\n\n{LONG} link"


@pytest.mark.parametrize("page", [
    f"<div class='site has-sidebar'><article><p>{LONG}</p></article></div>",
    f"<div id='page' class='with-comments'><p>{LONG}</p></div>",
    f"<article class='post category-social widget'><p>{LONG}</p></article>",
    f"<div class='sidebar'><main><p>{LONG}</p></main></div>",
    f"<div class='widget'><p>{LONG}</p></div>",
    f"<article><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG} {LONG}</p></article></section>",
])
def test_names_of_wrappers(page):
    assert main_text(page) == LONG


def test_window_sums_decide_in_articles(monkeypatch):
    links = [f"Another story {i}" for i in range(4)]
    listed = "".join(f"<p><a href=x>{w}</a></p>" for w in links)
    page = f"<article><h1><a href=x>Title</a></h1><p>By me</p><p>{LONG}</p>{listed}<p>{LONG}</p><p>The end.</p></article><p>{LONG}</p>"
    text, rest = f"Title\n\nBy me\n\n{LONG}", f"{LONG}\n\nThe end."
    assert main_text(page) == f"{text}\n\n{rest}"
    monkeypatch.setattr(html_text, "WINDOW", 6)
    assert main_text(page) == "\n\n".join([text, *links, rest])
    monkeypatch.setattr(html_text, "WINDOW", 1)
    monkeypatch.setattr(html_text, "SHARE", 0.9)
    monkeypatch.setattr(html_text, "MOST", 100)
    assert main_text(page) == f"{LONG}\n\n{LONG}"
    monkeypatch.setattr(html_text, "surges", lambda *a: [])
    assert main_text(page) == ""


def test_window_sums_as_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        weights = [rng.choice([0, 0, 1, 5, 30]) for _ in range(rng.randint(0, 25))]
        window, threshold = rng.randint(1, 5), rng.choice([0, 1, 4, 20])
        kept, on = [], False
        for i, w in enumerate(weights):
            above = sum(weights[i : i + window]) > threshold
            on = above and (on or w > threshold / window)
            kept += [i] if on else []
        assert [i for a, b in surges(weights, window, threshold) for i in range(a, b)] == kept


def test_heading_in_an_article_stays():
    assert main_text(f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>") == f"Title\n\n{LONG}"


def test_table(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "old"), (2, None, None, "old"), (None, "v", "", None), (1, "u", "<article><p>x</p></article>", "old")]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text"]
    assert sorted(map(str, (r["text"] for r in out.collect()))) == ["", "", "x", "x"]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0

"""Main text: parsing, alignment, and comparison with the nearest page of the host."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm import alignment
from sievelake.llm.alignment import common
from sievelake.llm.main_text import extract_pages, shared_lines
from sievelake.llm.markup import lines_of

from . import brute

SCHEMA = "page_id long, url string, html string"


def kept(page):
    lines = lines_of(page)
    return [x.text for x in lines if not x.label and (x.article or not any(y.article for y in lines))]


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
@settings(max_examples=200, deadline=None)
def test_common(a, b):
    pairs = common(a, b)
    assert len(pairs) == brute.common_length(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_common_in_halves(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_BITS", 50)
    a, b = [(i * 7) % 13 for i in range(90)], [(i * 5) % 13 for i in range(70)]
    pairs = common(a, b)
    assert len(pairs) == brute.common_length(a, b) and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize(
    "page, right",
    [
        ("<p>a <b>b<p>c", ["a b", "c"]),
        ("x &amp;&lt; &eacute;&#233;&#x41; &am &amp y", ["x &< éé" + "A &am & y"]),
        ("<p>one\n  two<br>three</p> tail", ["one two three", "tail"]),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><title>t</title>text", ["text"]),
        ("<script>never closed <p>x</p>", []),
        ("a < b <> c </ d", ["a < b <> c"]),
        ("<!-- c -->a<!-- <p>b</p> -->c<!-- open", ["ac"]),
        ('<p title="a > b">x</p><p title=\'<p>\'>y</p>', ["x", "y"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", ["a", "b", "c", "d", "e"]),
        ("<nav>menu</nav><header>h</header><main>m</main><footer>f</footer>", ["m"]),
        ("<header>site</header><article><header><h1>T</h1></header><p>x</p><footer>tags</footer></article>", ["T", "x"]),
        ('<div class="has-sidebar"><article>x</article></div><div class="sidebar">s</div>', ["x"]),
        ('<article>x<section id="comments"><article class="comment">c</article></section></article>', ["x"]),
        ('<div id="cookieNotice">c</div><div role="alert">d</div><p>x</p><form><input>q</form><div class="ad">buy</div>', ["x"]),
        ('<p>say <button>Copy</button> more <span hidden>no</span></p>', ["say more"]),
        ("<aside>s<article>teaser</article></aside><article>x</article>", ["x"]),
        ("<html><head><meta charset=u><title>t</title><p>x", ["x"]),
        ("<div " + "a" * 50, []),
        (None, []),
        ("", []),
    ],
)
def test_lines(page, right):
    assert kept(page) == right


def test_odd_pages_end():
    for page in ("<div>" * 20_000 + "x", "<b><p>" * 5_000 + "x", "</p>" * 20_000, "<p>x" * 20_000, '<a title="' * 5_000, "<span class=ad>x</span> y " * 5_000, "&" * 20_000):
        lines_of(page)


def test_shared_lines():
    sizes = [10, 80, 10]
    assert shared_lines([1, 2, 3], sizes, [1, 5, 3], None) == ([0, 2], 1)
    assert shared_lines([1, 2, 3], sizes, [1, 2, 3], [1, 9, 3]) == ([0, 2], 2)  # a copy: the page on the other side decides
    assert shared_lines([1, 2, 3], sizes, [1, 2, 3], [1, 2, 3]) == ([], 0)
    assert shared_lines([1, 2, 3], sizes, [1, 2], [1, 7, 3]) == ([0, 2], 2)
    assert shared_lines([1, 2, 3], [30, 60, 30], [1, 2, 7], [1, 8]) == ([0], 3)
    assert shared_lines([1, 2, 3], sizes, None, None) == ([], 0)
    assert shared_lines([], [], [1], [2]) == ([], 1)


def template(title, *paragraphs):
    """A page without any marks: only its neighbours tell what belongs to the host."""
    return f"<body><div>Daily Herald</div><div><a>Home</a></div><div><a>World</a></div><div>{title}</div>{''.join(f'<div>{p}</div>' for p in paragraphs)}<div>All rights reserved</div><div>Contact us</div>"


def test_unmarked_template(spark):
    rows = [(i, f"http://herald.example/{'news' if i % 2 else 'sport'}/{i}?x=1", template(f"Title {i}", *[f"Paragraph {i} {j} which says something of its own" for j in range(3)], "Contact us")) for i in range(40)]
    rows += [(100 + i, f"https://other.example/{i}", template(f"Other {i}", f"text {i}")) for i in range(1)]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    for i in range(40):
        assert got[i].text.split("\n")[:4] == [f"Title {i}"] + [f"Paragraph {i} {j} which says something of its own" for j in range(3)]
        assert "Herald" not in got[i].text and "rights" not in got[i].text and got[i].n_shared >= 5
    assert got[100].text.startswith("Daily Herald") and got[100].n_shared == 0


def test_copies_keep_their_text(spark):
    """Copies beside each other are no template, and articles keep what their neighbours quote."""
    rows = [(i, f"http://a.example/{i}", template("Same title", "the same paragraph, which is much longer than everything around it " * 20)) for i in range(3)]
    rows += [(10 + i, f"http://b.example/{i}", f"<nav>n{i}</nav><article><p>All rights reserved.</p><p>own {i}</p></article>") for i in range(3)]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all("the same paragraph" in got[i].text for i in range(3))
    assert [got[10 + i].text for i in range(3)] == [f"All rights reserved.\nown {i}" for i in range(3)]
    assert all(got[10 + i].n_shared == 1 for i in range(3))


def test_edge_cases(spark):
    rows = [(1, None, None), (None, "http://a.example", ""), (2, "not a url", "<p>x"), (2, "not a url", "<p>x"), (3, "http://A.example:80/p#f", "<p>" + "long " * 300_000), (4, "http://u@a.example/p?q", "퟿\U0001f389 <p>&nbsp;z&nbsp;</p>")]
    pages = spark.createDataFrame(rows, SCHEMA)
    for frame in (pages, pages.selectExpr("*", *[f"'{c}' AS `{c}`" for c in ("key", "host", "path", "names", "gone", "text", "page", "range")])):
        got = extract_pages(frame)
        assert got.columns == ["page_id", "url", "text", "n_chars", "n_shared"]
        by = sorted(((r.page_id, r.text[:9], r.n_chars) for r in got.collect()), key=str)
        assert by == sorted([(1, "", 0), (None, "", 0), (2, "x", 1), (2, "x", 1), (3, "long long", 1_499_999), (4, "퟿\U0001f389\nz", 4)], key=str)
    assert extract_pages(pages.limit(0)).count() == 0

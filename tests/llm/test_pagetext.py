import random

import pytest

from driftloom.llm import pagetext
from driftloom.llm.queries import op12_pagetext

KIND = "page_id long, url string, html string, text string, lines int"


def texts(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)
    return {r.page_id: r.text for r in pagetext.main_texts(frame.repartition(3), **more).collect()}


def text(page):
    said, lines = pagetext.read_page(page)
    return " ".join(t for k, t in lines if k == (pagetext.TEXT if said else pagetext.OPEN))


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("no markup &amp; more", "no markup & more"),
        ("<article><h1>A&nbsp;&lt;b&gt;</h1><p><b>One<br>two<p>three\n\n four</article><footer>&copy; x</footer>", "A <b> One two three four"),
        ("<article>a<i>b</i>c<span class='ad'>buy</span>d</article>", "abcd"),
        ("<nav>n</nav><article>t</article>", "t"),
        ("<body><header>site<h1>x</h1></header><article><header><h1>Title</h1></header><p>t<aside>s</aside><form>f<input>g</form><footer>by</footer></article>", "Title t"),
        ("<article>t<article>a reader says</article></article>", "t"),
        ("<main><p>m<section id='comments'><p>c</section></main>", "m"),
        ("<main><div class='related'><article>teaser</article></div><article>t</article></main>", "t"),
        ("<div class='page with-sidebar'><article>t</article></div>", "t"),
        ("<div class='widget'><article>t</article></div>", "t"),
        ("<div class='layout sidebar'><main>t</main></div>", "t"),
        ("<aside><main>t</main></aside><p>u", "u"),
        ("<article>a<script>var x='</p><article>';</script>b<style>p{}</style><!-- <p>c -->d<!-->e", "abde"),
        ("<article>x<script>never ends", "x"),
        ("<article>1 < 2 & 3 <3 &lt;p&gt; &am &ampx &#x41;&#66;</article>", "1 < 2 & 3 <3 <p> &am &x AB"),
        ("<article><p title='a>b' class=\"x\">t</p></article>", "t"),
        ("<article><p class=ad>buy<p>t</article>", "t"),
        ("<ARTICLE><P>T</P></ARTICLE><DIV ID=cookieNotice>c</DIV>", "T"),
        ("<div><p>t</div><div class='cookie-consent'>c</div><div hidden>h</div><div style='display: none'>n</div><div role=navigation>r</div>", "t"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>", "a b c d 1 2 3"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
        ("<p class='has-ads shadow headers readmore'>t", "t"),
        ('<article><a href="unclosed>t</article>', '"unclosed>t'),
    ],
)
def test_one_page(page, want):
    assert text(page) == want


def test_places():
    assert pagetext.place_of("HTTPS://u:p@Www.Host.org:80/a/b.html?q=/x#y") == ("www.host.org:80", "a/b.html")
    assert pagetext.place_of("//h/a") == ("h", "a") and pagetext.place_of(None) == ("", "") and pagetext.place_of(" h ") == ("h", "")
    assert pagetext.nearest("a/b/c", "a/b", "a/b/d") == 1 and pagetext.nearest("a/bc", "a/b", "a/c") == 0 and pagetext.nearest("x", None, None) is None


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("cells", [1, 40, 1 << 26])
def test_alignment_is_a_longest_one(monkeypatch, cells):
    monkeypatch.setattr(pagetext, "CELLS", cells)
    rng = random.Random(2)
    for _ in range(300):
        kinds = rng.choice([2, 5, 40])
        a, b = ([rng.randrange(kinds) for _ in range(rng.randint(0, 30))] for _ in range(2))
        found = pagetext.common_lines(a, b)
        rest = iter(b)
        assert found == sorted(set(found)) and all(any(a[i] == y for y in rest) for i in found) and len(found) == length(a, b)


def site(n):
    """Pages whose markup tells nothing: a menu, a greeting, own sentences with one of a few stock lines, and a closing line."""
    rows, want = [], {}
    for i in range(n):
        host, own = f"h{i % 3}.org", [f"Sentence {i} number {k}." for k in range(1 + i % 4)]
        menu = "".join(f"<div>{w} {i % 3}</div>" for w in ("Home", "News", "About"))
        body = "".join(f"<div>{s}</div>" for s in own)
        rows.append((i, f"http://{host}/{'xy'[i % 2]}/{i:05d}?v={i}", f"<body>{menu}<div>Welcome</div>{body}<div>All rights, {i % 3}</div>"))
        want[i] = " ".join(own)
    return rows, want


def test_differencing_on_pages_whose_markup_is_silent(spark):
    rows, want = site(120)
    assert texts(spark, rows) == want
    # one host, dealt over many tasks: the ends of the stretches are paired, too
    rows = [(i, u.replace("h1.org", "h0.org").replace("h2.org", "h0.org"), h.replace(" 1<", " 0<").replace(" 2<", " 0<").replace(", 1", ", 0").replace(", 2", ", 0")) for i, u, h in rows]
    assert texts(spark, rows) == want


def test_copies_alone_and_odd_rows(spark):
    page = "<div>Menu</div><div>Text</div>"
    rows = [(1, "http://a/x", page), (2, "http://a/y", page), (3, "http://b/x", page), (4, None, page), (5, None, "<div>Menu</div>"), (6, "http://c/p?1", page), (7, "http://c/p?2", page.replace("Text", "More"))]
    got = texts(spark, rows)
    assert {got[i] for i in (1, 2, 3, 4, 6)} == {"Menu Text"}  # equal pages are no partners, nor are those of one path
    assert got[5] == "Menu" and got[7] == "Menu More"
    twice = spark.createDataFrame([(8, "http://d/1", page, "", 0), (8, "http://d/1", page, "", 0), (None, "http://d/2", "<div>Menu</div><div>Other</div>", "", 0), (9, "http://d/3", None, "", 0)], KIND)
    assert sorted((str(r.page_id), r.text) for r in pagetext.main_texts(twice).collect()) == [("8", "Text"), ("8", "Text"), ("9", ""), ("None", "Other")]


def test_very_long_pages(spark):
    shared = [f"<div>line {i}</div>" for i in range(20_000)]
    rows = [(i, f"http://a/{i}", "".join(shared[:10_000]) + f"<div>own {i}</div>" + "".join(shared[10_000:])) for i in range(2)]
    assert texts(spark, rows) == {0: "own 0", 1: "own 1"}
    assert len(text("<article>" + "word " * 400_000)) == 2_000_000 - 1


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/pages.parquet")
    assert op12_pagetext(spark, str(tmp_path)).collect() == []


def test_differencing_alone(spark):
    """Without markup, what two neighbours don't share stays: adverts of their own, too."""
    rows = [(i, f"http://a/{i}", f"<nav>Menu</nav><div class=ad>Buy {i}</div><article>Text {i}</article>") for i in range(3)]
    assert texts(spark, rows, markup=False) == {i: f"Buy {i} Text {i}" for i in range(3)}
    assert texts(spark, rows) == {i: f"Text {i}" for i in range(3)}

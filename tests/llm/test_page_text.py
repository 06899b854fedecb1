import math
import random

import pytest

from cliploom.llm import page_text

PLAIN = page_text.Weights({}, {})


def text(page, weights=PLAIN):
    return page_text.main_text(page, weights)


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("   ", ""), ("just words", "just words"), ("<p>a &lt;b&gt; &amp;amp; c&nbsp;&nbsp;d\n e", "a <b> &amp; c d e"),
    ("<article><h1>T</h1><p><b>x</b>y<br>z<p>w</article><footer>f</footer>", "T xy z w"),
    ("<nav>m m m</nav><main><p>one</p><div class='ad'>buy it now</div><p>two</p></main>", "one two"),
    ("<article><p>one</p><section id=comments><p>so nice a text</p></section><p>two</p></article>", "one two"),
    ("<article><header class=entry-header><h1>T</h1></header><p>a</p><footer>by me</footer></article><header>h</header>", "T a"),
    ("<body class='has-sidebar'><article><p>a b</p><aside>c d</aside></article>", "a b"),
    ("<script>if (a < b) '<p>no</p>'</script><style>p{}</style><article><p>yes</p><script>var t='</p>'", "yes"),
    ("<article><p title='a > b'>x<!-- <p>no</p> --> y</p></article>", "x y"), ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<article><p>x<a href='y'>in a link</a> and on</p></article>", "xin a link and on"), ("<article></article><p>rest of it</p>", "rest of it"),
    ("<form><p>a</p></form><div><p>long enough text here</p></div>", "long enough text here"),
    ("<article><p>unclosed <b>bold <p>next</article>", "unclosed bold next"), ("<p hidden>no</p><p>yes</p>", "yes"),
    ('<a href="x', ""), ("<article><p>a<img src=x>b</p><form>f<p>g</form><p>c</p></article>", "ab c"),
])
def test_pages(page, want):
    assert text(page) == want


def test_scan_finds_the_article_without_marks():
    page = "<ul>" + "<li><a href=x>menu entry</a></li>" * 8 + "</ul><h1>Head line</h1><p>some words of text.</p><p>and some more words.</p><ul>" \
        + "<li><a href=y>other page</a></li>" * 8 + "</ul><div><a href=z>imprint</a></div>"
    assert text(page) == "Head line some words of text. and some more words."


def test_weights_are_learned_from_marked_pages(spark):
    marked = "<div><p>menu words</p></div><article><h1>t</h1>" + "<p>text of the page</p>" * 5 + "</article><td>low</td>"
    df = spark.createDataFrame([(i, "u", marked, None) for i in range(9)] + [(9, "u", None, None), (10, "u", "", None), (9, "u", None, None)],
                               "page_id long, url string, html string, text string")
    weights = page_text.learn_weights(df)
    assert weights.words["p text"] > 0 > weights.words["td text"]
    rows = page_text.page_texts(df).collect()
    assert len(rows) == 12 and set(rows[0].asDict()) == {"page_id", "url", "text"}
    assert {r["text"] for r in rows} == {"t" + " text of the page" * 5, ""}


def test_no_pages(spark):
    assert page_text.page_texts(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_many_quotes_and_brackets_stay_linear():
    page = "<article><p>" + "<a b='" * 3000 + "</p>" + "<" * 20000 + "</article>"
    assert isinstance(text(page), str)


BODY = "<p>" + "plain words of the body text " * 8 + "</p>"
WANT = ("plain words of the body text " * 8).strip()


@pytest.mark.parametrize("page", [
    f"<div>{BODY}</div><ul>" + "<li><article><a href=x>teaser of another page</a></article></li>" * 4 + "</ul>",
    f"<article>{BODY}</article><div><article class=comment><p>{'a reader says so ' * 9}</p></article></div>",
])
def test_the_mark_alone_does_not_decide(page):
    assert text(page) == WANT


def test_learned_weights_are_looked_up_on_marked_pages():
    page = f"<article>{BODY}<table><td>low low low low low low</td></table></article>"
    assert text(page, page_text.Weights({"td text": -4.0}, {})) == WANT


@pytest.mark.parametrize("page", [
    f"<div class='layout right-sidebar'><article>{BODY}</article></div>", f"<div class='page sidebar-left'><main>{BODY}</main></div>",
    f"<div class='elementor-widget-container'>{BODY}</div>", f"<body><div class='ad'>buy<article>{BODY}</article></body>",
])
def test_text_outweighs_the_name_of_a_wrapper(page):
    assert text(page) == WANT


def test_linear_scan_equals_all_stretches():
    """The best of all (begin, end) pairs, on random blocks."""
    rng = random.Random(8)
    weights = page_text.Weights({"p text": 2.0, "li link": -1.5, "td text": 0.3}, {"div": -0.7, "/div": -1.1, "p": 0.0})
    for _ in range(400):
        found = [page_text.Block(
            f"block{i}", rng.choice(["p text", "li link", "td text", "dd text", "h1 link"]), rng.choice([1, 2, 3, 8]), rng.random() < 0.2, False,
            tuple(rng.choice(["div", "/div", "p", "ul"]) for _ in range(rng.randint(0, 4))), rng.random() < 0.2) for i in range(rng.randint(0, 12))]
        for named in (False, True):
            out = [b.skipped or b.named and not named for b in found]
            value = [page_text.BOILERPLATE if o else b.words * weights.words.get(b.kind, 1.0 if b.kind.endswith("text") else -1.0) for b, o in zip(found, out)]
            tags = [sum(weights.tags.get(t, weights.tag) for t in b.tags) for b in found]
            every = {(a, e): sum(value[a:e]) + sum(tags[a + 1 : e]) for a in range(len(found)) for e in range(a + 1, len(found) + 1)}
            top = max([0.0, *every.values()])
            texts = {" ".join(found[i].text for i in range(a, e) if not out[i]) for (a, e), v in every.items() if v > top - 1e-9 and v > 0}
            best, text = page_text._best_stretch(found, weights, named)
            assert abs(best - top) < 1e-9 and text in (texts or {""})


def test_weights_equal_plain_counts(spark):
    rng = random.Random(3)
    page = lambda i: "<div class=x>" + "".join(f"<a href=u>m{j} m</a>" for j in range(rng.randint(1, 5))) + (
        "</div><article>" if i % 3 else "</div><div>") + "".join(f"<p>{'w ' * rng.randint(1, 9)}</p>" for _ in range(3)) + (
        "</article>" if i % 3 else "</div>") + "<footer>f</footer><ul><li>z"
    pages = [page(i) for i in range(40)] + [None, ""]
    inside, outside = {}, {}
    for html in pages:
        found = page_text.blocks(html or "")
        if not any(b.marked and not b.skipped and not b.named for b in found):
            continue
        for b in found:
            side = inside if b.marked and not b.skipped and not b.named else outside
            if not b.skipped and not b.named:
                side[f"w {b.kind}"] = side.get(f"w {b.kind}", 0) + b.words
            for t in b.tags:
                side[f"t {t}"] = side.get(f"t {t}", 0) + 1
    ratio = lambda n: max(-4.0, min(4.0, math.log((inside.get(n, 0) + 1) / (outside.get(n, 0) + 1))))
    names = inside.keys() | outside.keys()
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = page_text.learn_weights(df)
    assert got.words == pytest.approx({n[2:]: ratio(n) for n in names if n[0] == "w"})
    assert got.tags == pytest.approx({n[2:]: min(0.0, ratio(n)) for n in names if n[0] == "t"})
    # of more kinds than the bound the most frequent ones stay, equal ones by name
    count = {n: inside.get(n, 0) + outside.get(n, 0) for n in names}
    first = sorted(names, key=lambda n: (-count[n], n))[:3]
    few = page_text.learn_weights(df, max_kinds=3)
    assert few.words.keys() | few.tags.keys() == {n[2:] for n in first}

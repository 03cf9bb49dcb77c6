import random
import time

from tallyweave.llm.html import Open, Weights, best_run, extract, learn, main_text, pieces

PAGE = (
    '<!DOCTYPE html><html><head><title>No</title><style>p{{a>b}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li>'
    '<li><a href="/y">more menu</a></li></ul></nav><div class="ad">buy now <b>today</b></div><article><h1>Head &amp; line {0}</h1><p>First <b>bold</b>\n  words here'
    "<p>Second, unclosed &lt;p&gt;<br>same block</p></article><footer>&copy; foot words</footer>"
)
TEXT = "Head & line {0}\nFirst bold words here\nSecond, unclosed <p> same block"


def test_learns_weights_and_extracts_every_page(spark):
    rows = [(i, f"u{i}", PAGE.format(i), "q") for i in range(40)] + [(100, None, None, "q"), (101, "u", "", "q"), (102, "u", "bare words", "q"), (7, "again", PAGE.format("x" * 300000), "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    weights = learn(pages)
    assert weights["t:p"] > 0 > weights["t:nav"]
    found = {(x.page_id, x.url): x.text for x in extract(pages, weights).collect()}
    assert len(found) == len(rows)
    assert all(found[i, f"u{i}"] == TEXT.format(i) for i in range(40))
    assert [found[k] for k in ((100, None), (101, "u"), (102, "u"))] == ["", "", "bare words"]
    assert found[7, "again"] == TEXT.format("x" * 300000)
    assert extract(pages.limit(0), learn(pages.limit(0))).collect() == []


def test_priors_serve_pages_without_an_article_element():
    html = (
        '<div id="sidebar"><p>side words here</p></div><div class="post"><h2>T</h2><p>Hello &amp; <b>bo</b>ld&nbsp;x</p><div class="ad"><p>buy now</p></div><ul><li>One</li><li>Two</li></ul>'
        '<p>More text of it here.</p></div><section class="user-comments"><p>nice</p></section><form><p>sub</p></form><!-- <p>no</p> --><aside>x</aside>'
    )
    assert main_text(html, Weights()) == "T\nHello & bold x\nOne\nTwo\nMore text of it here."
    assert main_text("<nav>a b c</nav>", Weights()) == "" and main_text(None, Weights()) == ""
    assert main_text("<article><p>cut off <b>in the mid", Weights()) == "cut off in the mid"


def test_pages_that_are_not_well_formed():
    art, text = "<article><h1>T</h1><p>one two three four five six seven eight</p></article>", "T\none two three four five six seven eight"
    pages = [
        "<html><head><title>x</title><body>" + art,
        "<head><title>x<body>" + art,
        "<svg-icon></svg-icon>" + art,
        "<svg><text>no</text></svg>" + art + "<script>var x = '<p>no</p>'",
        "<form>" + art + "<input></form>",
        '<div class="content-sidebar layout">' + art + "</div>",
        "<nav>a b</nav>" + art + "<section class=comments><article><p>nice one</p></article></section>",
    ]
    assert [main_text(h, Weights()) for h in pages] == [text] * len(pages)
    assert main_text("<article><p>line one<br>line two<br/>three</p></article>", Weights()) == "line one line two three"
    assert main_text("<article><p><a href=\"x\"\">the link</a> and <a title=it's href=x>more</a> text</p></article>", Weights()) == "the link and more text"


def test_an_article_keeps_its_own_header_and_loses_what_is_not_shown():
    body = "<p>one two three four five six seven</p>"
    text = "one two three four five six seven"
    for head in ("<header><h1>Headline here</h1></header>", '<div class="post-header"><h1>Headline here</h1></div>', '<div class="head"><h1>Headline here</h1></div>'):
        assert main_text(f"<header><p>site name</p></header><article>{head}{body}</article>", Weights()) == f"Headline here\n{text}"
    assert main_text(f'<div class="post"><div class="post-header"><h1>Headline here</h1></div>{body}</div>', Weights()) == f"Headline here\n{text}"
    assert main_text(f'<div class="main-header">site name</div><div class="post">{body}</div>', Weights()) == text
    for hidden in ("hidden", 'hidden="until-found"', 'style="color:red; display : none"', "style=visibility:hidden", 'title="a" HIDDEN'):
        assert main_text(f"<article>{body}<p {hidden}>not shown at all</p>{body}</article>", Weights()) == f"{text}\n{text}"
    for shown in ('title="the hidden cost"', 'data-hidden="x"', 'aria-hidden="false"', 'title="display:none"', "style='display:block'"):
        assert main_text(f"<article>{body}<p {shown}>shown</p></article>", Weights()) == f"{text}\nshown"


def brute(scores):
    """The best sum of all contiguous runs, or zero."""
    return max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])


def test_the_scan_finds_the_best_of_all_runs():
    r = random.Random(6)
    for _ in range(60):
        parts = [r.choice(["<p>" + "w " * r.randrange(1, 9) + "</p>", "<nav>" + "n " * r.randrange(1, 4) + "</nav>", "<div>x</div>", "<article>" + "a " * r.randrange(1, 6) + "</article>", "<br>"]) for _ in range(r.randrange(1, 9))]
        open_, scores = Open(Weights()), []
        for kind, value in pieces("".join(parts), open_):
            scores.append(len(value.split()) * open_.score() if kind == "text" else -0.1)
        best, span = best_run(scores)
        assert abs(best - brute(scores)) < 1e-9 and abs(sum(scores[span[0] : span[1]]) - best) < 1e-9


def test_time_grows_with_the_page():
    def took(html):
        began = time.process_time()
        main_text(html, Weights())
        return time.process_time() - began

    for part in ("<i>x ", "<title>", "<div><p>x", "<svg>", '<a href="', "</b><b>x"):
        assert took("<article>" + part * 40000) < 8 * took("<article>" + part * 10000) + 0.5

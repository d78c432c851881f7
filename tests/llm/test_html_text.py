"""Main text of pages whose text is known, edge runs of links, wrapping forms, deep nesting."""

import random
import time

import pytest

from fieldorder.llm import html_text

WORDS = "river stone winter market garden letter window summer bridge forest candle harbour meadow engine".split()
MENU = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>"


def prose(r, low, high):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))).capitalize() + "."


def block(r, depth):
    """Markup of one piece of an article and the lines it must give."""
    kind = r.randint(0, 7 if depth else 4)
    if kind <= 2:
        text = prose(r, 12, 60)
        return f"<p>{text.replace(' ', ' <b>', 1).replace(' ', '</b> ', 2) if kind == 2 else text}</p>", [" ".join(text.split())]
    if kind == 3:
        text = prose(r, 2, 4)
        return f"<p>{text}", [text]
    if kind == 4:
        text = prose(r, 2, 3)
        return f"<h2>{text}</h2>", [text]
    inner = [block(r, depth - 1) for _ in range(r.randint(1, 3))]
    tag = r.choice(["div", "section", "blockquote"])
    return f"<{tag}>" + "".join(x for x, _ in inner) + f"</{tag}>", [y for _, x in inner for y in x]


NOISE = [
    "<div class=ad>Buy now</div>", "<aside><p>Beside</p></aside>", "<form><label>Mail</label><input><button>Go</button></form>", "<script>p('<p>')</script>",
    "<div class='share-bar'><a href=x>Share</a></div>", "<!-- note -->", "<div hidden>gone</div>",
]


def page(r):
    pieces, lines = [], []
    for _ in range(r.randint(4, 12)):
        html, text = block(r, 2)
        pieces.append(html)
        lines += text
        if r.random() < 0.4:
            pieces.append(r.choice(NOISE))
    first, last = prose(r, 20, 40), prose(r, 20, 40)
    links = "".join(f"<li><a href=/{i}>{prose(r, 2, 5)}</a></li>" for i in range(r.randint(2, 9)))
    inner = f"<h1>The title</h1><p>{first}</p>{''.join(pieces)}<p>{last}</p><h3>More stories</h3><ul>{links}</ul>"
    wrap = ["{}", "<form action=x>{}</form>", "<div class='page has-sidebar'>{}</div>"][r.randint(0, 2)]
    body = wrap.format(f"{MENU}<article>{inner}</article><footer>foot</footer>")
    return f"<html><head><title>t</title></head><body>{body}</body></html>", "\n".join(["The title", first, *lines, last])


@pytest.mark.parametrize("seed", range(150))
def test_pages_with_known_text(seed):
    html, want = page(random.Random(seed))
    assert html_text.main_text(html) == want


def test_links_at_the_edges_of_an_article():
    para = "".join(f"<p>Part {i} goes on with many words, as the prose of a page does, for a while.</p>" for i in range(5))
    want = [f"Part {i} goes on with many words, as the prose of a page does, for a while." for i in range(5)]
    more = "".join(f"<li><a href={i}>Read more story {i}</a></li>" for i in range(8))
    text = lambda inner: html_text.main_text(f"<body>{MENU}<article>{inner}</article></body>").split("\n")
    for tag in ("article", "main"):
        assert html_text.main_text(f"<{tag}>{para}<h2>Related</h2><ul>{more}</ul></{tag}>").split("\n") == want
    assert text(f"<h1>Title</h1><ul>{more}</ul>{para}") == ["Title", *want]
    assert len(text(f"{para}<ul>{more}</ul>{para}")) == 18  # links between prose belong to it
    assert text(f"<h2><a href=x>Title</a></h2>{para}<p>The end.</p>") == ["Title", *want, "The end."]
    assert text(f"{para}<p><a href=s>The source of all this</a></p>") == [*want, "The source of all this"]
    assert len(text(f"<ul>{more}</ul>")) == 8  # an article of links alone stays


def test_forms():
    para = "".join(f"<p>Part {i} goes on with many words, as the prose of a page does, for a while.</p>" for i in range(5))
    sign = "<form><p>Sign up for our letter</p><input><button>Go</button></form>"
    for page in ("<form id=main>{}</form>", "<div role=form>{}</div>", "<form><div><form>{}</form></div></form>"):
        for tag in ("article", "div"):
            got = html_text.main_text(f"<body>{page.format(f'{MENU}<{tag}>{para}{sign}</{tag}>')}</body>")
            assert got.count("Part") == 5 and "Go" not in got and "Home" not in got and "Sign" not in got


def test_deep_pages_are_linear():
    started = time.perf_counter()
    n = 100_000
    assert html_text.main_text("<div>" * n + "<p>some text here" + "</div>" * n) == "some text here"
    assert html_text.main_text("<div class=ad><form>x" * n + "<p>some text here").startswith("x\nx\n")  # those that hold half of the text
    assert html_text.main_text("<li><div>" + "<span>" * n + "<li>a b c d</li>" * n).count("a b c d") == n
    assert html_text.main_text("<article>" + "<blockquote><p>word " * n).count("word") == n
    assert time.perf_counter() - started < 240  # quadratic in depth this takes hours


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long")
    assert html_text.extract(none).count() == 0 and html_text.extract(none).columns == ["page_id", "url", "text", "n_chars"]

import html as entities
import random
import re

import pytest
from compare import DATA

from maskloom.llm.html import extract, main_text


def test_pages_of_the_table(spark):
    """Every page of the table has its article between two tags."""
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
    rows = extract(pages).collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)


LONG = "This is a long enough paragraph, with commas, that counts as text of the article and not as a menu. "


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<b>b</b>c<br>d\n\n e&nbsp;f</p>", "abc d e f"),
        ("<p>one<p>two<div>three</div>", "one two three"),
        ("<div>x < y &lt; z</div>", "x < y < z"),
        (f"<nav><a href=x>menu</a></nav><main><h2>T</h2><p>{LONG}</p><aside>no</aside></main><footer>f</footer>", "T " + LONG.strip()),
        (f"<header>site</header><article><header><h1>T</h1></header><p>{LONG}</p></article>", "T " + LONG.strip()),
        (f"<div class='cookie-notice'>we, use, cookies</div><div id=c><p>{LONG}</p></div>", LONG.strip()),
        (f"<body class=has-sidebar><div id=c><p>{LONG}</p><form><input value=x>send</form></div><section id=comments><p>{LONG}</p></section>", LONG.strip()),
        (f"<article><p>{LONG}</p><script>if (a<b) {{'</p>'}}</script><style>p{{}}</style><!-- no --><p>end.</p></article>", LONG + "end."),
        (f"<article><section><p>{LONG}{LONG}</p></section><section><p>short.</p></section></article>", (LONG * 2) + "short."),
        (f'<article><p title="a>b" class="x">{LONG}</p></article><div class="related"><p>{LONG}</p></div>', LONG.strip()),
        ("<ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>Text, text, text and more text, long enough.</p>", "Text, text, text and more text, long enough."),
        ("<p>unclosed <b>bold<p>next", "unclosed bold next"),
        ("<article><p>a</p", "a"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article class='post comments-open'><p>{LONG}</p></article><div><p>{LONG}</p></div>", LONG.strip()),
        (f"<article id=sidebar><p>{LONG}</p></article>", LONG.strip()),
        (f"<div id='content' class='with-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", LONG + LONG.strip()),
        (f"<div class='no-ads'><p>{LONG * 3}</p></div><div class='ad'>buy</div><footer>f</footer>", (LONG * 3).strip()),
        (f"<div class='widget'><p>{LONG}</p></div>", LONG.strip()),
        (f"<div id=c><p>{LONG * 4}</p></div><div class='related-posts'><p>{LONG * 3}</p></div>", (LONG * 4).strip()),
        (f"<div id=c><p>{LONG}</p></div><div class='related-posts'><a href=x>{LONG * 3}</a></div>", LONG.strip()),
        (f"<div id=c><p>{LONG}</p></div><section id=comments><article class=comment><p>{LONG * 9}</p></article></section>", LONG.strip()),
    ],
)
def test_names_do_not_take_the_article(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        # a list of links between paragraphs belongs to the article, one before or after is a menu
        (f"<div class=post><p>{LONG}</p><ul><li><a href=a>Reference one</a><li><a href=b>Two</a></ul><p>{LONG}</p></div>", f"{LONG}Reference one Two {LONG.strip()}"),
        (f"<div class=post><ul><li><a href=a>Home</a><li><a href=b>Two</a></ul><p>{LONG}</p><ul><li><a href=c>More</a></ul></div>", LONG.strip()),
        # short text beside the container
        (f"<body>Note first.<div id=c><p>{LONG}</p><p>{LONG}</p></div>menu words</body>", f"Note first. {LONG}{LONG.strip()}"),
        # links below many open elements are links
        (f"<div><p>{LONG * 2}</p><ul><li><a href=x><b><i><u><em><strong>deep link text</strong></em></u></i></b></a></ul></div>", (LONG * 2).strip()),
        ("<p><a href=x>one<p>two</a>three", "one twothree"),
    ],
)
def test_lists_loose_text_and_deep_links(page, text):
    assert main_text(page) == text


class Node:
    def __init__(self, tag, parent):
        self.tag, self.parent, self.children, self.chars, self.links = tag, parent, [], 0, 0


def random_page(rng):
    """A nested page of divs, sections, lists, paragraphs and links, as HTML and as nodes."""
    order, out = [], []

    def fill(node, depth):
        for _ in range(rng.randrange(1, 5)):
            tag = rng.choice(["div", "section", "p", "p", "p", "ul", "h2"]) if depth < 4 else "p"
            child = Node(tag, node)
            node.children.append(child)
            out.append(f"<{tag}>")
            if tag in ("div", "section"):
                fill(child, depth + 1)
            else:
                words = [f"w{rng.randrange(99)}" + rng.choice([",", "", "", "."]) for _ in range(rng.randrange(1, 40))]
                text, linked = " ".join(words), tag == "ul" or rng.random() < 0.1
                holder = child
                if tag == "ul":
                    holder = Node("li", child)
                    child.children.append(holder)
                    out.append("<li>")
                out.append(f"<a href=x><b>{text}</b></a>" if linked else text)
                order.append((holder, text, len(text) if linked else 0))
            out.append(f"</{tag}>")

    root = Node("", None)
    body = Node("body", root)
    root.children.append(body)
    fill(body, 0)
    return "<body>" + "".join(out) + "</body>", root, order


def brute_text(root, order):
    """The rules of the operator by walking up and down the nodes for every question."""
    nodes = []

    def walk(node):
        nodes.append(node)
        for child in node.children:
            walk(child)

    walk(root)

    def up(node):
        while node is not None:
            yield node
            node = node.parent

    for node in nodes:
        own = [(t, k) for holder, t, k in order if node in up(holder)]
        node.chars, node.links = sum(len(t) for t, _ in own), sum(k for _, k in own)
    holders = {"article", "main", "section", "div", "body", "html", "ul", "ol", "dl", "table", "blockquote", "td", "th"}

    def points(node):
        total = 0.0
        for holder, text, _ in order:
            chain = list(up(holder))
            if node in chain:
                level = chain.index(node)
                worth = 1 + text.count(",") + min(len(text) / 100, 3)
                if level == 0:
                    total += worth if node.tag in holders else 0
                elif node is not root:
                    total += worth * (1.0 if level == 1 else 0.5 if level == 2 else 1 / (3 * (level - 1)))
        return total * (1 - node.links / node.chars) if node.chars else 0.0

    best = max(nodes, key=lambda n: (round(points(n), 9), -nodes.index(n)))

    def sibling(node):
        if best.parent is None or node.parent is not best.parent or not node.chars:
            return False
        if node.tag in ("p", "h2"):
            return node.links < 0.25 * node.chars
        return points(node) >= max(5.0, 0.2 * points(best)) and node.links < 0.5 * node.chars

    def inside(holder):
        return any(n is best or sibling(n) for n in up(holder))

    def menu(holder):
        return any(n.tag in ("ul", "div", "section") and n is not best and n.links > 0.6 * n.chars for n in up(holder))

    plain = [k for k, (h, t, links) in enumerate(order) if not menu(h) and links < 0.25 * len(t) and inside(h)]
    ends = (plain[0], plain[-1]) if plain else (0, -1)
    return " ".join(t for k, (h, t, _) in enumerate(order) if inside(h) and (ends[0] < k < ends[1] or not menu(h)))


@pytest.mark.parametrize("seed", range(150))
def test_scores_against_brute_force(seed):
    page, root, order = random_page(random.Random(seed))
    assert main_text(page) == brute_text(root, order)


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<p>" + "word, " * 200_000 + "</p>") == ("word, " * 200_000).strip()
    assert main_text("<" * 20_000) == "<" * 20_000


def test_columns_and_empty(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", "old", 5), (1, "u", "<p>a</p>", "old", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, own_0 int")
    got = extract(rows)
    assert got.columns == ["page_id", "url", "text", "own_0", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars, r.own_0 or 0) for r in got.collect()) == [(0, "", 0, 0), (1, "a", 1, 5), (1, "a", 1, 5)]
    assert extract(rows.limit(0)).count() == 0

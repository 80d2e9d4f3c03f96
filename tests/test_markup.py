"""The tag-stack scanner against trees of known text."""

import random

from shelfwise.functions import markup
from shelfwise.operators import parsing

NAMES = ["nick", "info", "date"]


def grow(rng, depth):
    """A random element as ``(tag, class, children)``; children are texts or elements."""
    children = []
    for _ in range(rng.randrange(4) if depth else 1):
        after_text = bool(children) and isinstance(children[-1], str)
        children.append(grow(rng, depth - 1) if depth and (after_text or rng.random() < 0.6) else rng.choice(["a ", " b", " ", "c<d", "e f"]).replace("<", "&lt;"))
    return rng.choice(["div", "span", "p"]), rng.choice(["", "", "x nickname", "info text", "date", "nick info"]), children


def write(node):
    tag, cls, children = node
    attr = f' data-x="1 > 0" class="{cls}"' if cls else ""
    return f"<{tag}{attr}>" + "".join(c if isinstance(c, str) else write(c) + "<br/><img src=x>" for c in children) + f"</{tag}>"


def text(node):
    return "".join(c.strip() if isinstance(c, str) else text(c) for c in node[2])


def first(node, name):
    if name in node[1] and text(node):
        return text(node)
    return next((f for c in node[2] if not isinstance(c, str) for f in [first(c, name)] if f), None)


def test_scanned_texts_equal_the_tree():
    rng = random.Random(4)
    for _ in range(500):
        tree = grow(rng, 5)
        want = {n: f for n in NAMES if (f := first(tree, n))}
        assert markup.scan(write(tree), NAMES) == want


def test_broken_markup_and_long_texts():
    assert markup.scan('<p class=info>a<b>b', ["info"]) == {"info": "ab"}
    assert markup.scan('</div><div class="INFO">a</span>b</div>c', ["info"]) == {"info": "ab"}
    assert markup.scan('<ul><li class="info">a<li>b</ul><p>c', ["info"]) == {"info": "ab"}
    assert markup.scan('<div class="info"><script>if (a < b) x = "</p>"</script><!-- <b> -->a < b</div>', ["info"]) == {"info": "a<b"}
    assert markup.scan("", ["info"]) == {} and markup.scan("<<<", ["info"]) == {}
    deep = 100_000
    assert markup.scan('<div class="info">' * deep + "x" + "</div>" * deep, ["info"]) == {"info": "x"}


def test_cards_with_nested_fields(spark):
    html = '<li><div class="nickname"><span>Li</span><span>**</span></div><div class="info text-ellipsis-2"><span>bad </span> taste <b>and late</b></div><div class="like"><i></i><em>12</em></div></li>'
    rows = [(1, html), (2, None), (3, ""), (4, "<p>no class, but text that is long enough</p>"), (5, "<p>short</p>")]
    got = {r.k: (r.nickname, r.content, r.like_count) for r in parsing.review_cards(spark.createDataFrame(rows, "k int, html string"), "k", "html").collect()}
    assert got == {1: ("Li**", "badtasteand late", "12"), 4: ("", "no class, but text that is long enough", "0")}


def test_layouts_equal_the_scan(monkeypatch):
    rng = random.Random(11)
    layouts = markup.Layouts({"a": ("nick", "date"), "b": ("info",)})
    odd = ["", "<", "a < b", "<!-- <div class=info>x</div> -->", "<script>var a='<i>'</script>", "</div>", "<div class='info'>open ", '<div title="<p>" class=info>t</div>', "<STYLE>x</STYLE>", "<br/>", "<div class=nick> </div>", "<div"]
    for _ in range(400):
        html = "".join(rng.choice([rng.choice(odd), write(grow(rng, 3))]) for _ in range(rng.randrange(1, 5)))
        found = markup.scan(html, layouts.names)
        want = [next((found[n] for n in parts if n in found), "") for parts in layouts.fields.values()]
        assert layouts.texts(html) == want == layouts.texts(html)
    # of a known layout no text is scanned
    monkeypatch.setattr(markup, "scan", None)
    assert [layouts.texts(f'<p class="info">{i} <b>c</b></p>') for i in range(3)] == [["", f"{i}c"] for i in range(3)]

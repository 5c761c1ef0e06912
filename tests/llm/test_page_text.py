import itertools

import numpy as np

from tapline.llm import page_text
from tapline.llm.page_text import BoostedTrees, Node, decode, describe, extract_text, join_blocks, parse, train_pages

HEAD = '<html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li>Alerts</ul></nav>'
TAIL = '<aside class="sidebar"><p>Related alerts and more.</p></aside><form>Name <input><button>Go</button></form><footer>&copy; 2026</footer></body></html>'


def page(i):
    paras = "".join(f"<p>Flow {i} {k} opened, moved data &amp; closed; see <a href='x'>log</a>, please.<br>Next   line." for k in range(3 + i % 4))
    return f'{HEAD}<div class="ad">Buy {i}</div><article><h1>Alert {i} &lt;x&gt;</h1><p><b>Lead {i}.<br>{paras}<div class="comments"><p>reader {i} says hi</div></article>{TAIL}'


def want(i):
    return "\n\n".join([f"Alert {i} <x>", f"Lead {i}."] + [f"Flow {i} {k} opened, moved data & closed; see log, please. Next line." for k in range(3 + i % 4)])


def test_extract(spark):
    rows = [(i, page(i), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "<<<>< a < b", "x"), (103, "<div " * 3000, "x"), (104, "<article>" + "<p>long text, really. " * 30_000, "x"), (3, page(3), "x"), (None, page(4), "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    model = train_pages(pages)
    got = extract_text(pages, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None or r.page_id < 60:
            assert r.text == want(4 if r.page_id is None else r.page_id)
    by = {r.page_id: r for r in got}
    assert by[100].text == by[101].text == "" and by[104].text.count("\n\n") == 29_999
    assert extract_text(pages.limit(0), train_pages(pages.limit(0))).count() == 0


def test_decode_is_best_and_consistent():
    """Against all choices: the best total in which nothing is kept under a dropped node."""
    r = np.random.default_rng(3)
    for _ in range(40):
        nodes = [Node("div", -1, 0)] + [Node("div", int(r.integers(0, i)), 1, text="x" * int(r.integers(0, 9))) for i in range(1, 8)]
        logits = r.normal(0, 2, 8)
        weight = np.array([1 + np.log1p(len(n.text)) for n in nodes])
        keep, drop = -np.logaddexp(0, -logits) * weight, -np.logaddexp(0, logits) * weight
        choices = [c for c in itertools.product([False, True], repeat=8) if all(not c[i] or c[n.parent] for i, n in enumerate(nodes) if i)]
        best = max(choices, key=lambda c: sum(np.where(c, keep, drop)))
        assert tuple(decode(nodes, logits)) == best


def test_trees_learn():
    r = np.random.default_rng(1)
    x = r.random((600, len(page_text.NAMES))).astype(np.float32)
    x[:, page_text.SEMANTIC - 2 : page_text.SEMANTIC] = 0
    y = ((x[:, 0] > 0.5) ^ (x[:, -1] > 0.3)).astype(float)
    m = BoostedTrees.fit(x, y)
    assert ((m.logits(x) > 0) == y).mean() > 0.97


def test_parse():
    nodes = parse("<ul><li>a &amp; b<li>c</ul><p>d<p>e<table><tr><td>f<td>g</table><!-- x --><style>p{}</style>h <textarea>no</textarea>")
    assert [n.text for n in nodes if n.text and not n.hidden] == ["a & b", "c", "d", "e", "f", "g", "h"]
    assert len(describe(nodes)) == len(nodes) and join_blocks(nodes, np.ones(len(nodes), bool)).startswith("a & b\n\nc")


def test_long_attributes():
    """Quoted values end at their quote, however long; a quote that nothing closes is plain."""
    for quote, other in ('"\'', '\'"'):
        value = f"<b>t</b><div class={other}sidebar{other}>" * 2000
        nodes = parse(f"<div data-x={quote}{value}{quote} class=story><p>one</div><p title={quote}x>two")
        assert [n.text for n in nodes if n.text] == ["one", "two"] and nodes[1].tokens == ["story"]
    assert [n.text for n in parse("<p it's>a</p><p>b's</p>") if n.text] == ["a", "b's"]
    assert len(parse('<a x="' * 100_000)) <= 2


def test_names_of_wrappers(spark):
    """A word in the class of body, wrapper or article that holds the page sets nothing in it aside."""
    model = train_pages(spark.createDataFrame([(i, page(i)) for i in range(60)], "page_id long, html string"))
    plain = page(3).replace("<body>", "<body class='single'><div class=wrap>").replace("</body>", "</div></body>")
    pages = [plain.replace("single", "single has-sidebar comments-open"), plain.replace("wrap", "'page-header-fixed more'"), plain.replace("<article>", "<article class='legal meta'>")]
    got = extract_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), model).collect()
    assert [r.text for r in got] == [want(3)] * 3

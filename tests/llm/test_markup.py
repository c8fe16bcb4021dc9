import itertools
import time

import numpy as np
import pytest

from pagelode.llm import markup as mk


def kinds(text):
    _, labels = mk.label_texts([text], mk.trained_model())
    return {mk.KINDS[int(y)] for y in labels[0][1:] if int(y) in mk.KINDS}


def clean(text):
    trees, labels = mk.label_texts([text], mk.trained_model())
    return mk.clean_text(text, trees[0], labels[0])


def test_held_out_pages():
    """Pages of the grammar that were not trained on: surroundings tell what shapes alone do not."""
    model = mk.trained_model()
    right = alone = total = 0
    for text, spans, form in mk.labelled_pages(300, seed=77):
        nodes = mk.read_tree(text)
        truth = mk.label_nodes(nodes, spans, form)[1:]
        _, got = mk.label_texts([text], model)
        single = model.alone(np.array([n[1] for n in nodes]))
        right += sum(int(a) == b for a, b in zip(got[0][1:], truth))
        alone += sum(int(a) == b for a, b in zip(single[1:], truth))
        total += len(truth)
    assert right / total > 0.96 and alone / total < 0.9


#: Pages written by hand, with the kinds they hold; none of their sentences or signs come from the grammar.
PAGES = [
    ("Install it:\n\n```html\n<ul>\n<li><a href='#'>one &amp; two</a></li>\n</ul>\n```\n\nThen reload.", {"markdown"}),
    ("~~~xml\n<note><to>Ann &lt;a@b&gt;</to><p>| x | y |</p></note>\n~~~", {"markdown"}),
    ("```tex\n\\begin{tabular}{ll}\n\\textbf{a} & $x^2$ \\\\\n\\end{tabular}\n```", {"markdown"}),
    ("````md\n```\n## inner\n```\n[[not a link]] {{nor this}}\n````", {"markdown"}),
    ("<article>\n<p>Mix <em>flour</em> &amp; water.</p>\n<pre>\n# bake at 220\n* wait\n- rest\n</pre>\n</article>", {"html"}),
    ("<div><div><pre>a = b[1] | c\n== done ==\n&gt;&gt; 4</pre></div></div>", {"html"}),
    ("|-\n| Oslo || 709\n|-\n| Bergen || 291\n|}", {"wiki"}),
    ("Trees of the north\n\n| tree | age |\n| :-- | --: |\n| yew | 900 |", {"markdown"}),
    ("{| class=\"sortable\"\n! Tree !! Age\n|-\n| Yew || 900\n|}\n'''Yews''' grow slowly.", {"wiki"}),
    ("\\section{Heat}\nBy \\emph{Fourier}, $q = -k T$ where\n\\begin{enumerate}\n\\item $k$ is known\n\\end{enumerate}", {"latex"}),
    ("Dear all,\n\nwe met at 5 & 7 o'clock; 3 < 4 and 9 > 2 hold. Costs: $12, maybe $14!\n\nBye ~ A.", set()),
    ("for i in a[0] do x = y | z; print x * y, {q: 1}", set()),
    ("# Soup\n\n1. Peel\n2. Boil\n\n> Salt *later*\n\nSee [the list](shop.md).", {"markdown"}),
    ("== Soup ==\n{{Recipe|time=20}}\nUse [[salt|some salt]] and ''pepper''.\n[[Category:Soups]]", {"wiki"}),
]


def test_pages_written_by_hand():
    model = mk.trained_model()
    with_messages = [kinds(text) == want for text, want in PAGES]
    alone = []
    for text, want in PAGES:
        labels = model.alone(np.array([n[1] for n in mk.read_tree(text)]))[1:]
        alone.append({mk.KINDS[int(y)] for y in labels if int(y) in mk.KINDS} == want)
    assert all(with_messages), [t for (t, _), ok in zip(PAGES, with_messages) if not ok]
    assert sum(alone) <= len(PAGES) - 4


def test_sum_product_is_exact():
    """Marginals against summing over all labellings of a small tree."""
    model = mk.trained_model()
    parent, shape, depth = np.array([-1, 0, 0, 1]), np.array([0, 3, 5, 7]), np.array([0, 1, 1, 2])
    n = len(mk.LABELS)
    total = np.zeros((4, n))
    for ys in itertools.product(range(n), repeat=4):
        p = model.root[ys[0]] * np.prod([model.shape[y, s] for y, s in zip(ys, shape)]) * model.first[ys[0], ys[1]] * model.first[ys[0], ys[2]] * model.pair[ys[1], ys[3]]
        for i, y in enumerate(ys):
            total[i, y] += p
    assert model.marginals(parent, shape, depth) == pytest.approx(total / total.sum(1, keepdims=True), abs=1e-9)


def shapes(text):
    nodes = mk.read_tree(text)
    return [(mk.SHAPES[s], mk.SHAPES[nodes[p][1]]) for p, s, *_ in nodes[1:]]


def test_elements_hold_what_is_in_them():
    assert shapes("<div><p>a &amp; <b>c</b></p></div><br>") == [
        ("element", "root"), ("element", "element"), ("entity", "element"), ("element", "element"), ("close", "element"), ("close", "element"), ("close", "element"), ("tag", "root"),
    ]
    assert shapes("<p>one<p>two</i>") == [("tag", "root"), ("tag", "root"), ("tag", "root")]
    assert shapes("- a **b**\n**c**") == [("item", "root"), ("strong", "item"), ("strong", "root")]
    assert shapes("| a |\n|---|\nx\n| b |")[:3] == [("lines", "root"), ("row", "lines"), ("divider", "lines")]


@pytest.mark.parametrize("text, want", [
    ("<td>One</td>", {"html"}), ("caf&eacute;", {"html"}), ("x <!-- y --> z", {"html"}), ("x<HR/>y", {"html"}), ("### Top\nlow", {"markdown"}), ("+ x\n+ y", {"markdown"}), ("3. x\n4. y", {"markdown"}),
    ("Top\n---\nlow", {"markdown"}), ("x __y z__ w", {"markdown"}), ("![x](y.svg)", {"markdown"}), ("---\nlang: en\n---\nlow", {"markdown"}), ("thus.[^note]", {"markdown"}), ("[x]: ../y", {"markdown"}),
    ("=== Top ===\nlow", {"wiki"}), ("some ''x'' here", {"wiki"}), ("[[File:x.svg|thumb]]", {"wiki"}), ("{{Stub}}", {"wiki"}), ("__NOGALLERY__\nlow", {"wiki"}), ("#REDIRECT [[x]]", {"wiki"}),
    ("\\chapter{X}", {"latex"}), ("so \\(a+b\\) is", {"latex"}), ("\\[ a \\]", {"latex"}), ("\\begin{center}\nx\n\\end{center}", {"latex"}), ("let $k$ be", {"latex"}),
    ("", set()), (None, set()), (" \n", set()), ("nothing at all", set()), ("7 * 6 = 42", set()), ("x^y", set()), ("a/b\\c", set()), ("one_two_three", set()), ("I <3 it", set()), ("50 % & more", set()),
])
def test_kinds(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("text, want", [
    ("## Head\n\ntext **b** `c`", "Head\n\ntext b c"), ("<ul>\n<li>a</li>\n<li>b &amp; c</li>\n</ul>", "- a\n- b & c"), ("* [x] a\n* [ ] b", "- [x] a\n- [ ] b"),
    ("```sh\n# a <b>\n```\nend", "    # a <b>\nend"), ("It is $x^2$ and \\textbf{bold}\\footnote{n}", "It is $x^2$ and bold (n)"), ("See [[A|the b]] and ''c''", "See the b and c"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "a b\n\n1 2"), ("a < b & c\r\n", "a < b & c\r\n"), ("<div><p>a <em>b</em></p></div>", "a b"), (None, None), ("", ""),
])
def test_clean(text, want):
    assert clean(text) == want


def test_frames(spark):
    rows = [(1, "<b>x</b>", "k"), (2, None, "k"), (3, "", "k"), (4, "**a** " * 20000, "k"), (5, "plain", "k"), (5, "plain", "k")]
    df = spark.createDataFrame(rows, "id long, text string, kind string")
    assert {(r["id"], r["kind"]) for r in mk.markup_kinds(df, "id").collect()} == {(1, "html"), (4, "markdown")}
    got = {r["id"]: r["text"] for r in mk.clean_markup(df, "id").collect()}
    assert got[1] == "x" and got[2] is None and got[3] == "" and got[5] == "plain" and "*" not in got[4]
    assert mk.markup_kinds(df.limit(0), "id").count() == 0


@pytest.mark.parametrize("depth", [4, 6, 60, 1500])
def test_deep_containers_are_read(depth):
    names = [f"box{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(depth)]
    text = "".join(f"\\begin{{{n}}}\n" for n in names) + "\\item deep\n" + "".join(f"\\end{{{n}}}\n" for n in reversed(names))
    at = text.index("\\item")
    assert any(start == at for _, _, _, start, _ in mk.read_tree(text))
    cleaned = clean(text)
    assert "\\item" not in cleaned and "deep" in cleaned


@pytest.mark.parametrize("sign", ["\\[", "\\(", "<pre>", "{|\n", "\\begin{a}", "<div>", "$a", "```\n", "<!--", "[", "*a", "'''a", "| a\n", "$a= "])
def test_time_is_linear_in_what_is_left_open(sign):
    def took(n):
        began = time.perf_counter()
        mk.read_tree(sign * n)
        return time.perf_counter() - began

    took(1_000)
    assert took(20_000) < 3


@pytest.mark.parametrize("start", ["=", "|", "#", "> ", "* ", "a ", "1. ", "`", "<a ", "$a", "[", "{{", "'" * 3, "---"])
def test_long_runs_of_blanks(start):
    began = time.perf_counter()
    clean("**b** " + "\n" + start + " " * 100_000 + "x\n" + start + " " * 100_000)
    assert time.perf_counter() - began < 3

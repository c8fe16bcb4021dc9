"""Markup residue: a tree of what looks like markup, and what of it is (problem 6).

A text is read into a tree: its root, blocks (headings, list items, fences, tables,
environments ...), elements and the marks inside them. Every node has a shape, what it
looks like, and a hidden label, what it is: plain text, one of four kinds of markup, or
code; the root's label is the format of the page. The labels form a tree-structured
graphical model. Each node has a potential of its shape, each parent and child one of
both their labels, so what stands in an element within a fence, or a ``|`` line beside
the lines of a wiki table, is read by what surrounds it. Messages are passed from the
leaves to the root and back (sum-product), for all trees of a batch at once, and give
every node's exact marginals. The potentials are trained by counting on labelled pages,
which ``labelled_pages`` writes by a grammar together with their labels.

Reading takes time in proportion to the text, however deep it is nested and whatever is
left open. Null, empty and wordless texts have no nodes; they come out as they are.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Generator, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("plain", "html", "markdown", "wiki", "latex", "fence", "code", "verbatim")
PLAIN, HTML, MARKDOWN, WIKI, LATEX, FENCE, CODE, VERBATIM = range(8)
#: The kind that a label counts for.
KINDS = {HTML: "html", MARKDOWN: "markdown", WIKI: "wiki", LATEX: "latex", FENCE: "markdown", VERBATIM: "html"}

# The element names of HTML, and LaTeX commands that take no braces.
HTML_NAMES = (
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 "
    "h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav "
    "noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small "
    "source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track "
    "tt u ul var video wbr"
)
BARE_COMMANDS = "item hline par noindent maketitle tableofcontents newpage clearpage centering bigskip medskip smallskip"

_S = r"[^\S\n]"
_ATTR = rf"(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*"
_TAG = rf"</?(?:{HTML_NAMES.replace(' ', '|')})(?![\w-]){_ATTR}\s*/?>"
_ENTITY = r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def _c(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.MULTILINE | re.DOTALL | re.IGNORECASE)


#: (shape, pattern, what ends it or None, whether its content is read) by the first sign; at a line's start first.
#: Without an end a shape is what its pattern matches; an end is looked for in ``ENDS``, and the text's or container's
#: own end stands in for it unless the shape needs it (``NEEDED``).
Rule = tuple[str, re.Pattern[str], str | None, bool]


def _leaf(shape: str, pattern: str | re.Pattern[str]) -> Rule:
    return shape, _c(pattern) if isinstance(pattern, str) else pattern, None, False


LINE: dict[str, list[Rule]] = {
    "`": [("fence", _c(rf"{_S}*(`{{3,}})[^`\n]*\n"), "```", True)],
    "~": [("fence", _c(rf"{_S}*(~{{3,}})[^~\n]*\n"), "~~~", True)],
    "-": [
        _leaf("front", rf"---{_S}*\n((?:[\w-]+:[^\n]*\n)+)---{_S}*$"), _leaf("rule", rf"{_S}*-{{3,}}{_S}*$"), _leaf("item", rf"{_S}*-{_S}+(?=\S)"),
    ],
    "*": [_leaf("rule", rf"{_S}*(?:\*{_S}*){{3,}}$"), _leaf("item", rf"{_S}*\*{_S}+(?=\S)")],
    "+": [_leaf("item", rf"{_S}*\+{_S}+(?=\S)")],
    "_": [_leaf("rule", rf"{_S}*(?:_{_S}*){{3,}}$")],
    "0": [_leaf("numbered", rf"{_S}*\d{{1,3}}[.)]{_S}+(?=\S)")],
    "#": [_leaf("heading", rf"{_S}{{0,3}}#{{1,6}}{_S}+(?=\S)"), _leaf("redirect", r"#redirect\b")],
    ">": [_leaf("quote", rf"{_S}{{0,3}}>{_S}?(?=[^\s=])")],
    "=": [_leaf("underline", rf"={{3,}}{_S}*$"), _leaf("wikihead", r"(={1,6})[^=\n]+\1(?!=)")],
    "|": [
        _leaf("wikirow", rf"\|(?:-{_S}*(?:[a-z][^\n|]*)?$|\}})"), _leaf("divider", rf"\|(?:{_S}*:?-+:?{_S}*\|)+{_S}*$"), _leaf("row", r"\|[^\n]*\|"), _leaf("param", rf"\|(?:\w|{_S})+="),
    ],
    "!": [_leaf("wikirow", rf"!{_S}+[^\n]*?!!")],
    "{": [("wikitable", _c(r"\{\|"), "|}", True)],
    "[": [_leaf("linkdef", r"\[[^\]^\[\n]+\]:\s*\S"), _leaf("notedef", r"\[\^[^\]\s]+\]:")],
}
INLINE: dict[str, list[Rule]] = {
    "<": [
        ("comment", _c(r"<!--"), "-->", False), ("pre", _c(r"<pre\b[^<>]*>"), "</pre", True), _leaf("tag", _TAG), _leaf("less", r"<"),
    ],
    "&": [_leaf("entity", _ENTITY), _leaf("and", r"&")],
    "\\": [
        ("environment", _c(r"\\begin\{([A-Za-z]+\*?)\}"), "\\end", True),
        ("display", _c(r"\\\["), "\\]", False),
        ("formula", _c(r"\\\("), "\\)", False),
        _leaf("command", r"(?<![\w:\\/])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"),
        _leaf("command", rf"(?<![\w:\\/])\\(?:{BARE_COMMANDS.replace(' ', '|')})(?![A-Za-z\\])"),
        _leaf("slash", r"\\"),
    ],
    "$": [
        _leaf("display", r"\$\$[^$]+\$\$"), ("formula", _c(r"(?<![\w\\$])\$(?=[^\s$])"), "$", False), _leaf("dollar", r"\$"),
    ],
    "[": [
        _leaf("wikilink", r"\[\[[^\[\]\n]+\]\]"), _leaf("note", r"\[\^[^\]\s]+\]"), _leaf("link", r"\[[^\[\]\n]*\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"),
        _leaf("link", r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]"), _leaf("bracket", r"\["),
    ],
    "!": [_leaf("link", r"!\[[^\[\]\n]*\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")],
    "{": [_leaf("template", r"\{\{[^{}]+\}\}"), _leaf("brace", r"\{")],
    "`": [_leaf("codespan", r"(`+)(?!`)[^`\n]+\1(?!`)")],
    "*": [
        _leaf("strong", r"\*\*(?=[^\s*])[^*\n]+?(?<=\S)\*\*"), _leaf("emphasis", r"(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])"), _leaf("star", r"\*"),
    ],
    "_": [
        _leaf("switch", re.compile(r"__[A-Z]{2,}__")),  # the one pattern that minds case
        _leaf("strong", r"(?<![\w_])__(?=[^\s_])[^_\n]+?__(?!\w)"), _leaf("emphasis", r"(?<![\w_])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?!\w)"),
    ],
    "~": [_leaf("struck", r"~~(?=[^\s~])[^~\n]+?~~")],
    "'": [_leaf("wikiemph", r"('{2,5})(?=[^\s'])[^'\n]+?\1")],
    "|": [_leaf("bar", r"\|\|")],
}
#: Where what has an end may end.
ENDS = {
    "```": _c(rf"^{_S}*(`{{3,}})[^\n]*$"), "~~~": _c(rf"^{_S}*(~{{3,}})[^\n]*$"), "|}": _c(r"^\|\}"), "-->": _c(r"-->"), "</pre": _c(r"</pre\s*>"),
    "\\end": _c(r"\\end\{([A-Za-z]+\*?)\}"), "\\]": _c(r"\\\]"), "\\)": _c(r"\\\)"), "$": _c(r"\$"),
}
NEEDED = {"\\]", "\\)", "$"}
#: Signs of a formula between dollars; a single letter is one too.
MATH = re.compile(r"[\\^_{}=+<>]|^[A-Za-z]$")
#: What may not follow a formula's second dollar.
GOES_ON = re.compile(r"[\w$]")
#: Besides: an element's first tag and its end tag (others are single tags), and neighbouring lines that begin with a bar.
SHAPES = ["root", *dict.fromkeys(r[0] for table in (LINE, INLINE) for rules in table.values() for r in rules), "element", "close", "lines"]
SHAPE = {s: i for i, s in enumerate(SHAPES)}
#: Shapes that hold whatever follows on their line.
LINE_BLOCKS = {"item", "numbered", "heading", "quote", "linkdef", "notedef"}
#: Shapes of lines that stand together.
BARRED = {"wikirow", "divider", "row", "param"}
BAR_LINES = re.compile(r"(?:[|!][^\n]*(?:\n|\Z))+")

SIGN = re.compile(r"^[^\S\n]*(?:[#>|+*=~`\-_!{\[]|\d{1,3}[.)])|[<&\\$\[{`*_~'!|]", re.MULTILINE)
SOME_SIGN = re.compile(r"[<&\\$\[{`*_~'!|#>+=\-0-9]")
TAG_NAME = re.compile(_TAG, re.IGNORECASE | re.DOTALL)
FENCES = ("```", "~~~")

Node = tuple[int, int, int, int, int]  # parent, shape, depth, start, end


class Reader:
    """Reads one text into its tree. What may end something is found once for the whole text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.nodes: list[Node] = [(-1, 0, 0, 0, len(text))]
        self._ends: dict[tuple[str, str], tuple[list[int], list[int]]] = {}
        self._tags: dict[int, int] | None = None

    def ends_of(self, kind: str, name: str = "") -> tuple[list[int], list[int]]:
        """(starts, ends) of all places that end something of that kind, in order: of an environment of that name, of a fence with so many signs."""
        if (kind, name) not in self._ends:
            if name and (kind, "") not in self._ends:
                self.ends_of(kind)
            if not name:
                found = list(ENDS[kind].finditer(self.text))
                self._ends[kind, ""] = [m.start() for m in found], [m.end() for m in found]
                named: dict[str, list[re.Match[str]]] = {}
                for m in found if kind == "\\end" else ():
                    named.setdefault(m.group(1), []).append(m)
                self._ends |= {(kind, n): ([m.start() for m in own], [m.end() for m in own]) for n, own in named.items()}
            elif kind in FENCES:
                starts, ends = self._ends[kind, ""]
                own = [i for i, a in enumerate(starts) if self.text[a : ends[i]].lstrip().startswith(name)]
                self._ends[kind, name] = [starts[i] for i in own], [ends[i] for i in own]
        return self._ends.get((kind, name), ([], []))

    def elements(self) -> dict[int, int]:
        """Start of an element's first tag -> end of its last, and start of the last -> -1, matched over the whole text."""
        if self._tags is None:
            self._tags = {}
            waiting: list[tuple[str, int]] = []
            opened: Counter[str] = Counter()
            for m in TAG_NAME.finditer(self.text):
                tag = m.group()
                name = re.match(r"</?([A-Za-z0-9]+)", tag).group(1).lower()
                if not tag.startswith("</"):
                    if not tag.endswith("/>"):
                        waiting.append((name, m.start()))
                        opened[name] += 1
                elif opened[name]:
                    while True:
                        last, start = waiting.pop()
                        opened[last] -= 1
                        if last == name:
                            break
                    self._tags[start], self._tags[m.start()] = m.end(), -1
        return self._tags

    def _whole(self, rule: Rule, got: re.Match[str], end: int) -> tuple[str, int, int, int, int] | None:
        """(shape, start, end, start and end of the content that is read) of what begins with a match."""
        shape, _, ending, inside = rule
        start, at = got.span()
        if ending is None:
            return shape, start, at, 0, 0
        starts, stops = self.ends_of(ending, got.group(1) if ending in FENCES or ending == "\\end" else "")
        i = bisect_left(starts, at + 1 if ending in NEEDED else at)
        closed = i < len(starts) and stops[i] <= end
        if ending in NEEDED:
            if not closed or (ending != "\\]" and self.text.find("\n", at, starts[i]) >= 0):
                return None
            if ending == "$":
                content = self.text[at : starts[i]]
                if content[-1].isspace() or not MATH.search(content) or GOES_ON.match(self.text, stops[i]):
                    return None
        stop, after = (starts[i], stops[i]) if closed else (end, end)
        return shape, start, after, *((at, stop) if inside else (0, 0))

    def _found(self, rules: list[Rule], at: int, end: int) -> tuple[str, int, int, int, int] | None:
        for rule in rules:
            got = rule[1].match(self.text, at, end)
            if got is not None and (whole := self._whole(rule, got, end)) is not None:
                return whole
        return None

    def read(self) -> list[Node]:
        """Appends the nodes in document order; open containers wait on a stack, however deep they are."""
        text, nodes = self.text, self.nodes
        waiting: list[tuple[int, int, list[tuple[int, int]]]] = [(0, len(text), [(0, len(text) + 1)])]
        while waiting:
            at, end, above = waiting.pop()
            for m in SIGN.finditer(text, at, end):
                here = m.start()
                if here < at:
                    if m.end() <= at:
                        continue
                    here = at  # the blank part belongs to the node before
                sign = m.group().strip()
                first = sign[0] if sign else ""
                found = None
                block = here == 0 or text[here - 1] == "\n"
                if block:
                    found = self._found(LINE.get("0" if first.isdigit() else first, []), here, end)
                if found is None:
                    if first.isdigit():
                        continue
                    block = False
                    here = max(m.end() - len(sign) if sign else here, at)
                    found = self._found(INLINE.get(text[here], []), here, end)
                if found is None:
                    continue
                shape, start, after, low, high = found
                while above[-1][1] <= start:  # what ended before it holds it no more
                    above.pop()
                whole = self.elements().get(start) if shape == "tag" else None
                if whole is not None and whole <= end:
                    shape = "close" if whole < 0 else "element"
                parent = above[-1][0]
                if block and shape in BARRED and nodes[parent][1] != SHAPE["lines"]:
                    nodes.append((parent, SHAPE["lines"], nodes[parent][2] + 1, start, start))
                    parent = len(nodes) - 1
                    above.append((parent, BAR_LINES.match(text, start, end).end()))
                nodes.append((parent, SHAPE[shape], nodes[parent][2] + 1, start, after))
                me = len(nodes) - 1
                at = max(after, start + 1)
                if shape == "element":
                    above.append((me, whole))
                elif block and shape in LINE_BLOCKS:
                    stop = text.find("\n", after, end)
                    above.append((me, end if stop < 0 else stop))
                if high > low:
                    waiting.append((at, end, above))
                    waiting.append((low, high, [(me, high + 1)]))
                    break
        return nodes


def read_tree(text: str) -> list[Node]:
    """The nodes of a text in document order, the root first. Parents come before their children."""
    return Reader(text).read() if SOME_SIGN.search(text) else [(-1, 0, 0, 0, len(text))]


class TreeModel:
    """Potentials of shapes and of parent and child labels, and exact inference on batches of trees.

    ``pair`` holds between two nodes, ``first`` between the page, whose label is its format, and its nodes.
    """

    def __init__(self, shape: np.ndarray, pair: np.ndarray, first: np.ndarray, root: np.ndarray) -> None:
        self.shape, self.pair, self.first, self.root = shape, pair, first, root

    @classmethod
    def train(cls, trees: list[tuple[list[Node], list[int]]], smooth: float = 0.05) -> TreeModel:
        """Counts of label and shape, of parent and child label and of the pages' formats, smoothed and scaled to probabilities."""
        n = len(LABELS)
        shape = np.full((n, len(SHAPES)), smooth)
        pair, first = np.full((n, n), smooth), np.full((n, n), smooth)
        root = np.zeros(n)
        for nodes, labels in trees:
            root[labels[0]] += 1
            for (parent, s, *_), y in zip(nodes[1:], labels[1:]):
                shape[y, s] += 1
                (pair if parent else first)[labels[parent], y] += 1
        shape /= shape.sum(1, keepdims=True)
        shape[:, 0] = 1.0
        return cls(shape, pair / pair.sum(1, keepdims=True), first / first.sum(1, keepdims=True), root / root.sum())

    def alone(self, shape: np.ndarray) -> np.ndarray:
        """Each node's most probable label by its shape and how common labels are, without its surroundings."""
        return (self.shape * (self.root @ self.first)[:, None]).argmax(0)[shape]

    def marginals(self, parent: np.ndarray, shape: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """(nodes, labels) posterior of every node; ``parent`` indexes the same arrays, -1 for roots."""
        own = self.shape[:, shape].T.copy()
        own[parent < 0] *= self.root
        with np.errstate(divide="ignore"):
            up = np.log(own)
        message = np.zeros_like(own)  # from a node to its parent, in logarithms
        deepest = int(depth.max(initial=0))
        for d in range(deepest, 0, -1):
            at = np.nonzero(depth == d)[0]
            inside = np.exp(up[at] - up[at].max(1, keepdims=True))
            message[at] = np.log(inside @ (self.first if d == 1 else self.pair).T)
            np.add.at(up, parent[at], message[at])
        belief = up.copy()
        for d in range(1, deepest + 1):
            at = np.nonzero(depth == d)[0]
            above = belief[parent[at]] - message[at]
            belief[at] = up[at] + np.log(np.exp(above - above.max(1, keepdims=True)) @ (self.first if d == 1 else self.pair))
        out = np.exp(belief - belief.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


# ---- labelled pages for training

_WORDS = (
    "otter maple granite thunder velvet orbit cinnamon glacier pebble saffron walnut comet harvest ribbon turnip beacon "
    "sparrow marble quartz lagoon tundra cobalt fennel drizzle hammock plank barley mosaic"
).split()


class PageWriter:
    """Writes a page piece by piece and notes which label every piece has."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.parts: list[str] = []
        self.spans: list[tuple[int, int, int]] = []
        self.at = 0

    def put(self, text: str, label: int = PLAIN) -> None:
        if text:
            self.spans.append((self.at, self.at + len(text), label))
            self.parts.append(text)
            self.at += len(text)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def times(self, most: int) -> range:
        return range(int(self.rng.integers(1, most + 1)))

    def word(self) -> str:
        return _WORDS[int(self.rng.integers(len(_WORDS)))]

    def number(self) -> int:
        return int(self.rng.integers(2, 900))

    def symbol(self) -> str:
        """A sign that means itself: sums, orders, amounts, names of files and variables, references."""
        w, v, n = self.word(), self.word(), self.number()
        return self.pick(
            f"{n} < {n + 3}", f"{w} <= {v}", f"{n} & {n}", f"{w} && {v}", f"${n}.50", f"${w.upper()}", f"[{w}]", f"{{{w}}}", f"\\\\{w}\\{v}", f"{w[0].upper()}:\\{v}\\x",
            f"{n} * {n}", f"{w}_{v}", f"<{n}", f"{w} == {v}", f"{w} | {v}", f"{w} || {v}", f"#{n}", f"~{n}", f"{w} -> {v}", f"{n}!", f"{w}'s", f"{w}<{v.capitalize()}2>",
            f"{w[0]}=={n}", f"--{w}={n}", f"/{w}/{v}", f"{n}^{n}", f"*{n}", f"'{w}'", f"{w}[{n}]", f"${n}-${n}", f"{n} > {n}",
            f"{{\"{w}\": {n}}}", f"{{{w}, {v}}}", f"[{n}, {n}]",
        )

    def sentence(self, marks=None) -> None:
        """Plain words, some signs that mean themselves, and some marks of a format."""
        for i in range(int(self.rng.integers(4, 10))):
            self.put(" " if i else "")
            kind = self.rng.random()
            if kind < 0.2:
                self.put(self.symbol())
            elif kind < 0.35 and marks is not None:
                (marks if self.rng.random() < 0.85 else self.pick(self.html_mark, self.markdown_mark, self.latex_mark))()
            else:
                self.put(self.word())
        self.put(".")

    # Marks within a sentence, by format.

    def html_mark(self) -> None:
        name = self.pick("b", "em", "span", "code", "sub", "a", "kbd")
        kind = self.rng.random()
        if kind < 0.2:
            self.put(self.pick("&amp;", "&nbsp;", "&#233;", "&lt;", "&copy;"), HTML)
        elif kind < 0.3:
            self.put(self.pick("<br>", "<br/>", f"<img src=\"{self.word()}.png\">", f"<!-- {self.word()} -->", f"</{name}>", "<p>"), HTML)
        else:
            self.put(f"<{name}{self.pick('', f' class={self.word()}', f' id=\"{self.word()}\"')}>", HTML)
            self.put(self.word())
            self.put(f"</{name}>", HTML)

    def markdown_mark(self) -> None:
        w, v = self.word(), self.word()
        self.put(self.pick(f"**{w}**", f"*{w}*", f"_{w}_", f"__{w} {v}__", f"`{w}_{v}`", f"[{w}]({v}.md)", f"![{w}](/{v}.png)", f"[{w}][{v}]", f"~~{w}~~", f"[^{self.number()}]"), MARKDOWN)

    def wiki_mark(self) -> None:
        w, v = self.word(), self.word()
        self.put(self.pick(f"'''{w}'''", f"''{w}''", f"[[{w}]]", f"[[{w}|{v}]]", f"{{{{{w}}}}}", f"{{{{{w}|{v}}}}}"), WIKI)

    def latex_mark(self) -> None:
        w, n = self.word(), self.number()
        self.put(self.pick(f"\\textit{{{w}}}", f"\\cite{{{w}}}", f"$x_{n}$", f"$a = {n}$", f"\\({w} + {n}\\)", f"\\ref{{{w}}}", "$n$", f"\\footnote{{{w}}}"), LATEX)

    # Blocks, by format.

    def html_block(self) -> None:
        name = self.pick("p", "div", "section", "h2", "blockquote", "ul", "table", "pre")
        self.put(f"<{name}>", VERBATIM if name == "pre" else HTML)
        if name == "pre":
            for _ in self.times(3):
                self.code_line(in_fence=False)
        elif name in ("ul", "table"):
            item = "li" if name == "ul" else "td"
            for _ in self.times(3):
                self.put("\n")
                self.put(f"<{item}>", HTML)
                self.sentence(self.html_mark)
                self.put(self.pick(f"</{item}>", ""), HTML)
        elif name in ("div", "section") and self.rng.random() < 0.5:
            self.html_block()
        else:
            self.sentence(self.html_mark)
        self.put(f"</{name}>", VERBATIM if name == "pre" else HTML)

    def markdown_block(self) -> None:
        w, v, n = self.word(), self.word(), self.number()
        kind = self.pick("heading", "setext", "list", "numbered", "quote", "table", "rule", "front", "fence", "fence", "definition", "sentence", "sentence")
        if kind == "heading":
            self.put(self.pick("# ", "## ", "#### "), MARKDOWN)
            self.sentence()
        elif kind == "setext":
            self.put(f"{w} {v}\n")
            self.put(self.pick("=====", "-----"), MARKDOWN)
        elif kind in ("list", "numbered", "quote"):
            for i in self.times(3):
                self.put("\n" if i else "")
                self.put(f"{i + 1}. " if kind == "numbered" else "> " if kind == "quote" else self.pick("- ", "* ", "+ ", "  - "), MARKDOWN)
                self.sentence(self.markdown_mark)
        elif kind == "table":
            for i, row in enumerate((f"| {w} | {v} |", "| --- | :-: |", f"| {n} | {v} |")):
                self.put("\n" if i else "")
                self.put(row, MARKDOWN)
        elif kind == "rule":
            self.put(self.pick("---", "***", "___"), MARKDOWN)
        elif kind == "front":
            self.put(f"---\n{w}: {v}\n{v}: {n}\n---", MARKDOWN)
        elif kind == "definition":
            self.put(self.pick(f"[{w}]: ../{v}", f"[^{n}]: {v}"), MARKDOWN)
        elif kind == "fence":
            sign = self.pick("```", "```", "~~~", "````")
            self.put(f"{sign}{self.pick('', w)}\n", FENCE)
            for _ in self.times(4):
                if self.rng.random() < 0.3:
                    self.shown()
                else:
                    self.code_line(in_fence=True)
            self.put(sign, FENCE)
        else:
            self.sentence(self.markdown_mark)

    def wiki_block(self) -> None:
        w, v, n = self.word(), self.word(), self.number()
        kind = self.pick("heading", "table", "rows", "template", "switch", "category", "redirect", "sentence", "sentence", "sentence")
        if kind == "heading":
            self.put(self.pick(f"== {w} {v} ==", f"=== {w} ==="), WIKI)
        elif kind in ("table", "rows"):
            if kind == "table":
                self.put(f"{{| class=\"{w}\"\n", WIKI)
                self.put(f"! {w} !! {v}\n", WIKI)
            for _ in self.times(3):
                self.put("|-", WIKI)
                self.put("\n")
                self.put(f"| {self.word()} || {self.number()} || {self.word()}", WIKI)
                self.put("\n")
            self.put("|}", WIKI)
        elif kind == "template":
            self.put(f"{{{{{w}\n| {v} = {n}\n| {w} = {v}\n}}}}", WIKI)
        elif kind == "switch":
            self.put(self.pick("__NOINDEX__", "__FORCETOC__"), WIKI)
        elif kind == "category":
            self.put(f"[[{self.pick('Category', 'File', 'Image')}:{w}]]", WIKI)
        elif kind == "redirect":
            self.put(f"#REDIRECT [[{w}]]", WIKI)
        else:
            self.sentence(self.wiki_mark)

    def latex_block(self) -> None:
        w, n = self.word(), self.number()
        kind = self.pick("section", "list", "equation", "display", "sentence", "sentence")
        if kind == "section":
            self.put(f"\\{self.pick('chapter', 'section', 'subsection*', 'title')}{{{w}}}", LATEX)
        elif kind == "list":
            name = self.pick("itemize", "enumerate", "quote", "center")
            self.put(f"\\begin{{{name}}}\n", LATEX)
            for _ in self.times(3):
                self.put("\\item", LATEX)
                self.put(" ")
                self.sentence(self.latex_mark)
                self.put("\n")
            self.put(f"\\end{{{name}}}", LATEX)
        elif kind == "equation":
            self.put(f"\\begin{{equation}}\n y_{n} = \\frac{{{n}}}{{3}} \\label{{{w}}}\n\\end{{equation}}", LATEX)
        elif kind == "display":
            self.put(self.pick(f"$$ z = {n} $$", f"\\[ {w[0]} > {n} \\]"), LATEX)
        else:
            self.sentence(self.latex_mark)

    def shown(self) -> None:
        """A block of some format that is only shown, so all of it is code."""
        before = len(self.spans)
        self.pick(self.html_block, self.wiki_block, self.latex_block)()
        self.put("\n")
        self.spans[before:] = [(a, b, CODE) for a, b, _ in self.spans[before:]]

    def code_line(self, in_fence: bool) -> None:
        """A line of code: of any language, marked-up ones too, which within a fence are code as well."""
        w, v, n = self.word(), self.word(), self.number()
        if self.rng.random() < 0.35:
            name = self.pick("div", "b", "td", "svg", "p")
            tag = CODE if in_fence else VERBATIM
            for text, label in ((f"<{name}>", tag), (self.pick("&amp;", "&lt;"), tag), (self.symbol(), CODE), (f"</{name}>", tag), ("\n", CODE)):
                self.put(text, label)
            return
        self.put(self.pick(
            f"# {w} {v}", f"- {w}", f"* {v}", f"{w} = {n} * {n}", f"if ({w} < {n}) {{ {v}(); }}", f"{w}[{n}] & {v}", f"$ {w} --{v}", f"echo ${w}", f"| {w} | {v} |",
            f"**{w}**", f"[{w}]({v})", f"\\section{{{w}}}", f"'''{w}'''", f"[[{w}]]", f"> {w}", f"{{{{{w}}}}}", f"== {w} ==", f"\\begin{{{w}}}", f"`{w}`", f"1. {w}",
        ) + "\n", CODE)


def labelled_pages(count: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]], int]]:
    """(text, [(start, end, label)], format) of pages written by the grammar.

    A page is of one format with some plain text and some of another, or it is plain text with
    pieces of any, as where pages were pasted together.
    """
    rng = np.random.default_rng(seed)
    for _ in range(count):
        page = PageWriter(rng)
        blocks = {HTML: page.html_block, MARKDOWN: page.markdown_block, WIKI: page.wiki_block, LATEX: page.latex_block, PLAIN: page.sentence}
        form = page.pick(PLAIN, PLAIN, PLAIN, HTML, MARKDOWN, WIKI, LATEX)
        for _ in page.times(8):
            other = rng.random() < (0.6 if form == PLAIN else 0.15)
            blocks[page.pick(HTML, MARKDOWN, MARKDOWN, WIKI, LATEX) if other else page.pick(form, form, PLAIN)]()
            page.put("\n\n")
        yield "".join(page.parts), page.spans, form


def label_nodes(nodes: list[Node], spans: list[tuple[int, int, int]], form: int) -> list[int]:
    """Each node's label as written: that of the piece in which its first sign stands. The root's is the page's format."""
    starts = [a for a, _, _ in spans]
    return [form] + [spans[bisect_left(starts, start + 1) - 1][2] for _, _, _, start, _ in nodes[1:]]


@lru_cache(maxsize=1)
def trained_model(pages: int = 1_500, seed: int = 1) -> TreeModel:
    """The model, trained once per process on a bounded number of written pages."""
    trees = []
    for text, spans, form in labelled_pages(pages, seed):
        nodes = read_tree(text)
        trees.append((nodes, label_nodes(nodes, spans, form)))
    return TreeModel.train(trees)


def label_texts(texts: list[str | None], model: TreeModel) -> tuple[list[list[Node]], list[np.ndarray]]:
    """Trees and most probable labels of a batch of texts."""
    trees = [read_tree(t.replace("\r\n", "\n").replace("\r", "\n")) if t else [(-1, 0, 0, 0, 0)] for t in texts]
    sizes = np.array([len(t) for t in trees])
    flat = np.array([n[:3] for t in trees for n in t], dtype=np.int64).reshape(-1, 3)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    parent = np.where(flat[:, 0] < 0, -1, flat[:, 0] + first)
    best = model.marginals(parent, flat[:, 1], flat[:, 2]).argmax(1)
    return trees, np.split(best, np.cumsum(sizes)[:-1])


def markup_kinds(records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind): one row per record and kind of markup in its text. A narrow plan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained_model()
        for batch in batches:
            _, labels = label_texts(batch.column(1).to_pylist(), model)
            at, kinds = [], []
            for i, own in enumerate(labels):
                for kind in sorted({KINDS[y] for y in own[1:].tolist() if y in KINDS}):
                    at.append(i)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string())], names=["key", "kind"])

    kind_type = records.schema[key].dataType.simpleString()
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind_type}, kind string").select(F.col("key").alias(key), "kind")


# ---- clean text

_LEAD = re.compile(r"^[^\S\n]*(?:[-*+]|\d{1,3}[.)])[^\S\n]+(?:\[[ xX]\][^\S\n]+)?")
_BLOCK_TAG = re.compile(r"</?(?:p|div|br|tr|table|ul|ol|h[1-6]|pre|blockquote|section|article)\b", re.IGNORECASE)


def _cell_text(raw: str) -> str:
    return " ".join(c.strip() for c in re.split(r"\|\||!!|\|", raw.strip().strip("|!")) if c.strip())


def _clean_node(shape: str, raw: str, inner: str) -> str:
    """What a markup node leaves behind. ``inner`` is its already cleaned content."""
    match shape:
        case "fence":
            body = raw.split("\n")[1:]
            if body and re.match(r"^\s*(`{3,}|~{3,})", body[-1]):
                tail = body.pop().strip().lstrip("`~").strip()
                return "\n".join("    " + x for x in body) + (f"\n{tail}" if tail else "")
            return "\n".join("    " + x for x in body)
        case "front" | "comment" | "rule" | "underline" | "switch" | "note" | "wikirow" | "redirect" | "lines" | "divider":
            return ""
        case "item":
            return " " * (len(raw) - len(raw.lstrip())) + "- "
        case "numbered":
            return raw
        case "heading" | "quote" | "notedef":
            return ""
        case "linkdef":
            return ""
        case "row":
            return _cell_text(raw)
        case "param":
            return raw.lstrip("| ")
        case "tag" | "element" | "close":
            name = re.match(r"</?([A-Za-z0-9]+)", raw)
            lower = name.group(1).lower() if name else ""
            if lower == "li":
                return "" if raw.startswith("</") else "- "
            if lower in ("td", "th"):
                return " "
            return "\n" if _BLOCK_TAG.match(raw) and lower != "tr" else ""
        case "pre":
            return "\n".join("    " + x for x in html.unescape(re.sub(r"<[^<>]*>", "", raw)).split("\n"))
        case "entity":
            return html.unescape(raw)
        case "environment":
            name = re.match(r"\\begin\{([A-Za-z]+)", raw)
            if name and name.group(1) in ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math"):
                return raw
            return inner
        case "display" | "formula":
            return raw
        case "command":
            return "- " if raw == "\\item" else "" if raw.endswith("{") else ""
        case "link":
            m = re.match(r"!?\[([^\]]*)\]", raw)
            return m.group(1) if m else raw
        case "wikilink":
            body = raw[2:-2]
            if body.lower().startswith(("category:", "kategorie:")):
                return ""
            return body.split("|")[-1]
        case "template":
            parts = raw[2:-2].split("|")[1:]
            return " ".join(p.split("=", 1)[-1].strip() for p in parts if "=" not in p)
        case "wikihead":
            return raw.strip().strip("=").strip()
        case "wikitable":
            rows = [_cell_text(x) for x in raw.split("\n")[1:] if not x.startswith(("|-", "|}"))]
            return "\n".join(r for r in rows if r)
        case "codespan":
            return raw.strip("`")
        case "strong" | "emphasis" | "struck":
            return raw.strip("*_~")
        case "wikiemph":
            return raw.strip("'")
        case "bar":
            return " "
    return raw


def clean_text(text: str | None, nodes: list[Node], labels: np.ndarray) -> str | None:
    """The text without its markup. Texts without any are returned as they are, line ends included."""
    if not text or not any(int(y) in KINDS for y in labels[1:]):
        return text
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    children: dict[int, list[int]] = {}
    for i, n in enumerate(nodes[1:], 1):
        at = n[0]
        # Marks on a block's line lie beside the block's own sign, not inside it.
        while at > 0 and nodes[at][4] <= n[3]:
            at = nodes[at][0]
        children.setdefault(at, []).append(i)

    def render(i: int, start: int, end: int) -> Generator[tuple[int, int, int], str, str]:
        # Asks for what stands inside an environment instead of calling itself, so no depth is too deep.
        out, at = [], start
        for c in children.get(i, ()):
            _, shape, _, a, b = nodes[c]
            a, b = max(a, start), min(b, end)
            if a < at:
                continue
            out.append(plain[at:a])
            raw = plain[a:b]
            name = SHAPES[shape]
            if int(labels[c]) not in KINDS:
                out.append(raw)
            elif name == "environment":
                opened = re.match(r"\\begin\{[A-Za-z]+\*?\}", raw)
                closed = re.search(r"\\end\{[A-Za-z]+\*?\}$", raw)
                inner = yield c, a + (opened.end() if opened else 0), b - (len(closed.group()) if closed else 0)
                out.append(_clean_node(name, raw, inner))
            elif name == "command" and raw.endswith("{"):
                # The command's argument stays, its closing brace goes.
                close = plain.find("}", b, end)
                keep = plain[b:close] if close >= 0 else plain[b:end]
                word = raw[1:-1].split("[")[0].rstrip("*")
                out.append("" if word in ("ref", "label", "cite", "eqref", "pageref") else keep if word != "footnote" else f" ({keep})")
                b = close + 1 if close >= 0 else end
            else:
                out.append(_clean_node(name, raw, ""))
            at = max(at, b)
        out.append(plain[at:end])
        return "".join(out)

    running, done = [render(0, 0, len(plain))], None
    while running:
        try:
            asked = running[-1].send(done)
        except StopIteration as end_of:
            running.pop()
            done = end_of.value
        else:
            running.append(render(*asked))
            done = None
    done = "\n".join(line.rstrip() for line in done.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", done).strip("\n")


def clean_markup(records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text) of every record: clean text with headings, list items, code and formulas kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained_model()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            trees, labels = label_texts(texts, model)
            clean = [clean_text(t, n, y) for t, n, y in zip(texts, trees, labels)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], names=["key", "text"])

    kind_type = records.schema[key].dataType.simpleString()
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind_type}, text string").select(F.col("key").alias(key), F.col("text").alias(text))

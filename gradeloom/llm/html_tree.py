"""A page as a stream of blocks, and union-free expressions over such streams."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Element names of the HTML standard and words that pages use in class, id and role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
BREAKS = frozenset("br hr img wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
#: Left out with all they hold, wherever they stand.
LEFT_OUT = frozenset(
    "aside button canvas datalist dialog footer form head iframe input label math menu meter nav noscript object optgroup "
    "option progress script search select style svg template textarea title".split()
)
NO_PARAGRAPH = frozenset("b i em strong a span u s small big sub sup code kbd mark q cite abbr time font tt var".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts advertising alert banner breadcrumb breadcrumbs byline comment comments "
    "complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr legal login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted "
    "promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tagcloud toolbar widget".split()
)
#: Left out unless they stand inside an article.
HEADERS = frozenset(["header"])
ARTICLE_WORDS = frozenset("article articlebody entry post story main maincontent content".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
    "thead": {"caption"}, "body": {"head"},
}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+[^>]*)(>|\Z)", re.S
)
NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Levels of nesting that are told apart; text further in belongs to the last of them.
DEPTH = 64
#: Children, after folding, above which a node is taken as any mixture of its kinds of children.
WIDTH = 40

OPTIONAL, REPEATED = 1, 2
TEXT, GROUP = "#", "()"


def names(attributes: str) -> tuple[list[str], bool]:
    """The words of class, id, role and itemprop, and whether the element is hidden."""
    found, hidden = [], False
    for m in NAMES.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif kind not in ("hidden", "aria-hidden"):
            found += [w.lower() for w in WORDS.findall(value)]
    return found, hidden


class Page:
    """The blocks of a page: text slots (path, text, link characters) in page order, and the tree of labels.

    A label is the element and the first words of its names. `!` marks what is
    left out, `^` what says that it is the article.

    Elements that words leave out are numbered; those that turn out to hold the
    article, or most of the text that isn't links, stay in when read again.
    """

    def __init__(self, source: str):
        self.spared: frozenset[int] = frozenset()
        self.begin()
        self.read(source)
        if spared := self.to_spare():
            self.spared = spared
            self.begin()
            self.read(source)

    def begin(self) -> None:
        self.slots: list[tuple[str, str, int]] = []
        self.root: list = ["", 0, []]
        self.nodes: list[list] = [self.root]
        self.tags: list[str] = [""]
        self.paths: list[str] = [""]
        self.left_out: list[bool] = [False]
        self.pieces: list[str] = []
        self.link, self.linked = 0, 0
        # By number, 0 for the page: the number around it, and its own articles, mains and characters outside links.
        self.around, self.own = [0], [[0, 0, 0]]
        self.number: list[int] = [0]
        self.gone: list[bool] = [False]

    def read(self, source: str) -> None:
        at = 0
        while m := TAG.search(source, at):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            if not m[4]:  # cut off inside a tag
                break
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                self.pieces.append(" ")
            else:
                self.open(tag, m[3])
        if at < len(source) and not (m and not m[4]):
            self.text(source[at:])
        self.flush()

    def text(self, raw: str) -> None:
        if self.left_out[-1] and not raw.strip():
            return
        decoded = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(decoded)
        if self.link:
            self.linked += len(decoded)

    def flush(self) -> None:
        block = " ".join("".join(self.pieces).split())
        if block:
            self.slots.append((self.paths[-1], block, self.linked))
            if not self.gone[-1]:
                self.own[self.number[-1]][2] += max(0, len(block) - self.linked)
            children = self.nodes[-1][2]
            if not children or children[-1][0] != TEXT:
                children.append([TEXT, 0, []])
        self.pieces, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in BREAKS:
            self.pieces.append(" ")
        elif tag == "a":
            self.link = 1
        elif tag in BLOCKS or tag in LEFT_OUT or tag not in NO_PARAGRAPH and "=" in attributes and self.boring(attributes):
            if tag in ("input", "meta", "progress", "meter"):
                return
            self.flush()
            self.link = 0
            ends = CLOSES.get(tag, frozenset())
            while len(self.tags) > 1 and (self.tags[-1] == "p" and tag in BLOCKS or self.tags[-1] in ends):
                self.pop()
            found, hidden = names(attributes) if "=" in attributes or "hidden" in attributes else ([], False)
            inside = "^" in self.paths[-1]
            out = hidden or tag in LEFT_OUT or (tag in HEADERS or "header" in found) and not inside
            number, gone = self.number[-1], out or self.gone[-1]
            if not out and tag not in ("html", "body", "article", "main") and not LEFT_OUT_WORDS.isdisjoint(found):
                self.around.append(number)
                self.own.append([0, 0, 0])
                number = len(self.own) - 1
                out = number not in self.spared
            if tag in ("article", "main") and not gone:
                self.own[number][tag == "main"] += 1
            says = tag in ("article", "main") or not out and tag == "div" and not ARTICLE_WORDS.isdisjoint(found)
            label = ".".join([tag, *found[:3]]) + ("!" if out else "^" if says and tag in ("article", "main") else "~" if says else "")
            path = f"{self.paths[-1]}>{label}"
            if len(self.tags) <= DEPTH:
                self.nodes[-1][2].append([label, 0, []])
                self.nodes.append(self.nodes[-1][2][-1])
            else:  # part of the last level, and out of it if left out; marks stay, each once
                marks = says and not out and label[-1] not in self.paths[-1]
                path = path if out and not self.left_out[-1] or marks else self.paths[-1]
                self.nodes.append(self.nodes[-1])
            self.tags.append(tag)
            self.left_out.append(out or self.left_out[-1])
            self.paths.append(path)
            self.number.append(number)
            self.gone.append(gone)

    def to_spare(self) -> frozenset[int]:
        """Numbers of what holds the page's article, or most of its text, while no article stands outside."""
        whole = [list(x) for x in self.own]
        for i in range(len(whole) - 1, 0, -1):
            for k in range(3):
                whole[self.around[i]][k] += whole[i][k]
        articles, _, chars = whole[0]
        spared, outside = {0}, self.own[0][0] + self.own[0][1]
        for i in range(1, len(whole)):
            if outside:
                break
            holds = whole[i][1] or whole[i][0] == articles == 1 or 2 * whole[i][2] > chars
            if self.around[i] in spared and holds:
                spared.add(i)
                outside += self.own[i][0] + self.own[i][1]
        return frozenset(spared - {0})

    def boring(self, attributes: str) -> bool:
        found, hidden = names(attributes)
        return hidden or not LEFT_OUT_WORDS.isdisjoint(found)

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        elif tag in self.tags[1:]:
            self.flush()
            self.link = 0
            while self.pop() != tag:
                pass

    def pop(self) -> str:
        self.flush()
        self.nodes.pop()
        self.paths.pop()
        self.left_out.pop()
        self.number.pop()
        self.gone.pop()
        return self.tags.pop()

    def skeleton(self) -> list:
        """The tree with repeated siblings folded, without texts."""
        return folded_tree(self.root)


def folded_tree(root: list) -> list:
    """Folds the children of all nodes, from the leaves up, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node[2])
    for node in reversed(order):
        node[2] = folded(node[2])
    return root


def folded(nodes: list) -> list:
    """Neighbouring nodes, or groups of two or three, of the same labels become one that repeats."""
    for size in (1, 2, 3):
        out: list = []
        i = 0
        while i < len(nodes):
            group = nodes[i : i + size]
            labels = [n[0] for n in group]
            j = i + size
            while len(group) == size and [n[0] for n in nodes[j : j + size]] == labels:
                group = [merged(a, b) for a, b in zip(group, nodes[j : j + size], strict=True)]
                j += size
            if j == i + size or len(set(labels)) < len(labels) and size > 1:
                out.append(nodes[i])
                i += 1
                continue
            if size == 1:
                out.append([group[0][0], group[0][1] | REPEATED, group[0][2]])
            else:
                out.append([GROUP, REPEATED, group])
            i = j
        nodes = out
    if len(nodes) > WIDTH:
        kinds: dict[str, list] = {}
        for n in nodes:
            for x in n[2] if n[0] == GROUP else [n]:
                kinds[x[0]] = merged(kinds[x[0]], x) if x[0] in kinds else x
        nodes = [[GROUP, REPEATED | OPTIONAL, [[x[0], x[1] | OPTIONAL, x[2]] for _, x in sorted(kinds.items())]]]
    return nodes


def merged(a: list, b: list) -> list:
    """The expression that covers two of the same label."""
    return [a[0], a[1] | b[1], a[2] if a[2] == b[2] else aligned(a[2], b[2])]


def aligned(x: list, y: list) -> list:
    """Aligns two sequences by their longest common sequence of labels; what only one has becomes optional."""
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            out.append(merged(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([x[i][0], x[i][1] | OPTIONAL, x[i][2]])
            i += 1
        else:
            out.append([y[j][0], y[j][1] | OPTIONAL, y[j][2]])
            j += 1
    return folded(out)


def expression(node: list) -> str:
    """A wrapper as text: labels, `#` for text slots, and `? + *` behind what may be absent or repeat."""
    inner = " ".join(expression(c) for c in node[2])
    body = TEXT if node[0] == TEXT else f"({inner})" if node[0] == GROUP else f"<{node[0]}>{inner}</>"
    return body + ["", "?", "+", "*"][node[1]]


def slot_paths(node: list, path: str = "") -> Iterator[str]:
    """The paths of a wrapper's text slots."""
    for child in node[2]:
        if child[0] == TEXT:
            yield path
        else:
            yield from slot_paths(child, path if child[0] == GROUP or path.count(">") >= DEPTH - 1 else f"{path}>{child[0]}")

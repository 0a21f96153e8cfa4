"""A small tolerant DOM for wrapper induction: parse, drop page furniture, cut into blocks, align two trees."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Element names, attribute words and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset(
    "head script style textarea title noscript template iframe noembed noframes xmp nav footer aside form button select "
    "input svg canvas dialog menu object embed applet audio video map search datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment "
    "comments disqus respond reply replies widget toolbar pagination pager skip".split()
)
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
#: Elements that a start tag closes when they are still open.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
#: Where the search for an element to close ends.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"},
         "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Deeper elements become children of the element at this depth; nothing is lost.
MAX_DEPTH = 200

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|</>|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?/][^a-zA-Z>][^>]*+>|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<text>[^<]++|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HOLDS_MAIN = ("article", "main")


class Node:
    """An element; children are Nodes and strings in page order. `label` is what alignment compares."""

    __slots__ = ("tag", "label", "children", "attributes", "holds_main")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes = tag, attributes
        self.label = f"{tag}.{attributes['class']}" if attributes.get("class") else tag
        self.children: list[Node | str] = []
        self.holds_main = False


def _attributes(rest: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return found


def _in_p(stack: list[Node]) -> int | None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == "p":
            return i
        if stack[i].tag in ("button", "table", "td", "th", "caption", "object"):
            return None
    return None


def _to_close(stack: list[Node], tag: str) -> int | None:
    if tag in CLOSED_BY:
        lowest = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in FENCE[tag]:
                break
            if stack[i].tag in CLOSED_BY[tag]:
                lowest = i
        return lowest
    return _in_p(stack) if tag in BLOCK else None


def parse(text: str) -> Node:
    """The tree of a page. Text is kept as written between tags, with character references decoded."""
    root = Node("#page", {})
    stack = [root]
    at, size, last, lower = 0, len(text), text.rfind(">"), None
    match = _TOKEN.match
    while at < size:
        if at > last:  # no tag can end: the rest is text
            stack[-1].children.append(html.unescape(text[at:]))
            break
        token = match(text, at)
        at = token.end()
        plain = token["text"]
        if plain is not None:
            stack[-1].children.append(html.unescape(plain) if "&" in plain else plain)
            continue
        if token["data"] is not None:
            stack[-1].children.append(token["data"])
            continue
        if token["name"] is None:
            continue
        name = token["name"].lower()
        if token["close"]:
            _close(stack, name)
            continue
        rest = token["rest"]
        if (low := _to_close(stack, name)) is not None:
            del stack[low:]
        node = Node(name, _attributes(rest) if rest and not rest.isspace() else {})
        stack[-1].children.append(node)
        if name in _HOLDS_MAIN:
            for above in stack:
                above.holds_main = True
        if name in RAW:
            if lower is None:
                lower = text.lower()
            end = lower.find(f"</{name}", at)
            at = size if end < 0 else end
            if end >= 0:
                gt = text.find(">", end)
                at = size if gt < 0 else gt + 1
        elif name not in VOID and not rest.endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def _close(stack: list[Node], name: str) -> None:
    """Pop up to the open element of that name; the end of an inline element does not close a block."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            del stack[i:]
            return
        if name not in BLOCK and stack[i].tag in BLOCK:
            return


def is_furniture(node: Node, in_article: bool) -> bool:
    """Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments, and what is hidden."""
    if node.tag in FURNITURE:
        return True
    if node.tag == "header" and not in_article:
        return not node.holds_main
    a = node.attributes
    if not a or node.holds_main or node.tag in ("html", "body", "article", "main"):
        return bool(a) and node.tag == "article" and in_article and _named(a)
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")) or a.get("role", "") in FURNITURE_ROLES:
        return True
    return _named(a) or (not in_article and "header" in _words(a))


def _words(a: dict[str, str]) -> set[str]:
    return {w.lower() for w in _WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")}


def _named(a: dict[str, str]) -> bool:
    return not FURNITURE_WORDS.isdisjoint(_words(a))


def pruned(node: Node, in_article: bool = False) -> Node:
    """The tree without furniture. Of a header inside an article the headings stay."""
    out = Node(node.tag, node.attributes)
    inside = in_article or node.tag in ("article", "main")
    in_header = in_article and node.tag == "header"
    for child in node.children:
        if isinstance(child, str):
            if not in_header:
                out.children.append(child)
        elif not (in_header and child.tag not in HEADINGS and child.tag != "div") and not is_furniture(child, inside):
            out.children.append(pruned(child, inside))
    return out


def main_parts(tree: Node) -> list[Node]:
    """The outermost main elements and articles that have text, where the page has a main with text; else the body."""
    found: dict[str, list[Node]] = {"main": [], "article": [], "body": []}

    def look(node: Node, inside: bool, in_body: bool) -> None:
        if node.tag in ("main", "article") and not inside:
            found[node.tag].append(node)
            order.append(node)
            inside = True
        if node.tag == "body" and not in_body:
            found["body"].append(node)
            in_body = True
        for child in node.children:
            if not isinstance(child, str):
                look(child, inside, in_body)

    order: list[Node] = []
    look(tree, False, False)
    if any(_length(m) for m in found["main"]):
        return [n for n in order if _length(n)]
    return found["body"] or [tree]


def _length(node: Node) -> int:
    return sum(len(c.strip()) if isinstance(c, str) else _length(c) for c in node.children)


def blocks(node: Node) -> Iterator[tuple[Node, str]]:
    """(nearest block element, text with single spaces) in page order; empty blocks are left out."""
    open_: list[str] = []

    def flush(owner: Node) -> Iterator[tuple[Node, str]]:
        text = " ".join("".join(open_).split())
        open_.clear()
        if text:
            yield owner, text

    def walk(n: Node, owner: Node) -> Iterator[tuple[Node, str]]:
        for child in n.children:
            if isinstance(child, str):
                open_.append(child)
            elif child.tag in BLOCK:
                yield from flush(owner)
                yield from walk(child, child)
                yield from flush(child)
            elif child.tag == "br":
                open_.append(" ")
            else:
                yield from walk(child, owner)

    yield from walk(node, node)
    yield from flush(node)


def elements(node: Node) -> Iterator[Node]:
    yield node
    for child in node.children:
        if not isinstance(child, str):
            yield from elements(child)


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest number of node pairs with equal labels that keeps order and ancestry, and the pairs."""
    if a.label != b.label:
        return 0, []
    left = [c for c in a.children if not isinstance(c, str)]
    right = [c for c in b.children if not isinstance(c, str)]
    if not left or not right:
        return 1, [(a, b)]
    weights = [[align(x, y) if x.label == y.label else (0, ()) for y in right] for x in left]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, row in enumerate(weights, 1):
        here, above = best[i], best[i - 1]
        for j, (w, _) in enumerate(row, 1):
            here[j] = max(here[j - 1], above[j], above[j - 1] + w)
    pairs = [(a, b)]
    i, j = len(left), len(right)
    while i and j:
        w, below = weights[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            pairs.extend(below)
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[len(left)][len(right)] + 1, pairs

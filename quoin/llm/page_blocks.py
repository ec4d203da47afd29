"""Leaf blocks of a page's DOM, in page order, each with what is known of its place and its text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Elements that begin and end a block (fixed values of HTML).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements whose text is never read as part of the page.
UNREAD = frozenset("audio button canvas head iframe noembed noframes object script select style svg template textarea title video".split())
#: Start tags that end an open element of these names, inside the nearest of those.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
CELLS = frozenset({"td", "th", "caption", "table", "html"})
TABLE = frozenset({"table", "thead", "tbody", "tfoot", "tr", "td", "th", "body", "html"})
NAMES = ("class", "id", "role", "itemprop")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
#: Elements that say what their contents are for.
ZONES = frozenset("article aside body dialog footer form header main nav table".split())
#: Up to this many words, a block's words are features.
FEW = 12


class Node:
    """An open element; `traits` are those of all elements around it, too."""

    __slots__ = ("tag", "traits", "unread", "main", "block", "around", "zone", "named")

    def __init__(self, tag: str, traits: frozenset, unread: bool, main: bool, block: int, around: int, zone: str = "", named: bool = False):
        self.tag, self.traits, self.unread, self.main, self.block, self.around = tag, traits, unread, main, block, around
        #: The nearest of ZONES around, and whether an element from there on has a name.
        self.zone, self.named = zone, named


class Blocks(HTMLParser):
    """Reads a page; `found` holds (text, features, parent, main) for each leaf block.

    A leaf block is the text between two borders of block elements.  Character references are decoded; white space, with
    <br>, becomes one space.  Elements that HTML closes by itself are closed; end tags without a start tag are passed
    over.  `main` is true below an element with the attribute data-main, which labelled pages carry.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str], int, bool]] = []
        self.stack = [Node("", frozenset(), False, False, 0, 0)]
        self.open: dict[str, int] = {}
        self.blocks, self.headed, self.held = 0, False, False
        self._clear()

    def _clear(self) -> None:
        self.parts: list[str] = []
        self.owner: Node | None = None
        self.inline: set[str] = set()
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            owner = self.owner
            self.found.append((text, self.features(text, owner), owner.around, owner.main))
            self.headed |= owner.tag == "h1"
        self._clear()

    def features(self, text: str, owner: Node) -> list[str]:
        words = text.split()
        n, found = len(words), [f"at:{owner.tag}", *owner.traits, *self.inline]
        found.append(f"words:{min(n.bit_length(), 8)}")
        found.append(f"linked:{round(4 * min(1.0, self.linked / len(text)))}")
        found.append(f"marks:{min(3, sum(text.count(c) for c in ',;'))}")
        found.append("sentence" if text[-1] in ".!?…:\"'”»" and n > 3 else "fragment")
        found.append(f"zone:{owner.zone}")
        if not (owner.named or self.inline):
            found += [f"plain:{owner.zone}", f"plain:{owner.tag} in {owner.zone}"]
        found.append("below heading" if self.headed else "above heading")
        if "©" in text:
            found.append("copyright")
        if n <= FEW:
            found += {f"word:{w.lower()}" for w in WORD.findall(text)}
        return found

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br" and not self.stack[-1].unread:
                self.parts.append(" ")
            return
        if self.open.get("head") and tag not in HEAD:
            self._close("head", frozenset())
        if tag in BLOCKS:
            self.flush()
            if self.open.get("p"):
                self._close("p", CELLS)
            if tag in ENDS:
                names, within = ENDS[tag]
                for name in names:
                    if self.open.get(name):
                        self._close(name, within)
            if tag[0] == "h" and tag[1:].isdigit() and self.stack[-1].tag[:1] == "h" and self.stack[-1].tag[1:].isdigit():
                self._pop()
        above = self.stack[-1]
        traits = {f"is:{t.lower()}" for name, value in attrs if name in NAMES and value for t in TOKEN.findall(value)}
        unread = above.unread or tag in UNREAD
        main = above.main or any(name == "data-main" for name, _ in attrs)
        if tag in BLOCKS:
            self.blocks += 1
            self.held |= tag in ("article", "main") and not unread
            zone, named = (tag, False) if tag in ZONES else (above.zone, above.named)
            node = Node(tag, above.traits | traits | {f"in:{tag}"}, unread, main, self.blocks, above.block, zone, named or bool(traits))
        else:
            node = Node(tag, above.traits, unread, main, above.block, above.around, above.zone, above.named)
            if not unread:
                self.inline |= {f"has:{t[3:]}" for t in traits}
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
        if not self.open.get(tag):
            if tag == "p":  # an empty paragraph
                self.flush()
            return
        if tag in BLOCKS:
            self.flush()
            self._close(tag, frozenset({"table"}) if tag in TABLE and tag != "table" else frozenset() if tag in TABLE else CELLS)
        else:
            self._close(tag, BLOCKS)

    def handle_data(self, data):
        top = self.stack[-1]
        if top.unread:
            return
        if self.owner is None and not data.isspace():
            at = len(self.stack) - 1
            while at > 0 and self.stack[at].tag not in BLOCKS:
                at -= 1
            self.owner = self.stack[at]
        self.parts.append(data)
        if self.open.get("a"):
            self.linked += len(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def _close(self, tag: str, borders: frozenset) -> None:
        """Close the innermost open `tag` and all within, unless a border is in between."""
        for at in range(len(self.stack) - 1, 0, -1):
            name = self.stack[at].tag
            if name == tag:
                while len(self.stack) > at:
                    self._pop()
                return
            if name in borders:
                return


def blocks(html: str | None) -> list[tuple[str, list[str], bool, bool]]:
    """(text, features, whether its parent is that of the block before, main) of all leaf blocks; none for null."""
    if not html:
        return []
    reader = Blocks()
    reader.feed(html)
    reader.close()
    reader.flush()
    out, before = [], None
    for text, features, parent, main in reader.found:
        inside = "in:article" in features or "in:main" in features
        features.append("inside" if inside else "outside" if reader.held else "no article")
        out.append((text, features, parent == before, main))
        before = parent
    return out

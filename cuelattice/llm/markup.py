"""Reading HTML as a sequence of tags and texts, in one pass and without ever failing."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Element names by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = BLOCK - frozenset("body caption head html option optgroup select tbody td tfoot th thead title tr".split())
#: What an opened element ends, up to the nearest of the elements that hold it.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag's inside; of equal names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", raw text), ("open", name, attributes) and ("close", name, "") in the page's order.

    Comments, declarations, what scripts and other raw elements hold, and a tag that the page's end cuts
    off give nothing. Character references are not decoded.
    """
    at, size = 0, len(html)
    text = 0
    while (at := html.find("<", at)) >= 0:
        after = html[at + 1 : at + 2]
        if after == "!" or after == "?":
            if text < at:
                yield "text", "", html[text:at]
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = text = size if end < 0 else end + 3
            else:
                end = html.find(">", at)
                at = text = size if end < 0 else end + 1
            continue
        closing = after == "/"
        first = html[at + 2 : at + 3] if closing else after
        if not ("a" <= first.lower() <= "z"):
            if at + 1 == size or closing and at + 2 == size:
                break  # the page ends in a tag
            at += 1
            continue
        if text < at:
            yield "text", "", html[text:at]
        if m := _TAG.match(html, at):
            name, inside, end = m[1].lower(), m[2], m.end()
        else:  # a quote that never closes, or the page's end
            end = html.find(">", at) + 1
            if not end:
                return
            name, _, inside = html[at + 1 + closing : end - 1].partition(" ")
            name = name.lower()
        at = text = end
        if closing:
            yield "close", name, ""
            continue
        yield "open", name, inside
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?![a-zA-Z0-9])", re.IGNORECASE).search(html, at)
            at = text = close.start() if close else size
    if text < size:
        tail = html[text:]
        # the page's end may cut a tag off behind its first character
        yield "text", "", re.sub(r"</?$", "", tail)


class Stack:
    """The open elements: name and whatever stands for each."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.values: list = []

    def opened(self, name: str) -> None:
        """Ends what the element about to be opened ends by being opened."""
        if name in _CLOSES_P:
            self._end({"p"}, {"body", "div", "article", "section", "main", "td", "th", "li", "blockquote", "aside", "button", "table", "form", "figure"})
        if name in _ENDS:
            self._end(*_ENDS[name])

    def _end(self, ended: set[str], up_to: set[str]) -> None:
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in up_to:
                return
            if self.names[i] in ended:
                self.cut(i)
                if len(ended) == 1:
                    return

    def push(self, name: str, value) -> None:
        self.names.append(name)
        self.values.append(value)

    def closed(self, name: str) -> bool:
        """Ends the innermost element of that name; one inside a line doesn't reach beyond its block."""
        inline = name not in BLOCK
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] == name:
                self.cut(i)
                return True
            if inline and self.names[i] in BLOCK:
                return False
        return False

    def cut(self, i: int) -> None:
        del self.names[i:], self.values[i:]

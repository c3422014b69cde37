"""Main texts of pages by the consensus of their hosts.

Each page's containers are scored by the text that stands in them outside menus, adverts and the like,
less its links. A container is known by its path: the tags and generalised classes from the body down. The
pages of a host vote on paths with their scores; the path that wins is where the main text of all pages
of the host is then taken from. Pages on which the winning path does not occur use their own best one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, small
from .markup import BLOCK, VOID, Stack, attributes, tokens

#: Elements that hold no main text.
OUT_TAGS = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select option textarea dialog menu head title audio video map search".split())
#: Roles that hold none.
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Parts of a class or id that stand for no main text as the whole name, behind other parts, or before parts of FRAME only.
OUT_PARTS = frozenset("ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comments disqus gdpr login masthead nav navbar navigation newsletter pager pagination popup sidebar signup skip sponsored tagcloud toolbar widget widgets".split())
#: Parts that name a place or a frame and say nothing of what is in it.
FRAME = frozenset("area bar block body bottom box button buttons center col column container content desktop footer form frame group head header holder inner item items label large left link links list main menu mobile module outer panel primary right row secondary section slot small space text title to top unit wide wrap wrapper zone".split())
#: Parts before which a name goes on to speak of something: what stands behind them names no frame.
_OF = frozenset("a about against and for from how in of on or the to versus vs with".split())
#: Names of lists of readers' answers, on elements that hold others.
REPLIES = frozenset("replies reply".split())
#: Elements of running text: their names say what they tell unless the whole name is one of a frame.
_TELLING = frozenset("p blockquote pre q cite em strong b i h1 h2 h3 h4 h5 h6 dd dt td".split())
#: Names that do so as a whole.
OUT_NAMES = frozenset("alert banner comment complementary consent contentinfo cookie cookies copyright footer hidden menu menus modal notice notices overlay promo promotion recommended related respond search share sharing social sponsor subscribe subscription topbar".split())
#: Pairs of neighbouring parts that do so.
OUT_PAIRS = frozenset({(a, b) for a in ("cookie", "consent", "privacy") for b in ("banner", "bar", "box", "consent", "notice", "message", "popup")} | {("comment", b) for b in ("area", "body", "box", "container", "content", "form", "item", "list", "section", "text", "thread", "wrapper")} | {(a, "comment") for a in ("reader", "user")} | {("site", "footer"), ("page", "footer"), ("social", "share"), ("share", "buttons"), ("site", "menu"), ("main", "menu")})
#: Parts that stand for no main text where most of what is held is links.
LINK_PARTS = frozenset("footer links menu menus more pagination promo reactions recommended related replies search share sharing social tags".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("article blockquote body center dd details div fieldset figure li main ol section table tbody td tr ul".split())
_MAIN = frozenset("article main".split())
_WORD = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """The url's host, lower-cased and without www."""
    m = _HOST.match(url or "")
    return m[1].lower().removeprefix("www.") if m else ""


def _framed(parts: list[str], telling: bool) -> bool:
    """Whether a name holds a part of OUT_PARTS as what it stands for: alone or before parts of FRAME, and not behind words that make it a subject."""
    for k, part in enumerate(parts):
        if part in OUT_PARTS and all(p in FRAME or p in OUT_PARTS for p in parts[k + 1 :]):
            before = parts[:k]
            return not before or not telling and not _OF & set(before)
    return False


def _verdict(names: list[str], tag: str = "div") -> str:
    """"out" where a class or id stands for no main text, "links" where it does if it holds mostly links, else nothing."""
    found, telling = "", tag in _TELLING
    for name in names:
        if re.match(r"(has|with|no|without|is)[-_]", name):
            continue
        parts = [w.lower() for w in _WORD.findall(name)]
        if len(parts) == 1 and (parts[0] in OUT_NAMES or parts[0] in REPLIES and not telling) or _framed(parts, telling) or any(p in OUT_PAIRS for p in zip(parts, parts[1:], strict=False)):
            return "out"
        if LINK_PARTS & set(parts):
            found = "links"
    return found


class Container:
    """An element that can hold the main text."""

    __slots__ = ("path", "parent", "main")

    def __init__(self, path: str, parent: Container | None, main: bool):
        self.path, self.parent, self.main = path, parent, main


class Doubtful:
    """An element that is left out if most of its text is links."""

    __slots__ = ("parent", "chars", "linked")

    def __init__(self, parent: Doubtful | None):
        self.parent, self.chars, self.linked = parent, 0, 0

    def out(self) -> bool:
        return 2 * self.linked > self.chars or self.parent is not None and self.parent.out()


class _Open:
    """What holds inside an open element."""

    __slots__ = ("container", "out", "soft", "link", "heading", "doubtful", "title")

    def __init__(self, container, out=False, soft=False, link=False, heading=False, doubtful=None, title=False):
        self.container, self.out, self.soft, self.link, self.heading, self.doubtful, self.title = container, out, soft, link, heading, doubtful, title


def _inside(up: _Open, name: str, text: str) -> _Open:
    if up.out:
        return up
    a = attributes(text) if text.strip() else {}
    out, soft, doubtful = name in OUT_TAGS, up.soft, up.doubtful
    names = [*a.get("class", "").split(), *a.get("id", "").split()]
    words = {w.lower() for n in names for w in _WORD.findall(n)}
    if name not in ("html", "body"):
        said = _verdict(names, name)
        out = out or said == "out" or a.get("role", "") in OUT_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "")))
        if said == "links":
            doubtful = Doubtful(doubtful)
        if name == "header" or "header" in words and name not in _HEADINGS and name not in _MAIN:
            # a header of the article keeps its headings, one of the page nothing
            article = up.container
            while article is not None and not article.main:
                article = article.parent
            out, soft = out or article is None, True
    container = up.container
    if name in _CONTAINERS and not out:
        classes = ".".join(sorted({re.sub(r"\d+", "#", c) for c in a.get("class", "").split()}))
        step = f"{name}.{classes}" if classes else name
        main = name in _MAIN or a.get("role") == "main" or a.get("itemprop") == "articleBody"
        container = Container(f"{container.path}/{step}" if container else step, container, main)
    return _Open(container, out, soft, up.link or name == "a", up.heading or name in _HEADINGS, doubtful, up.title or name == "h1")


Block = tuple[str, Container, int, bool]


def blocks(html: str) -> list[Block]:
    """(text, innermost container, characters in links, whether it is a heading of the first kind) of each block of text that may be part of the main text."""
    found = []
    for line, container, linked, title, doubtful in _all_blocks(html):
        found.append((line, container, linked, title, doubtful))
        while doubtful is not None:
            doubtful.chars, doubtful.linked, doubtful = doubtful.chars + len(line), doubtful.linked + linked, doubtful.parent
    return [b[:4] for b in found if b[4] is None or not b[4].out()]


def _all_blocks(html: str) -> Iterator[tuple[str, Container, int, bool, Doubtful | None]]:
    stack, root = Stack(), Container("", None, False)
    base = _Open(root)
    parts: list[str] = []
    holder, linked, title, doubtful = root, 0, False, None

    def flush():
        nonlocal parts, linked
        line = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        found = (line, holder, min(linked, len(line)), title, doubtful)
        parts, linked = [], 0
        return found

    for kind, name, text in tokens(html):
        if kind == "text":
            now = stack.values[-1] if stack.values else base
            if now.out or now.soft and not now.heading:
                continue
            if not parts:
                holder, doubtful, title = now.container, now.doubtful, now.title
            parts.append(text)
            if now.link:
                linked += len(text)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK and parts:
            found = flush()
            if found[0]:
                yield found
        if kind == "close":
            stack.closed(name)
        else:
            stack.opened(name)
            if name not in VOID:
                stack.push(name, _inside(stack.values[-1] if stack.values else base, name, text))
    found = flush()
    if found[0]:
        yield found


def _of(container: Container, path: str) -> bool:
    while container is not None:
        if container.path == path:
            return True
        container = container.parent
    return False


def scores(found: list[Block]) -> dict[str, float]:
    """The score of each path: text outside links, half of it for the next container outwards, and so on.

    What stands in an article or main element counts for the outermost such element.
    """
    total: dict[str, float] = {}
    for line, container, linked, _ in found:
        share = float(max(0, len(line) - 2 * linked))
        main, c = None, container
        while c is not None:
            main, c = (c if c.main else main), c.parent
        c = main or container
        while c is not None and share >= 1:
            total[c.path] = total.get(c.path, 0.0) + share
            c, share = c.parent, share / 2
    return total


def best(total: dict[str, float]) -> str | None:
    return min(total, key=lambda p: (-total[p], p)) if total else None


_SENTENCE = re.compile(r"[.!?…。！？؟][\"'”’»)\]]*$")


def _tells(line: str, linked: int) -> bool:
    return 3 * linked < len(line) and len(line) >= 40 and bool(_SENTENCE.search(line))


def lifted(found: list[Block], path: str) -> str:
    """The path, or one further out, as long as the step outwards gains more text in sentences than links and scraps.

    A block in sentences has 40 characters or more and ends like one.
    """
    while True:
        up = {at.parent.path for _, c, *_ in found if (at := _within(c, path)) is not None and at.parent is not None}
        if len(up) != 1 or not (outer := up.pop()):
            return path
        told = scraps = 0
        for line, c, linked, _ in found:
            if _of(c, outer) and not _of(c, path):
                if _tells(line, linked):
                    told += len(line) - linked
                else:
                    scraps += linked + (0 if linked else len(line) // 4)
        if told <= scraps:
            return path
        path = outer


def _within(container: Container, path: str) -> Container | None:
    while container is not None and container.path != path:
        container = container.parent
    return container


def own_path(found: list[Block]) -> str | None:
    """The page's own best path."""
    path = best(scores(found))
    return lifted(found, path) if path is not None else None


def _title(found: list[Block], path: str | None) -> list[str]:
    """The page's one heading of the first kind, where it stands before the path's text in an element around it; none if that is marked as the article."""
    titles = [k for k, b in enumerate(found) if b[3]]
    first = next((k for k, b in enumerate(found) if path is not None and _of(b[1], path)), None)
    if len(titles) != 1 or first is None or titles[0] >= first:
        return []
    line, container, linked, _ = found[titles[0]]
    inner = found[first][1]
    while inner is not None and not inner.main:
        inner = inner.parent
    around = path == container.path or path.startswith(f"{container.path}/")
    return [line] if inner is None and around and not linked else []


def main_text(html: str | None, path: str | None) -> tuple[str, str | None]:
    """The page's main text and the path that it was taken from.

    That is the given one, unless it holds nothing, or less than half of the sentences that the page's own best path does.
    """
    if not html:
        return "", None
    found = blocks(html)
    taken = lambda p: [b[0] for b in found if p is not None and _of(b[1], p)]
    given, mine = taken(path), own_path(found)
    told = lambda p: sum(len(b[0]) for b in found if p is not None and _of(b[1], p) and _tells(b[0], b[2]))
    if mine != path and (not given or 2 * told(path) < told(mine)):
        given, path = taken(mine), mine
    return "\n".join([*_title(found, path), *given]), path if given else None


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], float] = {}
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not (html := html.as_py()):
                continue
            found = blocks(html)
            total = scores(found)
            most, mine = max(total.values(), default=0), own_path(found)
            for path in {*total, *([mine] if mine is not None else [])}:
                share = 1 if path == mine else total[path] / most / 2
                if share >= 0.25:
                    key = (host_of(url), path)
                    votes[key] = votes.get(key, 0.0) + round(1000 * share)
        hosts, paths = zip(*votes, strict=True) if votes else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(votes.values()), pa.float64())], names=["host", "path", "votes"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that wins each host's vote. pages has url and html."""
    votes = pages.mapInArrow(_votes, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The html and the host's path come last and are replaced by text and path."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            html, path = part.columns[-2:]
            got = [main_text(h.as_py(), p) for h, p in zip(html, path.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array([t for t, _ in got], pa.string()), pa.array([p for _, p in got], pa.string())], names=[*part.schema.names[:-2], "text", "path"])


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without its html, with host, text and path.

    A null or empty html, and a page without main text, have an empty text and a null path. A null url is
    the host without a name. Rows may repeat; columns named host, text or path are replaced, all others
    stay, whatever their names. Within a block white space becomes one space; blocks are joined by line feeds.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    # the same host as host_of() gives
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST.pattern, 1)), r"^www\.", "")
    winners = scratch.write(host_paths(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))), "paths")
    own = [c for c in pages.columns if c not in ("host", "text", "path", html_col)]
    (html,) = fresh([*own, "host", "path"], "html")
    p = pages.select(*own, host.alias("host"), F.col(html_col).alias(html))
    p = p.join(small(winners, 512), "host", "left").select(*own, "host", html, "path")
    ddl = ", ".join([p.select(*own, "host").schema.toDDL(), "text string, path string"])
    return p.mapInArrow(_extract, ddl)

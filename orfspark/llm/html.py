"""A tolerant reader of HTML: block texts of a page with the elements around them, and hashes of element subtrees."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import xxhash

_NAME = r"[A-Za-z][^\s/>]*+"
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<(?P<close>/?)(?P<name>{_NAME})(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    rf"|<(?P<close2>/?)(?P<name2>{_NAME})(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Element names by role in the HTML standard, and common names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th", "caption"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl dt dd li tr td th tbody thead tfoot figcaption body html article main hgroup".split())
DROPPED = frozenset(
    "head script style title textarea xmp iframe noembed noframes noscript template svg math canvas object audio video nav aside footer form button "
    "select option optgroup input label fieldset legend dialog menu search datalist map".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert status form menu menubar toolbar tablist".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comments comment commentlist respond disqus share sharing "
    "social related recommended recommendations pagination pager login toolbar skip".split()
)
#: Words that say in a class or id name what shape or place a thing has, not what it is about.
LAYOUT = frozenset(
    "area article articles bar block body bottom box boxes btn button buttons center col column container content count counter desktop fixed float "
    "follow grid group head header heading icon icons image img inline inner item items label layout left link links list main media mobile module "
    "outer page pages panel placeholder post posts primary region right row secondary section site slot small sticky stories text title top unit "
    "view wrap wrapper zone".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: What an open element of the key's kind closes when the next one begins, up to the nearest element that bounds it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDS = frozenset("ul ol dl table tbody thead tfoot tr select article section div main body html aside nav header footer form blockquote td th button object".split())
_KEEPS_P = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var br wbr label input".split())


@dataclass
class Element:
    """An element; ``digest`` adds up the hashes of what is in it, so a parent's less a child's is that of the rest."""

    name: str
    parent: int
    dropped: bool
    chars: int = 0
    digest: int = 0
    blocks: list[int] = field(default_factory=list)


@dataclass
class Page:
    elements: list[Element]
    blocks: list[tuple[int, str]]  # innermost element, text
    main: int  # element that holds the article


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _furniture(name: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if name in DROPPED or name == "header" and not inside_article:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if attrs.get("role", "").lower() in DROPPED_ROLES:
        return True
    if name in ("html", "body", "article", "main"):
        return False
    return any(map(_named, (attrs.get("class", "") + " " + attrs.get("id", "")).split()))


def _named(name: str) -> bool:
    """Whether a class or id names furniture and nothing else: "related-posts" does, "related-work" is about some work."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return any(w in FURNITURE for w in words) and all(w in FURNITURE or w in LAYOUT or w.isdigit() for w in words)


def parse(text: str) -> Page:
    """Read a page. End tags without a start are ignored, open elements end with their parents or the page."""
    elements = [Element("", -1, False)]
    stack = [0]
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    holder = -1  # element of the run's first text; -1 while the run is blank
    held: tuple[int, list[str], int] | None = None  # place in the stack of furniture inside a line, and the line up to it

    def flush() -> None:
        nonlocal holder
        if holder >= 0:
            blocks.append((holder, " ".join(entities.unescape("".join(run)).split())))
        run.clear()
        holder = -1

    def leave(i: int) -> None:
        """Close the open elements from the i-th; a line goes on after furniture in it."""
        nonlocal holder, held
        if held and held[0] >= i:
            flush()
            run.extend(held[1])
            run.append(" ")
            holder, held = held[2], None
        del stack[i:]

    def close(names: tuple[str, ...], bounds: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            name = elements[stack[i]].name
            if name in names:
                leave(i)
                flush()
                return
            if name in bounds:
                return

    at = 0
    while True:
        m = _TOKEN.search(text, at)
        piece = text[at : m.start() if m else len(text)]
        if piece:
            if holder < 0 and entities.unescape(piece).strip():
                holder = stack[-1]
            run.append(piece)
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            if name == "br":
                run.append(" ")
                continue
            if name in BLOCKS or name in CELLS:
                flush() if name in BLOCKS else run.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                own = elements[stack[i]].name
                if own == name:
                    ends = any(elements[e].name in BLOCKS for e in stack[i:])
                    leave(i)
                    if ends:
                        flush()
                    break
                if name not in BLOCKS and own in BLOCKS:
                    break
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name not in _KEEPS_P:
                close(("p",), _BOUNDS)
        elif name in CELLS:
            run.append(" ")
        if name in _CLOSES:
            close(_CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select")))
        if re.fullmatch(r"h[1-6]", name):
            close(("h1", "h2", "h3", "h4", "h5", "h6"), _BOUNDS)
        raw = m["attrs"] or m["attrs2"] or ""
        above = elements[stack[-1]]
        if name in VOID:
            continue
        inside = any(elements[e].name in ("article", "main") for e in stack)
        elements.append(Element(name, stack[-1], above.dropped or _furniture(name, _attributes(raw), inside)))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if elements[-1].dropped and not above.dropped and name not in BLOCKS:
            # text before furniture inside a line stays one block with the text after it
            held = len(stack), run.copy(), holder
            run.clear()
            holder = -1
        stack.append(len(elements) - 1)
    leave(1)
    flush()
    return _measured(elements, blocks)


def _measured(elements: list[Element], blocks: list[tuple[int, str]]) -> Page:
    for i, (e, text) in enumerate(blocks):
        digest = xxhash.xxh64_intdigest(text)
        kept = not elements[e].dropped
        while e >= 0:
            own = elements[e]
            own.blocks.append(i)
            own.digest = (own.digest + digest) & 0xFFFFFFFFFFFFFFFF
            own.chars += len(text) if kept else 0
            e = own.parent
    return Page(elements, blocks, _main(elements))


#: An article stands for its main element or page where it holds more than this share of its kept text.
_MOST = 0.75


def _main(elements: list[Element]) -> int:
    """The element that holds the story: an article with most of the text around it, else a main element, else what holds all articles.

    The text around an article is that of the main element if it is inside it, else that of the page. A page with one article
    and no main element has its story there, whatever else it has.
    """
    of = lambda kind: [i for i, e in enumerate(elements) if e.name == kind and not e.dropped and e.chars]
    articles, mains = of("article"), of("main")
    size = lambda i: (elements[i].chars, -i)
    main = max(mains, key=size, default=0)
    if not articles:
        return main
    for around in (main, 0):
        within = [i for i in articles if not around or _has(elements, around, i)]
        best = max(within, key=size, default=0)
        if best and elements[best].chars > _MOST * elements[around].chars:
            return best
    if main:
        return main
    common = articles[0]
    for i in articles[1:]:
        while not _has(elements, common, i):
            common = elements[common].parent
    return common


def _has(elements: list[Element], i: int, inner: int) -> bool:
    """Whether element ``inner`` is element i or in it; elements are numbered as they start."""
    while inner > i:
        inner = elements[inner].parent
    return inner == i


def subtrees(page: Page) -> list[tuple[int, int, int]]:
    """Element number, subtree hash and hash of the rest of the page's article, for elements that a template may be."""
    out = []
    whole = page.elements[page.main]
    inside = _inside(page)
    for i, e in enumerate(page.elements):
        if i == 0 or not e.blocks or e.name not in BLOCKS:
            continue
        rest = (whole.digest - e.digest) & 0xFFFFFFFFFFFFFFFF if inside[i] else whole.digest
        out.append((i, xxhash.xxh64_intdigest(f"{e.name} {len(e.blocks)} {e.digest}"), rest))
    return out


def _inside(page: Page) -> list[bool]:
    inside = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        inside[i] = i == page.main or (e.parent >= 0 and inside[e.parent])
    return inside


#: A subtree counts towards a template only on pages where it holds at most this share of the article.
_SHARE = 0.25


def deletable(page: Page) -> list[bool]:
    """Whether recurrence may delete each element: not the article nor what holds it, and no plain prose of it."""
    around, at = set(), page.main
    while at >= 0:
        around.add(at)
        at = page.elements[at].parent
    # parents come before their children
    whole, marked = page.elements[page.main].name in ("article", "main"), [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        marked[i] = whole or e.name in ("article", "main") or (e.parent >= 0 and marked[e.parent])
    return [i not in around and e.name not in ("html", "body", "article", "main") and not (marked[i] and e.name in PROSE) for i, e in enumerate(page.elements)]


def counted(page: Page) -> list[tuple[int, bool, int]]:
    """Subtree hash, whether it is prose, and hash of the rest of the article, for subtrees that count towards a template.

    A large part of an article does not count, as it may be a copied article with something small beside it.
    """
    may, most = deletable(page), _SHARE * page.elements[page.main].chars
    return [(digest, page.elements[i].name in PROSE, rest) for i, digest, rest in subtrees(page) if may[i] and page.elements[i].chars <= most]


def article(page: Page) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The article's blocks in page order, without furniture; and hash, first and last block (exclusive) of each subtree that
    may be deleted. An element's blocks stand together, as each is read before the element ends."""
    inside, may = _inside(page), deletable(page)
    kept = [k for k, (e, _) in enumerate(page.blocks) if inside[e] and not page.elements[e].dropped]
    number = {k: n for n, k in enumerate(kept)}
    spans = []
    for i, digest, _ in subtrees(page):
        own = [number[k] for k in page.elements[i].blocks if k in number] if may[i] else []
        if own:
            spans.append((digest, own[0], own[-1] + 1))
    return [page.blocks[k][1] for k in kept], spans


def main_text(page: Page, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks, joined by two line feeds, without recurring subtrees; where nothing is left without them, they stay."""
    blocks, spans = article(page)
    gone = {k for digest, low, high in spans if digest in templates for k in range(low, high)}
    return "\n\n".join([text for k, text in enumerate(blocks) if k not in gone] or blocks)

"""Plain-Python kernels of HTML extraction: blocks of a page, common subsequences of lines."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import xxhash

_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the set, looked for up to an element of the second set.
_SCOPES = set("noscript template svg math select object canvas audio video datalist div article section main body td th blockquote form aside nav table figure header footer dialog details button ul ol dl".split())
_ENDS = {
    **{t: ({"p"}, _SCOPES) for t in _BLOCK - set("body caption dd dt head html legend li optgroup option summary tbody td tfoot th thead tr".split())},
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose text is never the article's.
_SKIP = set("head script style noscript template nav footer aside form button select option textarea title iframe svg math object canvas dialog menu datalist audio video map xmp noembed noframes".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promoted sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share sharing social comment comments reply replies respond disqus "
    "related recommended recommendations footer header masthead topbar toolbar pagination pager login signin signup search widget widgets skip copyright hidden".split()
)
_NAME_LIKE = re.compile(r"^(?:advert|adsby|sponsor|cookie|comment|sidebar|newsletter|breadcrumb|masthead|popup)|(?:nav|menu|navbar|sidebar|footer|comments)$")
#: Words that name a part, place or number and leave open what of.
_NEUTRAL = set(
    "area articles bar block body bottom box button buttons center container content form group icon icons inline inner item items label left link links list main news outer panel posts right row section slot "
    "small stories text thread title top unit wrap wrapper zone".split()
)
#: Class names that tell about a container's layout, not what it is.
_LAYOUT = re.compile(r"^(?:has|with|no|is|js|hide|show)[-_]")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[^A-Za-z0-9]+")


#: Roots of blocks outside any article element.
NOWHERE, MAIN = -1, -2


@dataclass
class Block:
    text: str
    digest: int
    skipped: bool
    root: int


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _boilerplate(tag: str, source: str, in_root: bool) -> bool:
    if tag in _SKIP or tag == "header" and not in_root:
        return True
    if not source.strip():
        return False
    at = _attributes(source)
    if tag not in ("html", "body") and ("hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", "")) or at.get("role", "").lower() in _ROLES):
        return True
    if tag in ("html", "body", "main") or at.get("role", "").lower() == "main":
        return False
    names = [n for n in f"{at.get('class', '')} {at.get('id', '')}".lower().split() if not _LAYOUT.match(n)]
    if tag == "article":
        return any(n in ("comment", "comments", "reply") or n.startswith(("comment-", "comment_", "reply-")) for n in names)
    if in_root and tag in _HEADINGS:
        names = [n for n in at.get("class", "").lower().split() if not _LAYOUT.match(n)]
    return any(_names_boilerplate(n) for n in names)


def _names_boilerplate(name: str) -> bool:
    """Whether all words of a class or id that say what it holds are words for boilerplate: "ad-box", but not "search-algorithms"."""
    told = [p for p in _NAME_PARTS.split(name) if p and not p.isdigit() and p not in _NEUTRAL]
    return bool(told) and all(p in _NAMES or _NAME_LIKE.search(p) for p in told)


def _is_main(tag: str, source: str) -> bool:
    return tag == "main" or "main" in source and _attributes(source).get("role", "").lower() == "main"


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order; white space is one space, character references are decoded.

    ``root`` numbers the outermost article element a block is in, or is MAIN in the
    main element outside articles, or NOWHERE.  ``skipped`` marks blocks in boilerplate elements.  Markup may be
    cut or badly nested: an end tag closes up to its nearest open element, one
    without an open element is ignored.
    """
    out: list[Block] = []
    # pieces of the open block's text with skipped and root: inline boilerplate neither leaks into it nor cuts it
    buffer: list[tuple[str, bool, int]] = []
    # tag, skipped, root, and of an article's header: 1 in it, 2 in a heading of it
    stack: list[tuple[str, bool, int, int]] = []
    skipped, root, header, roots = False, NOWHERE, 0, 0

    def flush() -> None:
        for gone in (False, True):
            pieces = [(t, r) for t, s, r in buffer if s == gone]
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                at_root = next(r for t, r in pieces if t.strip())
                out.append(Block(text, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), gone, at_root))
        buffer.clear()

    def add(text: str) -> None:
        buffer.append((text, skipped or header == 1, root))

    page = page or ""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            add(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if tag in _BLOCK or tag == "xmp":
            flush()
        elif tag == "br":
            add(" ")
        if tag in _VOID:
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    skipped, root, header = stack[-1][1:] if stack else (False, NOWHERE, 0)
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        ends, scope = _ENDS.get(tag, (set(), set()))
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                del stack[k:]
                skipped, root, header = stack[-1][1:] if stack else (False, NOWHERE, 0)
            elif not ends or stack[k][0] in scope:
                break
        attributes = m[3].removesuffix("/")
        skipped = skipped or _boilerplate(tag, attributes, root != NOWHERE)
        if root < 0 and tag == "article" and not skipped:
            root, roots = roots, roots + 1
        elif root == NOWHERE and not skipped and _is_main(tag, attributes):
            root = MAIN
        # of a header inside the article only headings are the article's
        header = 1 if tag == "header" and root != NOWHERE else 2 if header == 1 and tag in _HEADINGS else header
        if m[3].endswith("/") and tag in ("svg", "math"):
            skipped, root, header = stack[-1][1:] if stack else (False, NOWHERE, 0)
            continue
        stack.append((tag, skipped, root, header))
    flush()
    return out


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit vectors of LCS rows: bit j of row i is 0 if LCS(a[:i], b[:j+1]) exceeds LCS(a[:i], b[:j])."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """LCS(a, b[:j]) for j = 0..len(b)."""
    last = _rows(a, b)[-1] if len(a) < 64 else None
    if last is None:
        where: dict[int, int] = {}
        for j, x in enumerate(b):
            where[x] = where.get(x, 0) | 1 << j
        full = (1 << len(b)) - 1
        last = full
        for x in a:
            u = last & where.get(x, 0)
            last = ((last + u) | (last - u)) & full
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared_lines(a: list[int], b: list[int], most_bits: int = 1 << 26) -> list[bool]:
    """For each line of ``a``, whether it is in a longest common subsequence with ``b``.

    Takes len(a) * len(b) / 64 steps and at most about ``most_bits`` bits: larger
    tables are halved (Hirschberg) instead of kept.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return [False] * n
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    if head or tail:
        return [True] * head + shared_lines(a[head : n - tail], b[head : m - tail], most_bits) + [True] * tail
    if n > 1 and n * m > most_bits:
        mid = n // 2
        j = int(np.argmax(_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]))
        return shared_lines(a[:mid], b[:j], most_bits) + shared_lines(a[mid:], b[j:], most_bits)
    rows = _rows(a, b)
    out = [False] * n
    i, j = n, m
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif (low := (1 << j) - 1) and (rows[i - 1] & low).bit_count() == (rows[i] & low).bit_count():
            i -= 1
        else:
            i, j = i - 1, j - 1
            out[i] = True
    return out


def article(texts: list[str], digests: list[int], skipped: list[bool], roots: list[int], partner: list[int] | None, common: list[int] | None = None) -> list[str]:
    """Blocks of the main text, given the lines of the page nearest by URL (None: there is none).

    The text is that of the article elements, else the main element, else the page,
    without boilerplate elements.  Lines shared with the partner are template and
    go.  ``common`` holds shared lines that many pages of the host have: in an
    article element, which the page itself declares, only these go, since copies of
    a page, and passages that articles share, would lose their text.  So it is with
    a page of a pair of copies: one without a line of its own, or, where the
    template is known, with fewer characters of its own than of other shared lines.
    What would leave nothing deletes nothing.
    """
    declared = any(r >= 0 and not s for r, s in zip(roots, skipped, strict=True))
    inside = any(r == MAIN and not s for r, s in zip(roots, skipped, strict=True))
    shared = shared_lines(digests, partner) if partner else [False] * len(texts)
    often = set(common or ())
    left = [(t, x, x and d in often) for t, d, r, s, x in zip(texts, digests, roots, skipped, shared, strict=True) if not s and (r >= 0 if declared else r == MAIN or not inside)]
    story = [t for t, _, c in left if not c]
    own = [t for t, x, _ in left if not x]
    alike = sum(len(t) for t, x, c in left if x and not c)
    if declared or not own or partner and set(partner) <= set(digests) or often and alike > sum(map(len, own)):
        return story or [t for t, *_ in left]
    return own

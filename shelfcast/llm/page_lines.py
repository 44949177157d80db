"""Text lines of an HTML page, in page order, and what its markup says of each."""

from __future__ import annotations

import html
import re

#: What the markup says: navigation, advert, form and the like; inside the article; nothing.
DECLARED, CONTENT, OPEN = 0, 1, 2

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = frozenset("script style noscript template textarea title iframe svg object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot "
    "thead tr ul center".split()
)
_SPACED = frozenset("br td th option wbr".split())
_BOILERPLATE_TAGS = frozenset("nav aside footer form menu button select dialog head".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments reply replies respond disqus discussion share sharing social "
    "related recommended recommendations widget toolbar pagination pager login search outbrain taboola".split()
)


#: Of an element inside the article a name has to say it whole: a part of one ("market-share") says nothing.
_ARTICLE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo newsletter cookie cookies popup modal sidebar "
    "comment comments disqus ad-box adbox cookie-notice cookie-banner newsletter-signup comment-list".split()
)


def _boilerplate(name: str, rest: str, inside: bool) -> bool:
    if name in _BOILERPLATE_TAGS or (name == "header" and not inside):
        return True
    if not rest:
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        value, key = "".join(values), key.lower()
        if key == "role" and value.lower() in _BOILERPLATE_ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key in ("class", "id") and inside:
            if name != "article" and _ARTICLE_NAMES & set(value.lower().split()):
                return True
        elif key in ("class", "id"):
            words = {w.lower() for w in _TOKENS.findall(value)}
            if words & _BOILERPLATE_NAMES and name not in ("html", "body", "main", "article") or words & {"comment", "comments"}:
                return True
            if "header" in words and not inside and name not in ("html", "body", "main", "article"):
                return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, kind) of every block that has text: character references decoded, white space single, trimmed.

    The article is what stands in ``main``, else in ``article``; of a page with
    neither, every block that no element declares as something else is OPEN.
    """
    lines: list[tuple[str, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    parts: list[str] = []

    def close_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, *stack[-1][1:]))

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            parts.append(page[at:])
            break
        parts.append(page[at : found.start()])
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        ends, rest = found["end"] or found["end2"], found["rest"] or found["rest2"] or ""
        if name in _SPACED:
            parts.append(" ")
        if name in _BLOCK:
            close_block()
        if ends:
            if any(name == x[0] for x in stack):
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
            continue
        if name in _RAW and not rest.rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}\s*+[^>]*+>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if name in _VOID or rest.rstrip().endswith("/") and name not in _BLOCK:
            continue
        if name in _BLOCK or name == "p":
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item the item before it
                if stack[k][0] == "p" or (name == "li" == stack[k][0]):
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        _, off, main, article = stack[-1]
        off = off or _boilerplate(name, rest, main or article)
        stack.append((name, off, main or name == "main", article or name == "article"))
    close_block()
    region = 2 if any(not x[1] and x[2] for x in lines) else 3 if any(not x[1] and x[3] for x in lines) else 0
    return [(x[0], DECLARED if x[1] or (region and not x[region]) else CONTENT if region else OPEN) for x in lines]


def common_lines(one: list[str], two: list[str], most: int = 1 << 30) -> set[int]:
    """Places in ``one`` of a longest common subsequence with ``two``.

    Bit-parallel: a row of the table is one integer. Where the rows of a whole
    table would exceed ``most`` bits, the problem is halved first.
    """
    n, m, out = len(one), len(two), set()
    start = 0
    while start < n and start < m and one[start] == two[start]:
        out.add(start)
        start += 1
    stop = 0
    while stop < n - start and stop < m - start and one[n - 1 - stop] == two[m - 1 - stop]:
        out.add(n - 1 - stop)
        stop += 1
    both = set(one[start : n - stop]) & set(two[start : m - stop])
    a = [i for i in range(start, n - stop) if one[i] in both]
    x, y = [one[i] for i in a], [t for t in two[start : m - stop] if t in both]
    return out | {a[k] for k in _aligned(x, y, most)}


def _rows(x: list[str], y: list[str]):
    masks: dict[str, int] = {}
    for j, t in enumerate(y):
        masks[t] = masks.get(t, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for t in x:
        up = row & masks.get(t, 0)
        row = ((row + up) | (row - up)) & full
        yield row


def _aligned(x: list[str], y: list[str], most: int) -> list[int]:
    if not x or not y:
        return []
    if len(x) * len(y) <= most or len(x) == 1:
        rows, out, i, j = list(_rows(x, y)), [], len(x), len(y)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not (i and not rows[i - 1] >> (j - 1) & 1):
                    out.append(i)
                    j -= 1
        return out
    half = len(x) // 2

    def lengths(row: int) -> list[int]:
        out = [0]
        for j in range(len(y)):
            out.append(out[-1] + (1 - (row >> j & 1)))
        return out

    for row in _rows(x[:half], y):
        head = row
    for row in _rows(x[half:][::-1], y[::-1]):
        tail = row
    before, after = lengths(head), lengths(tail)
    j = max(range(len(y) + 1), key=lambda k: before[k] + after[len(y) - k])
    return _aligned(x[:half], y[:j], most) + [half + k for k in _aligned(x[half:], y[j:], most)]

"""A small tolerant HTML reader: whole pages to a tree of elements with their text in page order."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: scripts, styles, form controls and frames.  Formulas, drawings and fallbacks are left to the trees.
HIDDEN = frozenset("script style template head title select option button textarea iframe datalist".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table caption colgroup tbody td tfoot th thead tr ul br".split()
)
#: A start tag closes these if they are open below the nearest scope.
_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption colgroup br li dd dt legend summary".split())
CLOSES = {
    **{t: ("p",) for t in _P},
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "p"),
    "thead": ("tbody", "thead", "tfoot", "tr", "td", "th", "p"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th", "p"),
    "option": ("option",),
    "body": ("head",),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
_WALLS = frozenset("html body table td th caption button article section div main aside nav header footer form blockquote li dd ul ol".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|"
    r"""<([a-zA-Z][^\s/>]*)((?:[^>"']*(?:"[^"]*"|'[^']*'))*[^>"']*|[^>]*)>""",
    re.DOTALL,
)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}


class Page:
    """Elements as parallel lists (tag, parent, attrs) and ``pieces``: (element, text) in page order, text None at a block boundary."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.attrs: list[str] = [""]
        self.pieces: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, s: str) -> None:
        tag, parent, attrs, pieces = self.tag, self.parent, self.attrs, self.pieces
        stack, hidden, at, size = [0], 0, 0, len(s)
        open_tags: dict[str, int] = {}  # of the stack, so that a tag that isn't open costs no search
        match = _TOKEN.search

        def close(i: int) -> int:
            """Pop the stack down to i; how many hidden elements went."""
            gone = [tag[x] for x in stack[i:]]
            del stack[i:]
            for g in gone:
                open_tags[g] -= 1
            return sum(g in HIDDEN for g in gone)

        while at < size:
            m = match(s, at)
            if m is None:
                if not hidden:
                    pieces.append((stack[-1], s[at:]))
                break
            if m.start() > at and not hidden:
                pieces.append((stack[-1], s[at : m.start()]))
            at = m.end()
            if m[2]:
                t = m[2].lower()
                drop = CLOSES.get(t)
                if drop and any(open_tags.get(x) for x in drop):
                    scope = SCOPE.get(t)
                    for i in range(len(stack) - 1, 0, -1):
                        open_ = tag[stack[i]]
                        if open_ in drop:
                            hidden -= close(i)
                        elif open_ in (scope or _WALLS):
                            break
                if t in BLOCK:
                    pieces.append((stack[-1], None))
                if t in VOID:
                    continue
                tag.append(t)
                parent.append(stack[-1])
                attrs.append(" ".join(f"{a.lower()}={x or y or z}" for a, x, y, z in _ATTR.findall(m[3])) if m[3] else "")
                if t in RAW:
                    end = _RAW_END[t].search(s, at)
                    at = end.start() if end else size
                    if not end:
                        break
                stack.append(len(tag) - 1)
                open_tags[t] = open_tags.get(t, 0) + 1
                hidden += t in HIDDEN
            elif m[1]:
                t = m[1].lower()
                if open_tags.get(t):
                    for i in range(len(stack) - 1, 0, -1):
                        if tag[stack[i]] == t:
                            hidden -= close(i)
                            break
                if t in BLOCK or t in VOID:
                    pieces.append((stack[-1], None))

    def text(self, keep=None) -> str:
        """The kept pieces: references decoded, white space in a block as one space, blocks joined by one space."""
        blocks, run = [], []
        for node, piece in self.pieces:
            if piece is None:
                if run:
                    blocks.append("".join(run))
                    run = []
            elif keep is None or keep[node]:
                run.append(piece)
        if run:
            blocks.append("".join(run))
        return " ".join(" ".join(html.unescape(b) for b in blocks).split())

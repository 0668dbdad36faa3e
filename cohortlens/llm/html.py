"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Every element that holds rendered text gets features of its subtree (text
length, link and tag density, punctuation), of its attribute tokens and those of
its ancestors, of its depth and of its siblings.  Boosted trees give each the
probability of being main content.  A dynamic program then chooses, from the
leaves up, whether a subtree is kept whole, dropped whole or split between its
children at a price, so that no descendant can contradict its ancestor.

There are no labelled pages, so the trees are fitted on ``TRAINING_PAGES`` pages
that this module composes itself from common layouts (fixed seed), where each
part's role is known.  Nothing of the corpus is used to fit.

Defined cases: null or empty html gives the empty string; broken markup is read
as far as it goes, to the end of the page; a page is read whole however long;
of equal choices (ties) an element is kept whole before it is dropped or split;
repeated rows and those without page_id are extracted each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import kept_columns, small_batches, table, texts
from .dom import Page
from .trees import BoostedTrees

TRAINING_PAGES = 360
SEED = 5
#: Log-odds that a split between children has to win over keeping or dropping the whole.
SPLIT_PRICE = 3.0

#: Roles of attribute tokens.
LEXICON = {
    "content": "article content post entry story main body text blog news page prose richtext",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc sitemap",
    "header": "header masthead banner topbar branding logo",
    "footer": "footer foot copyright legal colophon bottom",
    "side": "sidebar aside side widget related recommended more popular trending rail complementary",
    "ad": "ad ads adv advert advertisement sponsor sponsored promo promotion promoted outbrain taboola adsense",
    "notice": "cookie consent gdpr notice alert popup modal overlay newsletter subscribe signup dialog toast paywall",
    "comment": "comment comments reply replies respond discussion disqus feedback responses",
    "form": "form search login input field",
    "share": "share social follow tweet facebook like",
}
_ROLE = {t: i for i, ts in enumerate(LEXICON.values()) for t in ts.split()}
_ROLES = len(LEXICON)
_TAGS = {
    "article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 8, "fieldset": 8, "dialog": 6, "search": 8,
}
_KINDS = [("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "ul", "ol", "dl", "dt", "dd"), ("a",), ("div", "section", "span"), ("table", "tr", "td", "th", "tbody"), ("blockquote", "pre", "code", "figure", "figcaption"), ("article", "main"), ("body", "html", "#root")]
_KIND = {t: i for i, ts in enumerate(_KINDS) for t in ts}
_WORDS = re.compile(r"[a-z]+")
_HIDE = re.compile(r"hidden=|display\s*:\s*none|aria-hidden=true")
_MARKS = re.compile(r"[.,;:!?]")


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """A row for each element, and the length of the text it holds directly."""
    n = len(page.tag)
    parent = page.parent
    own, marks, first = np.zeros(n), np.zeros(n), np.full(n, -1.0)
    total = 0
    for node, piece in page.pieces:
        if piece and (size := len(piece.strip())):
            own[node] += size
            marks[node] += len(_MARKS.findall(piece))
            if first[node] < 0:
                first[node] = total
            total += size
    roles = np.zeros((n, 2 * _ROLES))
    depth, text, links, tags, dots, begin = np.zeros(n), own.copy(), np.zeros(n), np.ones(n), marks.copy(), first.copy()
    children, order, same = np.zeros(n), np.zeros(n), np.zeros(n)
    counts: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p, t = parent[i], page.tag[i]
        depth[i] = depth[p] + 1
        order[i] = children[p]
        children[p] += 1
        counts[p, t] = counts.get((p, t), 0) + 1
        if (r := _TAGS.get(t)) is not None:
            roles[i, r] += 1
        if page.attrs[i]:
            low = page.attrs[i].lower()
            for w in _WORDS.findall(low):
                if (r := _ROLE.get(w)) is not None:
                    roles[i, r] += 1
            if _HIDE.search(low):
                roles[i, 6] += 2
        roles[i, _ROLES:] = np.maximum(roles[p, _ROLES:], roles[p, :_ROLES])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        text[p] += text[i]
        links[p] += text[i] if page.tag[i] == "a" else links[i]
        tags[p] += tags[i]
        dots[p] += dots[i]
        if begin[i] >= 0 and (begin[p] < 0 or begin[i] < begin[p]):
            begin[p] = begin[i]
    par = np.maximum(np.array(parent), 0)
    for i in range(1, n):
        same[i] = counts[parent[i], page.tag[i]]
    kind = np.zeros((n, len(_KINDS) + 1))
    kind[np.arange(n), [_KIND.get(t, len(_KINDS)) for t in page.tag]] = 1
    some = np.maximum(text, 1)
    x = np.column_stack(
        [
            np.log1p(text), np.log1p(own), links / some, np.where(np.array([t == "a" for t in page.tag]), 1, 0), tags / some, dots / some, depth, order,
            np.log1p(children[par]), same, text / max(total, 1), text / np.maximum(text[par], 1), begin / max(total, 1), np.log1p(links[par]), links[par] / np.maximum(text[par], 1), roles, kind,
        ]
    )
    return x, own


def decode(page: Page, p: np.ndarray, own: np.ndarray, text: np.ndarray) -> list[bool]:
    """Which elements' own text is kept."""
    n = len(page.tag)
    weight = np.where(text > 0, 1.0, 0.0) + np.where(own > 0, 1.0, 0.0)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = weight * np.log(p), weight * np.log(1 - p)
    alone = np.maximum(keep, drop)
    own_kept = keep > drop
    best_children = np.zeros(n)
    choice = np.zeros(n, np.int8)  # 0 split, 1 keep, 2 drop
    for i in range(n - 1, -1, -1):
        split = (alone[i] if own[i] > 0 else 0.0) + best_children[i] - (SPLIT_PRICE if text[i] > 0 else 0.0)
        best = max(keep[i], drop[i], split)
        choice[i] = 1 if keep[i] == best else 2 if drop[i] == best else 0
        if i:
            q = page.parent[i]
            keep[q] += keep[i]
            drop[q] += drop[i]
            best_children[q] += best
    out = [False] * n
    state = [0] * n
    for i in range(n):
        above = state[page.parent[i]] if i else 0
        state[i] = above or int(choice[i])
        out[i] = state[i] == 1 or (state[i] == 0 and bool(own_kept[i]))
    return out


class Extractor:
    def __init__(self, model: BoostedTrees):
        self.model = model

    def extract(self, pages: list[str]) -> list[str]:
        read = [Page(s) for s in pages]
        rows = [features(p) for p in read]
        sizes = [len(x) for x, _ in rows]
        p = self.model.predict(np.concatenate([x for x, _ in rows])) if rows else np.zeros(0)
        out, at = [], 0
        for page, (x, own), size in zip(read, rows, sizes, strict=True):
            out.append(page.text(decode(page, p[at : at + size], own, np.expm1(x[:, 0]))))
            at += size
        return out


# Training pages: each part is written with its role, and a comment mark around main parts tells the labels.


def _sentence(r: random.Random, n: int) -> str:
    words = ["".join(r.choice("aeioubcdfglmnprstv") for _ in range(r.randint(1, 9))) for _ in range(n)]
    style = r.random()
    if style < 0.08:
        words = [w + r.choice(["###", "***", "!!", "&amp;&amp;&amp;", "%%%"]) for w in words]
    if style > 0.95:
        words = [w.upper() + "!!" for w in words]
    return " ".join(words).capitalize() + r.choice(".....!?")


def _prose(r: random.Random, least: int = 1, most: int = 6) -> str:
    return " ".join(_sentence(r, r.randint(1, 18)) for _ in range(r.randint(least, most)))


def _links(r: random.Random, n: int, inner: str = "{}") -> str:
    return "".join(inner.format(f'<a href="/{r.randint(1, 99)}">{_sentence(r, r.randint(1, 3))[: r.randint(3, 24)]}</a>') for _ in range(n))


def _named(r: random.Random, tag: str, role: str, body: str, chance: float = 0.6) -> str:
    """An element by its own tag, or a div or section with a telling class or id."""
    words = LEXICON[role].split()
    attr = f' {r.choice(["class", "id"])}="{r.choice(["", "site-", "page-", "c-", "js-"])}{r.choice(words)}{r.choice(["", "-box", "-wrap", " wide", "-1"])}"'
    if tag and r.random() < chance:
        return f"<{tag}{attr if r.random() < 0.3 else ''}>{body}</{tag}>"
    box = r.choice(["div", "div", "section"])
    return f"<{box}{attr}>{body}</{box}>"


def _boilerplate(r: random.Random, role: str) -> str:
    if role == "nav":
        return _named(r, "nav", "nav", f"<ul>{_links(r, r.randint(2, 9), '<li>{}</li>')}</ul>" if r.random() < 0.7 else _links(r, r.randint(2, 9), "{} | "))
    if role == "header":
        return _named(r, "header", "header", r.choice(["<a href='/'>{0}</a>", "<h1>{0}</h1>", "<p>{0}</p>", "<div>{0}</div>"]).format(_sentence(r, r.randint(1, 4))) + (_boilerplate(r, "nav") if r.random() < 0.4 else ""))
    if role == "footer":
        return _named(r, "footer", "footer", r.choice([f"&copy; {_prose(r, 1, 3)}", f"<p>&copy; 2024 {_prose(r, 1, 2)}</p>{_links(r, 3)}", _links(r, 5, "<li>{}</li>"), f"<p>{_prose(r, 1, 3)}</p>"]))
    if role == "side":
        return _named(r, "aside", "side", f"<h{r.choice('234')}>{_sentence(r, 2)}</h3>" + r.choice([f"<ul>{_links(r, 5, '<li>{}</li>')}</ul>", f"<p>{_prose(r, 1, 3)}</p>", _links(r, 3, "<p>{}</p>")]))
    if role == "ad":
        return _named(r, "", "ad", r.choice([_prose(r, 1, 2), f"<p>{_prose(r, 1, 3)}</p>", f"<a href='x'>{_prose(r, 1, 1)}</a>"]))
    if role == "notice":
        return _named(r, "dialog", "notice", f"<p>{_prose(r, 1, 2)}</p>" + r.choice(["", "<button>ok</button>", _links(r, 1)]), 0.15)
    if role == "comment":
        one = lambda: r.choice(["<li><b>{1}</b><p>{0}</p></li>", "<div class='comment'><p>{0}</p></div>", "<p>{0}</p>", "<article><p>{0}</p></article>"]).format(_prose(r, 1, 3), _sentence(r, 1))
        return _named(r, "", "comment", f"<h3>{_sentence(r, 1)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 5))))
    if role == "form":
        return f"<form action='/s'{r.choice(['', ' class=search', ' id=login'])}><label>{_sentence(r, 2)}</label><input name=q>{r.choice(['', f'<p>{_prose(r, 1, 1)}</p>'])}<button>go</button></form>"
    return _named(r, "", "share", _links(r, r.randint(2, 4)))


_MAIN = "\x01"


def _article(r: random.Random) -> str:
    title = _prose(r, 1, 1)
    parts = [f"<h1>{_MAIN}{title}</h1>"] if r.random() < 0.8 else []
    if parts and r.random() < 0.2:
        parts = [f"<header>{parts[0]}</header>"]
    tiny = r.random() < 0.2  # an article of a few words
    if tiny:
        title = _sentence(r, r.randint(1, 5))
        parts = [f"<h1>{_MAIN}{title}</h1>"] * bool(parts) + [r.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}"]).format(_MAIN + title)]
    for _ in range(0 if tiny else r.randint(1, 9)):
        text = _prose(r, 1, r.choice([1, 3, 12]))
        kind = r.random()
        if kind < 0.7:
            text = text if r.random() < 0.8 else r.choice(["<b>{}", "<em>{}</em>", "<a href='/x'>{}</a> ok.", "<b>{}<br>"]).format(text)
            parts.append(f"<p>{_MAIN}{text}" + ("</p>" if r.random() < 0.85 else ""))
        elif kind < 0.78:
            parts.append(f"<h2>{_MAIN}{_sentence(r, 3)}</h2>")
        elif kind < 0.86:
            parts.append("<ul>" + "".join(f"<li>{_MAIN}{_sentence(r, 6)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
        elif kind < 0.92:
            parts.append(f"<blockquote>{_MAIN}{text}</blockquote>")
        elif kind < 0.96:
            parts.append("<table>" + "".join(f"<tr><td>{_MAIN}{_sentence(r, 2)}</td><td>{_MAIN}{_sentence(r, 2)}</td></tr>" for _ in range(2)) + "</table>")
        else:
            parts.append(f"{_MAIN}{text}<br>{_MAIN}{_prose(r, 1, 2)}")
        if r.random() < 0.08:
            parts.append(_boilerplate(r, r.choice(["ad", "share", "side", "notice", "form"])))
    body = "".join(parts)
    kind = r.random()
    if kind < 0.6:
        return f"<article{r.choice(['', ' class=post', ' id=story'])}>{body}</article>"
    if kind < 0.75:
        return f"<main>{body}</main>"
    return f"<div class='{r.choice(['content', 'post-body', 'entry-content', 'article-text', 'story', 'main'])}'>{body}</div>"


def training_page(r: random.Random) -> str:
    some = lambda roles: "".join(_boilerplate(r, x) for x in roles if r.random() < 0.5)
    top = some(r.sample(["header", "nav", "ad", "notice", "form"], 5))
    bottom = some(r.sample(["comment", "share", "side", "ad", "nav", "notice", "form"], 7)) + (_boilerplate(r, "footer") if r.random() < 0.8 else "")
    middle = _article(r)
    if r.random() < 0.3:
        middle = f"<div class='{r.choice(['wrap', 'container', 'row', 'layout'])}'>{some(['side', 'nav'])}{middle}{some(['side', 'ad'])}</div>"
    if r.random() < 0.2:
        middle = f"<main>{middle}</main>"
    return f"<!DOCTYPE html><html><head><title>{_sentence(r, 3)}</title><style>p{{}}</style></head><body>{top}{middle}{bottom}</body></html>"


def train() -> BoostedTrees:
    """Fit on the composed pages; an element is main if at least half of its text is."""
    r = random.Random(SEED)
    xs, ys = [], []
    for _ in range(TRAINING_PAGES):
        page = Page(training_page(r))
        n = len(page.tag)
        main, text = np.zeros(n), np.zeros(n)
        pieces, marked = [], set()
        for node, piece in page.pieces:
            if piece:
                text[node] += len(piece.strip(_MAIN + " "))
                if _MAIN in piece or node in marked:
                    marked.add(node)
                    main[node] += len(piece.strip(_MAIN + " "))
                piece = piece.replace(_MAIN, "")
            pieces.append((node, piece))
        page.pieces = pieces
        inline = [page.tag[i] in ("b", "em", "a") and page.parent[i] in marked for i in range(n)]
        main[inline] = text[inline]
        for i in range(n - 1, 0, -1):
            main[page.parent[i]] += main[i]
            text[page.parent[i]] += text[i]
        x, _ = features(page)
        some = text > 0
        xs.append(x[some])
        ys.append(main[some] >= 0.5 * text[some])
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def extract_main_text(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text, n_chars; one row a page."""
    spark = pages.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model or train())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(sent.value)
        for b in batches:
            if b.num_rows:
                found = extractor.extract(texts(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], schema=schema)

    return kept_columns(pages, "page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_main_text": op5_html_main_text}
ORACLES: dict[str, str] = {}

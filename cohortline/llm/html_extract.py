"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element has a hidden label, content or not.  Its own features give a unary
potential, and each parent-child pair a potential by the child's kind (text-level,
set apart, container, list or other).  One sum-product pass up the tree and one down give
every element's content marginal; text in elements above one half is kept.

No feature knows how long a text is by itself, only its part of the page's and of its
parent's, so that short articles are articles too.

The weights are the maximum-likelihood fit (gradient: label counts less expected
counts from the same message passing) to labelled pages: ``LABELLED`` and ``practice_pages`` below, marked
by hand, and a sample of at most ``SAMPLE_PAGES`` pages of the table itself that
have a sectioning ``article`` or ``main`` and so label themselves.

Defined results.  Null or empty html, and pages without content, have the empty text.
Repeated rows give repeated rows, an empty table an empty result; other columns
are ignored.  Without usable pages in the table the marked pages alone train the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.dom import INLINE, Page, attributes, block_texts, parse

SAMPLE_PAGES = 300
ROUNDS = 250
BATCH_NODES = 60_000

# fixed values: element names and words of class, id and role attributes that the features look at
TAG_GROUPS = [("article",), ("main",), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "label"),
              ("h1", "h2", "h3", "h4", "h5", "h6"), ("p", "blockquote", "pre"), ("ul", "ol", "li", "dl", "dt", "dd"),
              ("table", "tr", "td", "th", "tbody", "thead"), ("a",), ("div", "section", "body", "html"), ("head",),
              ("figure", "figcaption"), ("dialog",)]
AGAINST = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
                    "copyright dialog disclaimer disqus footer form gdpr header login masthead menu meta modal nav navbar navigation "
                    "newsletter notice notification alert overlay pagination pager popup promo promotion recommended related reply "
                    "replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget "
                    "contentinfo complementary site topbar".split())
FOR = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
# of AGAINST, what an article or main element itself is not named for its place or layout by
APART = frozenset("ad ads advert advertisement advertising banner comment comments consent cookie cookies disclaimer disqus gdpr login modal "
                  "newsletter notice notification alert overlay popup promo promotion recommended related reply replies respond signup "
                  "sponsor sponsored subscribe widget".split())
# kinds of children that have potentials of their own towards their parent: text-level, set apart, containers, lists and tables, others
KINDS = [INLINE, frozenset("aside dialog footer form header menu nav".split()), frozenset("article body div html main section".split()),
         frozenset("dd dl dt li ol table tbody td th thead tr ul".split())]

_TOKENS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Pages marked by hand: data-c="1" starts content, data-c="0" ends it, for the element and what is in it.
_P = "A sentence of some length stands here, and then another one follows it, as prose does."
LABELLED = [
    f'<body><header class="site-header"><h1>Site</h1><p>Slogan of the site</p></header><div id="content" data-c="1"><h1>Title</h1><p>{_P}</p>'
    f'<p>{_P} <a href="x">link</a> {_P}</p><div class="related" data-c="0"><h3>Related</h3><ul><li><a href="y">Other</a></li></ul></div></div>'
    f'<aside data-c="0"><p>{_P}</p></aside><footer><p>Terms and {_P}</p></footer></body>',
    f'<body><div class="cookie-notice"><p>We use cookies. {_P}</p></div><main data-c="1"><article><h1>T</h1><p>{_P}</p><p>Short.</p>'
    f'<ul><li>First point</li><li>Second point</li></ul></article><section class="comments" data-c="0"><h2>Comments</h2><div class="comment">'
    f'<p>{_P}</p></div><div class="comment"><p>{_P} {_P}</p></div></section></main></body>',
    f'<body><nav><ul><li><a href="1">Home</a></li><li><a href="2">News</a></li></ul></nav><div class="sidebar"><h3>About</h3><p>{_P}</p></div>'
    f'<div class="post" data-c="1"><h2>T</h2><p>{_P}</p><blockquote>{_P}</blockquote><p><b>bold</b> and <i>more</i> {_P}</p>'
    f'<form data-c="0"><label>Mail</label><p>Subscribe to our letter</p></form></div><div class="footer">&copy; someone</div></body>',
    f'<body><div class="banner"><p>{_P}</p></div><article data-c="1"><h1>T</h1><p>{_P}</p><div class="ad" data-c="0"><p>{_P}</p></div>'
    f'<p>{_P}</p><aside data-c="0"><p>{_P}</p></aside><table><tr><td>1</td><td>2</td></tr></table><footer data-c="0"><p>Filed under x</p></footer>'
    f'</article><div id="comments"><p>{_P}</p><p>{_P}</p></div></body>',
    f'<body><div class="menu"><a href="1">One</a> <a href="2">Two</a></div><div><div data-c="1"><h1>T</h1><p>{_P}</p><p>{_P}</p><p>{_P}</p>'
    f'<p>Ok.</p></div></div><div class="newsletter"><p>{_P}</p></div><div role="contentinfo"><p>{_P}</p></div></body>',
    f'<body><header><nav><a href="1">A</a></nav></header><section data-c="1"><h2>T</h2><p>{_P}</p><figure><figcaption>A caption</figcaption></figure>'
    f'<div><p>{_P}</p></div></section><div class="share"><a href="1">Share</a></div><section class="reader-comments"><article><p>{_P}</p>'
    f'</article><article><p>{_P}</p></article></section><div class="notice"><p>{_P}</p></div></body>',
    f'<body><form><p>Search this site</p><label>Word</label></form><div role="main" data-c="1"><p>{_P}</p><pre>code here</pre><ol><li>{_P}</li>'
    f'<li>{_P}</li></ol></div><div class="popup"><div><p>{_P}</p></div></div><aside class="widget"><div><p>{_P}</p></div></aside></body>',
]


# Practice pages are put together from these parts: containers of the article, articles, and what stands around them.
_S = "A short one."
_LINKS = '<ul><li><a href="a">First link</a></li><li><a href="b">Second link</a></li><li><a href="c">Third</a></li></ul>'
CONTAINERS = ["<article data-c=1>{}</article>", "<main data-c=1>{}</main>", '<div class="post" data-c=1>{}</div>', '<div id=content data-c=1>{}</div>',
              '<article class="search-result" data-c=1>{}</article>', "<main data-c=1><article>{}</article></main>", "<section data-c=1>{}</section>",
              '<div role="main" data-c=1>{}</div>', '<div class="entry-content" data-c=1>{}</div>', "<div><div data-c=1>{}</div></div>",
              '<article class="post has-sidebar" id="p1" data-c=1>{}</article>']
ARTICLES = [f"<p>{_P}</p>", f"<h1>T</h1><p>{_P}</p><p>{_P}</p>", f"<p>{_S}</p>", f"<p>{_P}</p><p>{_S}</p><div><p>{_P}</p></div>", f"<h2>T</h2><p>{_S}</p><p>{_S}</p>",
            f"<h1>T</h1><p>{_P}</p>{_LINKS}", f"<p>{_P}</p><ul><li>{_S}</li><li>{_P}</li></ul>", f"{_P}<br>{_S}", f"<p>{_P}</p><blockquote><p>{_P}</p></blockquote>",
            f'<p>{_P} <a href="x">linked words</a> {_S}</p><table><tr><td>1</td><td>{_S}</td></tr></table>', f"<h1>T</h1><p>{_P}</p><p>{_P}</p><p>{_P}</p><p>{_P}</p>",
            f"<p>{_P}</p><figure><figcaption>{_S}</figcaption></figure><pre>code</pre>", f'<div class="story"><p>{_P}</p><p>{_P}</p></div>']
INSIDE = ["", f'<div class="ad" data-c=0><p>{_P}</p></div>', "", f"<aside data-c=0><p>{_P}</p></aside>", '<div class="share" data-c=0><a href="s">Share</a></div>', "",
          f'<form data-c=0><label>Mail</label><p>{_S}</p></form>', f'<div class="related" data-c=0><h3>Related</h3>{_LINKS}</div>', "", f"<footer data-c=0><p>{_S}</p></footer>",
          f'<div class="notice" data-c=0>{_P}</div>', f'<section class="comments" data-c=0><h2>Comments</h2><p>{_P}</p></section>', f"<nav data-c=0>{_LINKS}</nav>"]
BEFORE = [f"<nav>{_LINKS}</nav>", f'<header class="site-header"><h1>Site</h1><p>{_S}</p></header>', "", f'<div class="menu">{_LINKS}</div>', f'<div class="cookie-notice"><p>{_P}</p></div>',
          f'<div class="ad">{_P}</div>', f"<form><p>{_S}</p><label>Word</label></form>", f'<header><nav>{_LINKS}</nav></header><div class="banner"><p>{_P} {_P}</p></div>']
AFTER = [f"<footer><p>{_S}</p></footer>", f'<div class="sidebar"><h3>About</h3><p>{_P}</p><p>{_P}</p></div>', f"<aside><p>{_P}</p>{_LINKS}</aside>",
         f'<div class="comments"><div class="comment"><p>{_P}</p></div><div class="comment"><p>{_P} {_P}</p></div></div>', f'<div class="footer">{_S} {_P}</div>',
         f'<section class="reader-comments"><article><p>{_P}</p></article><article class="comment"><p>{_P}</p></article></section>', "",
         f'<div class="newsletter"><p>{_P}</p></div><footer><p>{_P}</p></footer>', f'<dialog><p>{_P}</p></dialog><div role="contentinfo"><p>{_P}</p></div>']


def practice_pages(n: int = 180) -> list[str]:
    """Marked pages of varied layouts and lengths: the parts' lists are gone through side by side at different steps."""
    def part(parts: list[str], k: int) -> str:
        return parts[k % len(parts)]

    out = []
    for k in range(n):
        body = part(ARTICLES, k + k // len(ARTICLES))
        inside = part(INSIDE, 3 * k + k // 7)
        body = inside + body if k % 4 == 3 else body + inside
        out.append(f"<body>{part(BEFORE, k + k // 5)}{part(BEFORE, 5 * k + 3) if k % 2 else ''}{part(CONTAINERS, k + k // 3).format(body)}"
                   f"{part(AFTER, 2 * k + k // 9)}{part(AFTER, 7 * k + 1) if k % 3 else ''}</body>")
    return out


def n_features() -> int:
    return len(TAG_GROUPS) + 9


_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}


def kind(tag: str) -> int:
    return next((k for k, tags in enumerate(KINDS) if tag in tags), len(KINDS))


@dataclass
class Forest:
    """Elements of several pages: parents before children, one tree per page."""
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    x: np.ndarray
    first: np.ndarray       # each page's first element (its root)


def hints(raw: str, tag: str = "") -> tuple[bool, bool]:
    """Whether class, id or role speak for or against content; an article, a main part and the body are
    taken by what they are, not by words for their layout."""
    if not raw or "=" not in raw:
        return False, False
    a = attributes(raw)
    words = {w.lower() for k in ("class", "id", "role") if a.get(k) for w in _TOKENS.findall(a[k])}
    return bool(words & FOR), bool(words & (APART if tag in ("article", "main", "body", "html") else AGAINST))


def forest(pages: list[Page]) -> Forest:
    size = [len(p.tag) for p in pages]
    first = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    n = int(first[-1])
    parent = np.empty(n, np.int64)
    depth, kinds = np.empty(n, np.int64), np.empty(n, np.int8)
    x = np.zeros((n, n_features()), np.float32)
    own, linked = np.zeros(n), np.zeros(n)
    g = len(TAG_GROUPS)
    for p, lo in zip(pages, first):
        lo = int(lo)
        m = len(p.tag)
        parent[lo:lo + m] = np.array(p.parent) + lo
        parent[lo] = -1
        depth[lo:lo + m] = p.depth
        for i, t in enumerate(p.tag):
            kinds[lo + i] = kind(t)
            c = _GROUP.get(t)
            if c is not None:
                x[lo + i, c] = 1
            if p.attrs[i]:
                for_it, against = hints(p.attrs[i], t)
                x[lo + i, g] = for_it and not against
                x[lo + i, g + 1] = against
        for i, t in p.runs:
            if t is not None:
                k = len(t.strip())
                own[lo + i] += k
                if p.tag[i] == "a":
                    linked[lo + i] += k
    total, in_links = own.copy(), linked.copy()
    for at in reversed(_levels(depth)[1:]):
        np.add.at(total, parent[at], total[at])
        np.add.at(in_links, parent[at], in_links[at])
    share = in_links / np.maximum(total, 1)
    page = np.repeat(total[first[:-1]], np.diff(first))
    above = np.where(parent >= 0, total[parent], total)
    x[:, g + 2] = (share > 0.5) & (total > 0)
    x[:, g + 3] = own > 0
    x[:, g + 4] = total / np.maximum(page, 1)
    x[:, g + 5] = total / np.maximum(above, 1)
    x[:, g + 6] = depth <= 2
    x[:, g + 7] = 1
    # an article or main part that stands in nothing set apart (comments hold articles too)
    apart = (x[:, g + 1] > 0) | (kinds == 1)
    for at in _levels(depth)[1:]:
        apart[at] |= apart[parent[at]]
    x[:, g + 8] = (x[:, 0] + x[:, 1] > 0) & ~apart
    return Forest(parent, depth, kinds, x, first)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The elements of each depth, from the roots down."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1)))


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every element (n, 2) and of every edge to its parent (n, parent, child).

    ``unary`` is (n, 2), ``pair`` (kind, parent label, child label), both as logs."""
    levels = _levels(f.depth)
    up = np.zeros_like(unary)             # message of each element to its parent
    inbox = unary.copy()                  # own potential and the children's messages
    for at in reversed(levels[1:]):
        s = inbox[at][:, None, :] + pair[f.kind[at]]             # (n, parent, child)
        up[at] = np.logaddexp(s[..., 0], s[..., 1])
        up[at] -= up[at].max(axis=1, keepdims=True)
        for y in (0, 1):
            inbox[:, y] += np.bincount(f.parent[at], up[at, y], len(inbox))
    belief = inbox.copy()
    edge = np.zeros((len(unary), 2, 2))
    for at in levels[1:]:
        above = belief[f.parent[at]] - up[at]                    # the parent without this child
        s = above[:, :, None] + pair[f.kind[at]]
        belief[at] = inbox[at] + np.logaddexp(s[:, 0], s[:, 1])
        belief[at] -= belief[at].max(axis=1, keepdims=True)
        joint = s + inbox[at][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        edge[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), edge


@dataclass
class ContentModel:
    weights: np.ndarray     # (features,): score of label 1
    pair: np.ndarray        # (kinds, 2, 2)

    def unary(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(x)), x @ self.weights], axis=1)

    def keep(self, pages: list[Page]) -> list[np.ndarray]:
        f = forest(pages)
        p, _ = sum_product(f, self.unary(f.x), self.pair)
        return [p[a:b, 1] > 0.5 for a, b in zip(f.first[:-1], f.first[1:])]


def marked_labels(page: Page) -> np.ndarray:
    """Labels of a page marked by ``data-c``."""
    y = np.zeros(len(page.tag), np.int64)
    for i in range(1, len(y)):
        mark = attributes(page.attrs[i]).get("data-c") if page.attrs[i] else None
        y[i] = y[page.parent[i]] if mark is None else int(mark)
    return y


def sectioned_labels(page: Page) -> np.ndarray | None:
    """Labels of a page with ``article`` or ``main``: what is in it, without parts that
    an element or attribute sets apart.  None for other pages."""
    y = np.zeros(len(page.tag), np.int64)
    apart = {"nav", "menu", "header", "footer", "aside", "form", "dialog"}
    seen = False
    for i in range(1, len(y)):
        t = page.tag[i]
        if t in apart or hints(page.attrs[i], t)[1]:
            y[i] = -1
        elif y[page.parent[i]] == -1:
            y[i] = -1
        elif t in ("article", "main"):
            y[i], seen = 1, True
        else:
            y[i] = y[page.parent[i]]
    return np.maximum(y, 0) if seen else None


def train(pages: list[Page], labels: list[np.ndarray], weight: list[float], rounds: int = ROUNDS) -> ContentModel:
    """Maximum likelihood with a small ridge, by Adam on exact gradients."""
    f = forest(pages)
    y = np.concatenate(labels)
    wt = np.repeat(weight, [len(v) for v in labels])
    inner = f.parent >= 0
    onehot = np.eye(2)[y]
    seen = np.zeros((len(y), 2, 2))
    seen[np.flatnonzero(inner), y[f.parent[inner]], y[inner]] = 1
    n_kinds = len(KINDS) + 1
    m = ContentModel(np.zeros(f.x.shape[1]), np.zeros((n_kinds, 2, 2)))
    theta = np.zeros(m.weights.size + 4 * n_kinds)
    a, b = np.zeros_like(theta), np.zeros_like(theta)
    total = wt.sum()
    for t in range(1, rounds + 1):
        p, edge = sum_product(f, m.unary(f.x), m.pair)
        gw = f.x.T @ ((onehot - p)[:, 1] * wt)
        gp = np.stack([((seen - edge) * (wt * (inner & (f.kind == k)))[:, None, None]).sum(axis=0) for k in range(n_kinds)])
        g = np.concatenate([gw, gp.ravel()]) / total - 1e-4 * theta
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        theta += 0.1 * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-9)
        m = ContentModel(theta[:m.weights.size], theta[m.weights.size:].reshape(n_kinds, 2, 2))
    return m


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, id_col: str = "page_id", html_col: str = "html") -> ContentModel:
    """Train on the marked pages and at most ``sample`` pages of the table (smallest id hashes)."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    rows = (pages.where(F.col(html_col).isNotNull()).select(key.alias("k"), F.col(html_col).cast("string").alias("html"))
            .where(F.length("html").between(1, 50_000)).orderBy("k", "html").limit(sample).collect())
    parsed, labels, weight = [], [], []
    for r in rows:
        p = parse(r["html"])
        y = sectioned_labels(p)
        if y is not None:
            parsed.append(p)
            labels.append(y)
    weight = [1.0] * len(parsed)
    marked = LABELLED + practice_pages()
    share = max(1.0, len(parsed) / len(marked))        # both kinds of labelled pages count alike
    for source in marked:
        p = parse(source)
        parsed.append(p)
        labels.append(marked_labels(p))
        weight.append(share)
    # the marks are not features: attributes() of data-c is never looked at by hints()
    return train(parsed, labels, weight)


def extract(pages: DataFrame, model: ContentModel, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)       # a few hundred bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts: list[str] = []
            held: list[Page] = []
            nodes = 0

            def flush():
                for p, keep in zip(held, m.keep(held)):
                    texts.append(" ".join(block_texts(p, keep)))

            for source in batch.column("html").to_pylist():
                held.append(parse(source))
                nodes += len(held[-1].tag)
                if nodes >= BATCH_NODES:
                    flush()
                    held, nodes = [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
            .mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint"))

"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element is a row of features: its kind, words of its class, id, role and
itemprop, depth, text and link density of its subtree, place in the page, and statistics of
its parent and siblings. The trees give the log-odds that the element lies wholly in the
article. Decoding chooses for every element between "all of it is article" and "it is not, and
each child is decided for itself", whichever has the larger sum of weighted log-odds, so an
element that is article never holds one that is not.

The model is trained on the driver from a bounded sample of pages (``sample`` rows): their
own marked articles (article, main, role=main, itemprop=articleBody), and the same paragraphs
set into other layouts, with and without telling names, between menus, headers, sidebars,
notices, adverts, forms, share bars and reader comments made of the sample's other text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenscan.llm.dom import Page, attribute_words
from greenscan.llm.trees import Forest, boost

# Words in names of elements that tell what they hold.
ARTICLE_WORDS = frozenset("""article articlebody articletext body bodytext content copy entry
hentry lead main maincontent page post postbody prose reader story storybody text""".split())
OTHER_WORDS = frozenset("""ad ads advert advertisement adverts alert archive author banner bar box
breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disqus
discussion donate dropdown follow foot footer form gdpr head header login links logo masthead menu
message meta modal nav navbar navigation newsletter note notice notification overlay pager pagination
paywall popular popup privacy promo promotion rail reaction reactions recommended related reply replies respond
responses search share sharing shop sidebar signup skip social sponsor sponsored subscribe subscription
tags teaser toc toolbar tooltip top trending warning widget widgets""".split())
KINDS = [("article",), ("main",), ("section",), ("div", "center"), ("nav", "menu"), ("header", "hgroup"),
         ("footer",), ("aside",), ("form", "fieldset", "legend", "search", "dialog"),
         ("ul", "ol", "dl"), ("li", "dt", "dd"), ("p", "blockquote", "pre"), ("h1",),
         ("h2", "h3", "h4", "h5", "h6"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
         ("figure", "figcaption", "details", "summary")]
KIND = {name: k for k, names in enumerate(KINDS) for name in names}
OTHER_KINDS = [4, 6, 7, 8]  # nav, footer, aside, form


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of all elements of all pages, text length of each subtree)."""
    sizes = [len(p.tag) for p in pages]
    start = np.cumsum([0, *sizes[:-1]])
    page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.concatenate([np.array(p.parent) + s for p, s in zip(pages, start)])
    root = parent < start[page]
    parent = np.where(root, np.arange(len(parent)), parent)
    last = np.concatenate([np.array(p.last) + s for p, s in zip(pages, start)])
    depth = np.concatenate([p.depth for p in pages]).astype(float)
    kind = np.array([KIND.get(t, -1) for p in pages for t in p.tag])
    words: dict[str, tuple[int, int]] = {"": (0, 0)}
    said = []
    for p in pages:
        for a in p.attrs:
            if a not in words:
                w = attribute_words(a)
                words[a] = (len(w & ARTICLE_WORDS), len(w & OTHER_WORDS))
            said.append(words[a])
    good, bad = np.array(said, dtype=float).reshape(-1, 2).T
    n = len(parent)
    own, link, stops, blocks, first = (np.zeros(n) for _ in range(5))
    first[:] = -1
    for p, s in zip(pages, start):
        offset = 0
        for node, text, linked in p.blocks:
            own[s + node] += len(text)
            link[s + node] += linked
            stops[s + node] += text.count(". ") + text.count(",") + (text[-1:] in ".!?")
            blocks[s + node] += 1
            offset += len(text)
    inline = np.concatenate([p.tags_inside for p in pages]).astype(float)

    def below(v: np.ndarray) -> np.ndarray:  # sum over the subtree: rows are in document order
        c = np.concatenate([[0.0], np.cumsum(v)])
        return c[last + 1] - c[:-1]

    text, links, tags = below(own), below(link), below(inline + 1)
    before = np.concatenate([[0.0], np.cumsum(own)])[:-1]
    whole = np.maximum(text[start][page], 1)
    begin = (before - before[start][page]) / whole
    # ancestors: rows come after their parents, so levels are settled from the top
    up_good, up_bad = good.copy(), bad + np.isin(kind, OTHER_KINDS)
    for d in range(1, int(depth.max(initial=0)) + 1):
        rows = np.flatnonzero(depth == d)
        up_good[rows] += up_good[parent[rows]]
        up_bad[rows] += up_bad[parent[rows]]
    mates = np.bincount(parent[~root], minlength=n)[parent].astype(float)
    mates_text = np.bincount(parent[~root], weights=text[~root], minlength=n)[parent]
    same = np.zeros(n)
    place = np.zeros(n)
    pair = parent * (len(KINDS) + 1) + kind + 1
    uniq, inv, count = np.unique(pair, return_inverse=True, return_counts=True)
    same[:] = count[inv] / np.maximum(mates, 1)
    order = np.lexsort((np.arange(n), parent))
    head = np.concatenate([[True], parent[order][1:] != parent[order][:-1]])
    place[order] = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ratio = lambda a, b: a / np.maximum(b, 1)
    columns = [np.log1p(text), ratio(links, text), np.log1p(own), np.log1p(tags), ratio(text, tags),
               100 * ratio(below(stops), text), ratio(text, below(blocks)), text / whole, begin, begin + text / whole,
               depth, np.log1p(mates), ratio(place, mates), same, ratio(mates_text, mates), np.log1p(text[parent]),
               ratio(links[parent], text[parent]), ratio(text, text[parent]), good, bad, up_good, up_bad]
    columns += [(kind == k).astype(float) for k in range(len(KINDS))]
    return np.stack(columns, 1), text


def decode(page: Page, odds: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each element is article: the tree labelling with the largest weighted log-odds."""
    score = np.clip(odds, -8, 8) * np.log1p(text)
    n = len(score)
    whole, split = score.copy(), np.zeros(n)  # all article; or not, with the best of the children
    for v in range(n - 1, 0, -1):
        up = page.parent[v]
        whole[up] += whole[v]
        split[up] += max(whole[v], split[v])
    chosen = np.zeros(n, dtype=bool)
    for v in range(n):
        chosen[v] = (v > 0 and chosen[page.parent[v]]) or whole[v] > split[v]
    return chosen


def main_texts(htmls: list[str | None], forest: Forest) -> list[str]:
    """The article text of every page: blocks in page order, joined by line feeds."""
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    x, text = features(pages)
    odds = forest.log_odds(x)
    out, s = [], 0
    for p in pages:
        e = s + len(p.tag)
        keep = decode(p, odds[s:e], text[s:e])
        out.append("\n".join(t for node, t, _ in p.blocks if keep[node]))
        s = e
    return out


# ---------------------------------------------------------------- training

ARTICLE = re.compile(r"""<(article|main)\b|<(\w+)(?=[^>]*\b(?:role\s*=\s*["']?main|itemprop\s*=\s*["']?articleBody))""", re.I)


def _pieces(html: str) -> tuple[str | None, list[str], list[str]]:
    """(page with its article marked, or None; article blocks; other blocks). Without a marked
    article, long blocks with few links stand for it."""
    marked = ARTICLE.sub(lambda m: m[0] + ' data-y="1"', html, count=1)
    page = Page(marked, marks=True)
    inside = np.zeros(len(page.tag), dtype=bool)
    for v in range(len(page.tag)):
        inside[v] = page.mark[v] == 1 or (v > 0 and inside[page.parent[v]])
    if inside.any():
        return marked, [t for n, t, _ in page.blocks if inside[n]], [t for n, t, _ in page.blocks if not inside[n]]
    long = lambda t, a: len(t) >= 80 and a < 0.3 * len(t)
    return None, [t for _, t, a in page.blocks if long(t, a)], [t for _, t, a in page.blocks if not long(t, a)]


def layout(rng: random.Random, paragraphs: list[str], others: list[str], named: bool) -> str:
    """A page with these paragraphs as its marked article and other text around and inside."""
    esc = lambda t: escape(t, quote=False)
    pick = lambda words: rng.choice(sorted(words))
    short = lambda n=60: esc(rng.choice(others)[:rng.randint(8, n)]) if others else "x"

    def box(tags: list[str], words: list[str], inner: str, mark: str = "") -> str:
        tag = rng.choice(tags)
        name = f' {rng.choice(["class", "id"])}="{rng.choice(words)}"' if rng.random() < (0.9 if named else 0.3) else ""
        return f"<{tag}{name}{mark}>{inner}</{tag}>"

    def links(n: int) -> str:
        items = "".join(f'<li><a href="#">{short(30)}</a></li>' for _ in range(n))
        return f"<ul>{items}</ul>" if rng.random() < 0.7 else "".join(f'<a href="#">{short(30)}</a> ' for _ in range(n))

    def prose(n: int) -> str:
        return "".join(f"<p>{short(400)}</p>" for _ in range(n))

    def around(place: str) -> str:
        parts = []
        wanted = {"top": ["menu", "head", "notice", "ad", "search"], "side": ["aside", "ad", "signup"],
                  "end": ["related", "comments", "foot", "signup", "ad", "notice"],
                  "inside": ["share", "ad", "related", "signup", "byline"]}[place]
        for what in wanted:
            if rng.random() > (0.35 if place == "inside" else 0.6):
                continue
            m = ' data-y="0"'
            parts.append({
                "menu": lambda: box(["nav", "div", "ul"], ["menu", "main-nav", "navbar", "topnav"], links(rng.randint(3, 9)), m),
                "head": lambda: box(["header", "div"], ["site-header", "masthead", "top"], f"<h1>{short(30)}</h1>"[: None if rng.random() < .3 else 0] + f"<div>{short(50)}</div>" + links(3), m),
                "notice": lambda: box(["div", "section", "aside"], ["cookie-notice", "alert", "consent-banner", "notice"], f"<p>{short(160)}</p><button>OK</button>", m),
                "ad": lambda: box(["div", "aside", "section"], ["ad", "advert", "ad-slot", "sponsored", "promo"], rng.choice([short(80), f"<p>{short(120)}</p>", f'<a href="#">{short(80)}</a>']), m),
                "search": lambda: box(["form", "div"], ["search", "search-box"], f"<label>{short(20)}</label><input><button>Go</button>", m),
                "aside": lambda: box(["aside", "div"], ["sidebar", "rail", "widget-area"], f"<h3>{short(30)}</h3>" + links(rng.randint(2, 6)) + prose(rng.randint(0, 2)), m),
                "signup": lambda: box(["form", "div"], ["newsletter", "signup", "subscribe-form"], f"<h4>{short(40)}</h4><p>{short(100)}</p><label>{short(20)}</label><input>", m),
                "related": lambda: box(["div", "section", "aside"], ["related", "recommended", "more-links"], f"<h3>{short(30)}</h3>" + links(rng.randint(2, 6)), m),
                "comments": lambda: box(["section", "div", "ol"], ["comments", "comment-list", "disqus", "replies"], f"<h3>{short(30)}</h3>" + "".join(
                    box(["div", "article", "li"], ["comment", "reply"], f"<div>{short(20)}</div><p>{short(300)}</p>") for _ in range(rng.randint(1, 5))), m),
                "foot": lambda: box(["footer", "div"], ["footer", "site-footer", "copyright"], f"&copy; {short(120)} " + (links(3) if rng.random() < .5 else ""), m),
                "share": lambda: box(["div", "ul"], ["share", "social-links"], links(rng.randint(2, 4)), m),
                "byline": lambda: box(["div", "p"], ["byline", "author-meta"], short(40), m)}[what]())
        rng.shuffle(parts)
        return "".join(parts)

    body = []
    for k, t in enumerate(paragraphs):
        tag = "h1" if k == 0 and len(t) < 150 else rng.choice(["p"] * 8 + ["h2", "blockquote"]) if len(t) < 90 else rng.choice(["p"] * 12 + ["div", "blockquote"])
        if rng.random() < 0.05 and k:
            body.append(f"<ul><li>{esc(t)}</li><li>{short(90)}</li></ul>")
        else:
            inner = esc(t) if rng.random() < .9 else f'{esc(t[:len(t) // 2])}<a href="#">{esc(t[len(t) // 2:len(t) // 2 + 12])}</a>{esc(t[len(t) // 2 + 12:])}'
            body.append(f"<{tag}>{inner}</{tag}>" if tag != "p" or rng.random() < .9 else f"<p>{inner}")
        if rng.random() < 0.15:
            body.append(around("inside"))
    main = "".join(body)
    words = ["post", "entry-content", "article-body", "story", "main-content", "text"]
    article = box(["article", "div", "section", "main", "div"], words, main, ' data-y="1"')
    if rng.random() < 0.4:
        article = box(["main", "div", "div"], ["container", "wrapper", "content", "page"], article + (around("side") if rng.random() < .5 else ""))
    return f"<html><body>{around('top')}{around('side')}{article}{around('side')}{around('end')}</body></html>"


MARKED = re.compile(r'(<(article|main)\b data-y="1"[^>]*>).*?(</\2\s*>|\Z)', re.S | re.I)


def _shortened(rng: random.Random, page: str, paragraphs: list[str]) -> str:
    """The page with only a few words left in its article: a short article is one still."""
    parts = [escape(t[:rng.randint(8, 90)], quote=False) for t in paragraphs[:rng.randint(1, 3)]]
    inner = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{t}</p>" for t in parts)
    return MARKED.sub(lambda m: m[1] + inner + m[3], page, count=1)


def fit(htmls: list[str], layouts: int = 4, seed: int = 7) -> Forest | None:
    """None if the sample holds no text at all; then every page's text is empty."""
    rng = random.Random(seed)
    sample = [_pieces(h) for h in htmls]
    others = [t for _, _, o in sample for t in o if t] + [t for _, a, _ in sample for t in a[1:]]
    pages = [Page(m, marks=True) for m, _, _ in sample if m]
    for marked, paragraphs, _ in sample:
        if paragraphs:
            if marked:
                pages.append(Page(_shortened(rng, marked, paragraphs), marks=True))
                # and an article with nothing around it
                bare = "".join(f"<p>{escape(t[:rng.randint(20, 400)], quote=False)}</p>" for t in paragraphs[:rng.randint(1, 4)])
                pages.append(Page(f'<article data-y="1">{bare}</article>', marks=True))
            pages += [Page(layout(rng, paragraphs, others, k % 2 == 0), marks=True) for k in range(layouts)]
    if not pages:
        return None
    x, text = features(pages)
    y, s = np.zeros(len(x)), 0
    for p in pages:  # article: inside a marked article, outside and free of marked others
        inside = np.zeros(len(p.tag), dtype=bool)
        mixed = np.zeros(len(p.tag), dtype=bool)
        for v in range(1, len(p.tag)):
            inside[v] = p.mark[v] == 1 or (p.mark[v] != 0 and inside[p.parent[v]])
        for v in range(len(p.tag) - 1, 0, -1):
            mixed[v] |= not inside[v]
            mixed[p.parent[v]] |= mixed[v]
        y[s:s + len(p.tag)] = inside & ~mixed
        s += len(p.tag)
    used = text > 0
    if not used.any():
        return None
    return boost(x[used], y[used], np.log1p(text[used]))


def train(pages: DataFrame, sample: int = 200, id_col: str = "page_id", html_col: str = "html",
          max_bytes: int = 65_536) -> Forest | None:
    """Fit on at most ``sample`` pages of at most ``max_bytes`` bytes, chosen by a hash. The
    smallest hashes are found first, without the pages; only pages up to the last of them are
    then fetched, so what the driver gets does not grow with the table."""
    rows = pages.select(F.col(id_col).alias("k"), F.col(html_col).alias("h")) \
        .where(F.col("h").isNotNull() & (F.octet_length("h") <= max_bytes)).withColumn("s", F.xxhash64("k", "h"))
    chosen = rows.select("s").orderBy("s").limit(sample).collect()
    if not chosen:
        return None
    got = rows.where(F.col("s") <= chosen[-1]["s"]).orderBy("s", "h").limit(sample).collect()
    return fit([r["h"] for r in got])


def extract(pages: DataFrame, forest: Forest | None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text ('' if none), n_chars of every page, map-only over whole pages.

    A null html is an empty page; null ids and urls stay null; repeated rows are all
    extracted; other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                htmls = part.column(2).to_pylist()
                texts = main_texts(htmls, forest) if forest is not None else [""] * len(htmls)
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)) \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extract_pages(pages: DataFrame, sample: int = 200) -> DataFrame:
    return extract(pages, train(pages, sample))

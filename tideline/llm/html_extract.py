"""Main text of web pages by gradient-boosted trees over the nodes of the page's tree.

Every block element gets features of itself, its subtree, its path and its siblings; boosted
trees say how likely its own text belongs to the article. Hierarchical decoding then
finds, from the leaves up, the consistent choice of the highest likelihood: what is
outside the article may hold it, what is inside may hold parts that are cut out, and
nothing below a cut is taken. The trees learn from a bounded sample of pages, those whose
markup names the article (article, main) first, and from copies of these pages with other markup,
so that they also know pages that name nothing. Sampled pages that name nothing give their
texts to made-up pages.
"""

from __future__ import annotations

import html
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.llm.common import map_arrow, query, slices, table, texts_of
from tideline.llm.html_tree import Node, parse, shown

#: Element names and words of attributes that say what a part of a page is for.
TAGS = ("article main section div p h1 h2 h3 h4 h5 h6 ul ol li nav header footer aside form table tr td th "
        "blockquote pre figure figcaption dl dt dd fieldset").split()
CHROME_TAGS = frozenset("nav header footer aside form fieldset menu dialog search".split())
ARTICLE_TAGS = frozenset("article main".split())
WORDS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager skip",
    "edge": "header masthead banner footer foot bottom copyright legal colophon top branding logo",
    "side": "side sidebar aside widget widgets related recommended rail trending popular tags tag share social follow more",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion dfp commercial",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay banner subscribe newsletter signup login paywall",
    "comments": "comment comments reply replies respond discussion disqus commentlist reader feedback",
    "form": "form search searchbox contact input poll survey",
    "article": "article main content post entry story body text page blog news articlebody prose",
}
_WORD_SETS = {k: frozenset(v.split()) for k, v in WORDS.items()}
_TAG_INDEX = {t: k for k, t in enumerate(TAGS)}
N_FEATURES = 22 + 2 * len(WORDS)
#: Texts of made-up pages where the sample has none, and the least number of such pages without named ones.
FILLER = ["The quick brown fox jumps over the lazy dog, and the dog sleeps on.", "It rained for days. Then, at last, it was dry."]
MADE_UP = 60


@dataclass
class Page:
    nodes: list[Node]
    features: np.ndarray
    own: list[int]  # characters of each node's own text


def page_of(source: str) -> Page:
    """The page's nodes with one row of features each."""
    nodes = parse(source)
    n = len(nodes)
    own = [sum(len(shown(i)) for i in x.items if isinstance(i, str)) for x in nodes]
    size, linked, below = own[:], [min(x.linked, max(o, x.linked)) for x, o in zip(nodes, own)], [1] * n
    marks = [own[k] and sum(i.count(".") + i.count(",") for i in x.items if isinstance(i, str)) for k, x in enumerate(nodes)]
    texts = [int(o > 0) for o in own]
    for k in range(n - 1, 0, -1):  # children come after their parents
        up = nodes[k].parent
        size[up] += size[k]
        linked[up] += linked[k]
        below[up] += below[k]
        marks[up] += marks[k]
        texts[up] += texts[k]
    kinds = [[bool(words.intersection(x.tokens)) for words in _WORD_SETS.values()] for x in nodes]
    chrome = [x.tag in CHROME_TAGS for x in nodes]
    article = [x.tag in ARTICLE_TAGS for x in nodes]
    path_kinds, path_chrome, path_article = [kinds[0]], [0], [0]
    children: list[list[int]] = [[i for i in x.items if isinstance(i, int)] for x in nodes]
    place = [0] * n
    for x in children:
        for k, child in enumerate(x):
            place[child] = k
    for k in range(1, n):
        up = nodes[k].parent
        path_kinds.append([a or b for a, b in zip(path_kinds[up], kinds[up])])
        path_chrome.append(path_chrome[up] + chrome[up])
        path_article.append(path_article[up] + article[up])
    total = max(size[0], 1)
    before, seen = [0] * n, 0
    for k in range(n):
        before[k] = seen
        seen += own[k]
    tags = [Counter(nodes[c].tag for c in x) for x in children]
    sizes = [sum(size[c] for c in x) for x in children]
    rows = np.zeros((n, N_FEATURES), np.float32)
    for k, x in enumerate(nodes):
        up = max(x.parent, 0)
        siblings = len(children[up]) if k else 1
        same, beside = (tags[up][x.tag], sizes[up]) if k else (1, size[0])
        rows[k] = [
            _TAG_INDEX.get(x.tag, -1), x.depth, own[k], size[k], size[k] / total, below[k], size[k] / below[k],
            linked[k] / max(size[k], 1), marks[k] / max(size[k], 1), texts[k], x.inline, place[k], siblings,
            place[k] / max(siblings - 1, 1), same / siblings, beside / siblings, before[k] / total, _TAG_INDEX.get(nodes[up].tag, -1),
            path_chrome[k] + chrome[k], path_article[k] + article[k], chrome[k], len(x.tokens),
            *kinds[k], *path_kinds[k],
        ]
    return Page(nodes, rows, own)


@dataclass
class Trees:
    """Boosted trees of a fixed depth: per tree the features, cuts and leaf values."""
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        levels = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(levels):
                node = 2 * node + 1 + (rows[each, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def boost(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_trees: int = 40, levels: int = 4,
          rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss, with second-order leaf values and binned features."""
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    rate_of = np.clip(np.average(labels, weights=weights), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    score = np.full(len(rows), base)
    inner, leaves = (1 << levels) - 1, 1 << levels
    out = Trees(np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves)), base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weights * (labels - p), weights * p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        for level in range(levels):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            where = (node - first) * bins
            for f in range(rows.shape[1]):
                at = where + binned[:, f]
                gl = np.cumsum(np.bincount(at, g, width * bins).reshape(width, bins), axis=1)
                hl = np.cumsum(np.bincount(at, h, width * bins).reshape(width, bins), axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                gain = gain[:, :len(cuts[f])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best = np.where(better, top, best)
                out.feature[t, first:first + width][better] = f
                out.cut[t, first:first + width][better] = cuts[f][k][better]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), out.feature[t, node]] > out.cut[t, node])
        node -= inner
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        out.leaf[t] = rate * gs / (hs + ridge)
        score += out.leaf[t][node]
    return out


def named_article(nodes: list[Node]) -> np.ndarray:
    """For each node 1 if the page's markup puts its text into the article, else 0."""
    out = np.zeros(len(nodes), np.int64)
    for k, x in enumerate(nodes[1:], 1):
        up = out[x.parent]
        cut = x.tag in CHROME_TAGS or any(
            _WORD_SETS[w].intersection(x.tokens) for w in ("menu", "side", "advert", "notice", "comments", "form"))
        out[k] = (up or x.tag in ARTICLE_TAGS) and not (cut and x.tag not in ARTICLE_TAGS)
    return out


def other_markup(source: str, spare: list[str], random: np.random.Generator) -> str | None:
    """A page with the same article in other markup and more parts around and inside it, or None.

    The parts take their words from ``spare``, texts of other pages. data-main and data-cut
    mark the truth for training; the reader of attributes doesn't see them.
    """
    import re

    start, end = re.search(r"<article\b[^>]*>", source), source.rfind("</article>")
    if not start or end < start.end():
        return None
    inner = source[start.end(): end]
    pick = lambda options: options[int(random.integers(len(options)))]
    say = lambda: pick(spare)[: int(random.integers(20, 400))]
    wrap = pick(["<div class=\"{}\">".format(w) for w in ("content", "post-body", "entry", "story text", "main", "c1", "col")]
                + ["<article>", "<main>", "<section>", "<div>", "<div id=\"x7\">", "<article class=\"post\">"])
    name = wrap[1:].split()[0].strip(">")
    links = lambda n: "".join(f"<li><a href=\"/\">{say()[:15]}</a></li>" for _ in range(n))
    around = {
        "head": [f"<header><p>{say()[:60]}</p></header>", f"<div class=\"masthead\"><p>{say()[:40]}</p></div>", ""],
        "nav": [f"<nav><ul>{links(6)}</ul></nav>", f"<div class=\"menu\"><ul>{links(8)}</ul></div>", f"<ul>{links(7)}</ul>"],
        "before": [f"<div class=\"cookie-notice\"><p>{say()}</p></div>", f"<div class=\"ad\">{say()}</div>",
                   f"<form><p>{say()[:50]}</p><input></form>", ""],
        "after": [f"<aside><h3>{say()[:30]}</h3><p>{say()}</p></aside>", f"<div class=\"sidebar\"><p>{say()}</p><ul>{links(4)}</ul></div>",
                  f"<div class=\"related\"><ul>{links(5)}</ul></div>", f"<div class=\"promo\">{say()}</div>", ""],
        "comments": ["<div class=\"comments\">" + "".join(
            f"<div class=\"comment\"><p>{say()}</p></div>" for _ in range(int(random.integers(1, 5)))) + "</div>",
            f"<section id=\"comments\"><h2>{say()[:20]}</h2><p>{say()}</p><p>{say()}</p></section>", "", ""],
        "foot": [f"<footer><p>{say()[:80]}</p></footer>", f"<div class=\"footer\">{say()[:80]}</div>", f"<footer>{say()[:60]}</footer>"],
    }
    island = pick([f"<div class=\"advert\">{say()}</div>", f"<aside><p>{say()}</p></aside>",
                   f"<form><p>{say()[:60]}</p></form>", f"<div class=\"share\"><ul>{links(3)}</ul></div>", "", ""])
    spots = [m.start() for m in re.finditer(r"<p>", inner)]
    if island and spots:
        at = pick(spots)
        inner = inner[:at] + island.replace(">", " data-cut>", 1) + inner[at:]
    body = "".join([pick(around["head"]), pick(around["nav"]), pick(around["before"]), wrap.replace(">", " data-main>", 1),
                    inner, f"</{name}>", pick(around["comments"]), pick(around["after"]), pick(around["foot"])])
    return f"<html><body>{body}</body></html>"


def _marked_truth(source: str) -> np.ndarray:
    """Labels of a page made by ``other_markup``."""
    seen = parse(source.replace(" data-main>", " role=\"qmain\">").replace(" data-cut>", " role=\"qcut\">"))
    out = np.zeros(len(seen), np.int64)
    for k, x in enumerate(seen[1:], 1):
        out[k] = (out[x.parent] or "qmain" in x.tokens) and "qcut" not in x.tokens
    return out


def texts_in(source: str) -> list[str]:
    """The texts of over 20 characters of a page."""
    return [shown(i) for x in parse(source) for i in x.items if isinstance(i, str) and len(shown(i)) > 20]


def fit(pages: list[str], seed: int = 11, copies: int = 2) -> Trees | None:
    """Trees from pages that name their article, and from made-up pages with the texts of those that don't."""
    random = np.random.default_rng(seed)
    named, plain = [], []
    for source in pages:
        (named if any(x.tag in ARTICLE_TAGS for x in parse(source)) else plain).append(source)
    spare = [t for p in pages for t in texts_in(p)]
    if not named:
        spare = spare or FILLER
        plain = [(plain or [""])[k % max(len(plain), 1)] for k in range(max(len(plain), MADE_UP))]
    rows, labels, weights = [], [], []

    def add(page: Page, truth: np.ndarray) -> None:
        rows.append(page.features)
        labels.append(truth)
        weights.append(np.minimum(1 + np.sqrt(np.array(page.own, float)) / 4, 8) * (np.array(page.own) > 0))

    for source in named:
        page = page_of(source)
        add(page, named_article(page.nodes))
        for _ in range(copies if spare else 0):
            if changed := other_markup(source, spare, random):
                add(page_of(changed), _marked_truth(changed))
    for source in plain if spare else []:
        blocks = "".join(f"<p>{html.escape(t)}</p>" for t in texts_in(source) or FILLER)
        for _ in range(copies + 1):
            changed = other_markup(f"<article>{blocks}</article>", [html.escape(t) for t in spare], random)
            add(page_of(changed), _marked_truth(changed))
    if not rows:
        return None
    y, w = np.concatenate(labels), np.concatenate(weights)
    if not (w[y == 1].sum() and w[y == 0].sum()):
        return None
    return boost(np.concatenate(rows), y, w)


OUTSIDE, INSIDE, CUT = 0, 1, 2
_NEXT = {OUTSIDE: (OUTSIDE, INSIDE, CUT), INSIDE: (INSIDE, CUT), CUT: (CUT,)}


def decode(nodes: list[Node], own: list[int], logits: np.ndarray) -> list[int]:
    """The state of each node: outside the article, inside it, or cut with all below.

    Maximizes the log-likelihood of the nodes that have text. Only inside is text kept.
    """
    n = len(nodes)
    yes, no = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
    yes, no = yes.tolist(), no.tolist()
    value = [[no[k] if own[k] else 0.0, yes[k] if own[k] else 0.0, no[k] if own[k] else 0.0] for k in range(n)]
    choice = [[OUTSIDE, INSIDE, CUT] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        up, mine = value[nodes[k].parent], value[k]
        for state, options in _NEXT.items():
            best = max(options, key=lambda s: mine[s])
            choice[k][state] = best
            up[state] += mine[best]
    states = [max((OUTSIDE, INSIDE), key=lambda s: value[0][s])]
    for k in range(1, n):
        states.append(choice[k][states[nodes[k].parent]])
    return states


def main_texts(sources: list[str], trees: Trees | None) -> list[str]:
    """The main text of each page; the trees run over the nodes of all of them at once."""
    pages = [page_of(source) for source in sources]
    if trees is None:
        return [written(p.nodes, [INSIDE if x else OUTSIDE for x in named_article(p.nodes)]) for p in pages]
    logits = trees.logits(np.concatenate([p.features for p in pages])) if pages else np.zeros(0)
    ends = np.cumsum([len(p.nodes) for p in pages])
    return [written(p.nodes, decode(p.nodes, p.own, part))
            for p, part in zip(pages, np.split(logits, ends[:-1]), strict=True)] if pages else []


def written(nodes: list[Node], states: list[int]) -> str:
    """The texts inside the article as blocks in page order, parted by empty lines."""
    out: list[str] = []
    todo: list = [0]
    while todo:  # page order, without recursion
        item = todo.pop()
        if isinstance(item, tuple):
            out.append(item[0])
            continue
        for x in reversed(nodes[item].items):
            if isinstance(x, int):
                todo.append(x)
            elif states[item] == INSIDE and (piece := shown(x)):
                todo.append((piece,))
    return "\n\n".join(out)


def training_pages(pages: DataFrame, sample_rows: int, longest: int, key: str = "page_id") -> list[str]:
    """At most ``sample_rows`` pages, named articles first, then by the hash of their key, none longer than ``longest``."""
    unnamed = ~F.col("html").rlike(rf"(?i)<({'|'.join(sorted(ARTICLE_TAGS))})[\s/>]")
    drawn = pages.where(F.length("html") <= longest).withColumn(
        "_draw", F.struct(unnamed.alias("unnamed"), F.xxhash64(F.col(key), F.col("html")).alias("hash")))
    picked = drawn.select("_draw").orderBy("_draw").limit(sample_rows)  # numbers alone, before any page is sent
    rows = drawn.join(F.broadcast(picked.distinct()), "_draw").select("html").dropDuplicates().limit(sample_rows).collect()
    return sorted(r["html"] for r in rows)


def extract(pages: DataFrame, sample_rows: int = 200, longest: int = 50_000, key: str = "page_id") -> DataFrame:
    """``pages`` without html, with text (the main text) and n_chars.

    Trained on the driver on at most ``sample_rows`` pages of at most ``longest`` characters (by the hash of the key, so
    ties and repeated rows don't matter), applied to every whole page; the reader takes time in proportion to a page's length, and
    a task holds the tree of its longest page. Null and empty pages have an empty text. Where few or no pages name
    their article, made-up pages with the texts of sampled ones are learnt from. Every row gives one row, repeated ones
    too; other columns pass through; columns named like an output are replaced; an empty table gives an empty table.
    """
    model = pages.sparkSession.sparkContext.broadcast(pickle.dumps(fit(training_pages(pages, sample_rows, longest, key))))
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "trees" not in cache:
            cache["trees"] = pickle.loads(model.value)
        for batch in slices(batches, "html"):
            texts = main_texts(texts_of(batch, "html"), cache["trees"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*kept, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    return map_arrow(pages.select(*[f"`{c}`" for c in kept], F.col("html").cast("string").alias("html")), run, schema)


@query("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

"""Main text of pages: gradient-boosted trees over DOM nodes, decoded by hierarchy.

A page is a tree of block elements whose leaves are runs of text. The trees give each node
the probability that it is, or holds, main text, from its subtree's density, links and
punctuation, its tag and those above, words of class, id and role here and above, its depth
and its siblings. Decoding takes the most likely choice for the whole tree under the rule
that nothing below a dropped node is kept, so an ancestor and a descendant never contradict
each other.

The model is fitted in each run on a bounded sample: at most ``SAMPLE_PAGES`` pages of at
most ``SAMPLE_CHARS`` characters, those least by a hash of the page_id. Their leaves are
labelled by the page's own article element; besides, their texts are set in layouts made by
chance, with menus, headers, sidebars, notices, adverts, forms, comments and footers around
and inside, in which the main text is known.

Defined cases: null or empty html gives an empty text; repeated rows are extracted one by
one; an empty table gives an empty result; columns other than the named ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.boosting import BoostedTrees
from eventloom.llm.common import table
from eventloom.llm.dom import _ATTR_BIT, _TAG, Forest

SAMPLE_PAGES = 240
SAMPLE_CHARS = 20_000
LAYOUTS = 4
SEED = 5
#: Pages parsed together: so many, or as many as have so many characters.
CHUNK_PAGES, CHUNK_CHARS = 200, 2_000_000
_MAIN = ""

_NEVER = sum(1 << _TAG[t] for t in ("nav", "header", "footer", "aside", "form"))
_ARTICLE = 1 << _TAG["article"]
_NEVER_WORDS = ~_ATTR_BIT["article"]


def _marked(leaf_texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and _MAIN in t for t in leaf_texts])


def _holds(forest: Forest, leaf: np.ndarray) -> np.ndarray:
    """Whether a node is, or holds, a leaf of ``leaf``."""
    total = np.concatenate([[0], np.cumsum(leaf)])
    return total[np.array(forest.end)] > total[: len(leaf)]


def _own_labels(forest: Forest) -> np.ndarray:
    above, attrs = np.array(forest.above) | np.array(forest.tags), np.array(forest.attrs_above) | np.array(forest.attrs)
    leaf = np.array([t is not None for t in forest.texts])
    return leaf & ((above & _ARTICLE) > 0) & ((above & _NEVER) == 0) & ((attrs & _NEVER_WORDS) == 0)


class _Layouts:
    """Pages made by chance from a pool of texts; main text starts with a mark."""

    def __init__(self, pool: list[str], rng: np.random.Generator):
        self.pool, self.rng = pool, rng
        self.words = [w for t in pool[:200] for w in t.split()[:50] if "<" not in w and "&" not in w] or ["word"]

    def pick(self, *options: str) -> str:
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def some(self, lo: int, hi: int) -> str:
        return " ".join(self.words[i] for i in self.rng.integers(len(self.words), size=self.rng.integers(lo, hi + 1)))

    def text(self) -> str:
        return self.pool[self.rng.integers(len(self.pool))]

    def links(self, lo: int, hi: int) -> str:
        made = [f'<a href="/{i}">{self.some(1, 4)}</a>' for i in range(self.rng.integers(lo, hi + 1))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>" if self.chance(0.7) else self.pick(" | ", " ", "<br>").join(made)

    def box(self, tags: str, words: str, body: str, plain: float = 0.15) -> str:
        """One of the tags with one of the words as its class or id; a tag of its own needs none."""
        tag = self.pick(*tags.split())
        bare = self.chance(0.5 if tag not in ("div", "section", "p", "ul", "span", "ol") else plain)
        word = self.pick(*words.split())
        word = self.pick(word, word, f"{self.pick('site', 'page', 'main', 'block', 'c')}-{word}", f"{word}-{self.pick('box', 'wrap', 'area', 'block')}")
        return f"<{tag}>{body}</{tag}>" if bare else f'<{tag} {self.pick("class", "class", "id")}="{word}">{body}</{tag}>'

    def comment(self) -> str:
        said = f"<p>{self.text()}</p>" if self.chance(0.7) else f"<div>{self.some(3, 40)}</div>"
        return self.box("div li section", "comment reply reader", f"<b>{self.some(1, 2)}</b> {said}", 0.5)

    def aside(self) -> str:
        kind = self.rng.integers(7)
        if kind == 0:
            return self.box("div ins aside p", "ad ads advert advertisement sponsored promo banner", self.some(3, 30) if self.chance(0.7) else self.links(1, 4))
        if kind == 1:
            return self.box("div p section", "notice cookie consent alert newsletter subscribe disclaimer warning", self.some(4, 40) + self.pick("", " <button>OK</button>"))
        if kind == 2:
            return self.box("aside div", "sidebar related recommended popular widget", f"<h3>{self.some(1, 3)}</h3>{self.links(2, 8)}" + self.pick("", f"<p>{self.some(5, 40)}</p>"))
        if kind == 3:
            return f'<form action="/s">{self.some(1, 12)}<label>{self.some(1, 3)}</label><input name="q"><button>{self.some(1, 2)}</button></form>'
        if kind == 4:
            return self.box("div ul", "share social buttons follow", self.links(2, 5))
        if kind == 5:
            return self.box("nav div ul", "nav menu breadcrumb navigation", self.links(2, 10))
        return self.box("aside div", "sidebar aside side widget", f"<p>{self.text()}</p>" if self.chance(0.5) else f"<p>{self.some(5, 60)}</p>")

    def page(self, main: list[str]) -> str:
        if not self.chance(0.8):
            main = main[:1]
        blocks = []
        for i, text in enumerate(main):
            tag = "h1" if i == 0 and self.chance(0.7) else self.pick("p", "p", "p", "p", "div", "blockquote", "h2", "h3", "li")
            if tag in ("h2", "h3") or self.chance(0.1):
                text = self.some(1, 12)
            text = _MAIN + text
            if self.chance(0.1):
                text += f' <a href="/x">{self.some(1, 3)}</a> {self.some(1, 6)}'
            block = f"<{tag}>{text}</{tag}>" if self.chance(0.85) or tag in ("div", "li") else f"<{tag}>{text}"
            blocks.append(f"<ul>{block}</ul>" if tag == "li" else block)
            if self.chance(0.12):
                blocks.append(self.aside())
        body = "".join(blocks)
        for _ in range(self.rng.integers(0, 3)):
            body = self.box("div section", "wrap inner container content body", body, 0.5)
        body = self.box("article article main div div section", "article content post entry story main text", body, 0.3)
        before = [self.box("header div", "header masthead topbar branding", f"<h1>{self.some(1, 4)}</h1><p>{self.some(2, 12)}</p>")] if self.chance(0.7) else []
        before += [self.box("nav div ul", "nav menu navigation navbar", self.links(3, 12))] if self.chance(0.8) else []
        before += [self.aside() for _ in range(self.rng.integers(0, 3))]
        after = [self.box("section div ol", "comments commentlist discussion replies", f"<h2>{self.some(1, 3)}</h2>" + "".join(self.comment() for _ in range(self.rng.integers(1, 6))), 0.05)] if self.chance(0.5) else []
        after += [self.aside() for _ in range(self.rng.integers(0, 3))]
        after += [self.box("footer div", "footer copyright legal bottom", f"<p>&copy; {self.some(2, 20)}</p>" + self.pick("", self.links(2, 6)))] if self.chance(0.85) else []
        if self.chance(0.2):
            before, after = after[:-1] + before, after[-1:]
        return "<html><body>" + "".join(before) + body + "".join(after) + "</body></html>"


def fit_extractor(pages: list[tuple[int, str]], seed: int = SEED) -> BoostedTrees:
    """The model for a bounded list of (page_id, html)."""
    own = Forest()
    mains: list[list[str]] = []
    for _, page in pages:
        first = len(own.parent)
        own.add(page)
        texts = [(t, i) for i, t in enumerate(own.texts[first:], first) if t]
        part = _own_labels(own)
        mains.append([t for t, i in texts if part[i]] or [t for t, _ in texts])
    rng = np.random.default_rng(seed)
    mains = [[t.replace("&", "&amp;").replace("<", "&lt;") for t in m] for m in mains if m]
    if not mains:
        mains = [["".join(chr(97 + c) for c in rng.integers(26, size=5)) + " word, and words." * 10] * 3]
    layouts = _Layouts([t for m in mains for t in m], rng)
    made = Forest()
    for k in range(LAYOUTS * max(60, len(mains))):
        made.add(layouts.page(mains[k % len(mains)]))
    labelled = [(made.features(), _holds(made, _marked(made.texts)))]
    if own.parent:
        labelled.append((own.features(), _holds(own, _own_labels(own))))
    x, y = np.concatenate([a for a, _ in labelled]), np.concatenate([b for _, b in labelled])
    return BoostedTrees().fit(x, y.astype(np.float64))


def decode(forest: Forest, probability: np.ndarray) -> np.ndarray:
    """The likeliest choice of kept nodes such that nothing below a dropped one is kept."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    # A leaf counts by its text, so that a long paragraph isn't lost to a row of short neighbours.
    weight = np.array([1.0 if t is None else 1 + np.log1p(len(t)) for t in forest.texts])
    keep, drop = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
    parent = forest.parent
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            keep[parent[i]] += max(keep[i], drop[i])
            drop[parent[i]] += drop[i]
    kept = np.zeros(len(parent), bool)
    for i, up in enumerate(parent):
        # The root stands for the page and is no choice.
        kept[i] = up < 0 or (kept[up] and keep[i] >= drop[i])
    return kept


def main_texts(pages: list[str], model: BoostedTrees) -> list[str]:
    forest = Forest()
    for page in pages:
        forest.add(page)
    kept = decode(forest, model.predict(forest.features()))
    ends = [*forest.roots[1:], len(forest.parent)]
    return [" ".join(t for i, t in enumerate(forest.texts[a:b], a) if t and kept[i]) for a, b in zip(forest.roots, ends, strict=True)]


def extract_main_text(pages: DataFrame, seed: int = SEED) -> DataFrame:
    """page_id, url, text, n_chars: one row a page."""
    fit = pages.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    fit = fit.select("page_id", "html", F.xxhash64("page_id", F.lit(seed)).alias("__h"))
    # First the least hashes alone: else every partition would send its own best pages whole.
    hashes = [r["__h"] for r in fit.select("__h").orderBy("__h").limit(SAMPLE_PAGES).collect()]
    few = fit.where(F.col("__h") <= (max(hashes) if hashes else 0)).orderBy("__h", "page_id", F.xxhash64("html")).limit(SAMPLE_PAGES).collect()
    model = pages.sparkSession.sparkContext.broadcast(fit_extractor([(r["page_id"], r["html"]) for r in few], seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                group, chars = [], 0
                while at + len(group) < batch.num_rows and len(group) < CHUNK_PAGES and chars < CHUNK_CHARS:
                    group.append(batch.column(2)[at + len(group)].as_py() or "")
                    chars += len(group[-1])
                texts = main_texts(group, model.value)
                rows = batch.slice(at, len(group))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )
                at += len(group)

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))

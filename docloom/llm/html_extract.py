"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page's DOM.

A leaf block is a run of text between block-level boundaries. Its features are its
ancestors' tags, the words of their class and id attributes, and the text's shape; the CRF
is trained on labelled pages and decoded by Viterbi, and the blocks marked as content are
joined in page order. Text inside scripts, styles, templates, the head and form controls
is never a block; formulas belong to the block around them.

Labelled pages mark elements with data-main="1" or "0". Where no labelled collection is
given, ``labelled_pages`` writes one from page templates with a fixed seed.

Defined cases: a null or empty page, or one without content blocks, has empty text;
broken markup is read as ``markup.tokens`` defines; repeated rows are extracted alike; very
long or deep pages are extracted whole, in time linear in their size; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import crf
from docloom.llm.markup import attributes, tokens
from docloom.llm.tokens import slices

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template textarea select datalist head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace semantics annotation".split())

HEAD = frozenset("html head title base link meta script style template noscript".split())
#: Elements that a start tag closes, and those that such a close does not reach beyond.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = ("ul", "ol", "dl", "table", "div", "section", "article")
P_STOPS = ("div", "td", "li", "section", "article", "blockquote")

SIZE = 1 << 13
#: Pages that are extracted at once.
SLICE_BYTES = 2 << 20


@dataclass
class Page:
    """Leaf blocks of a page. A block's features are its own and those of its chain of ancestors;
    a chain node holds the features that its ancestors lack, so deep pages stay linear."""

    texts: list[str]
    labels: list[str | None]
    chains: list[int]
    own: list[list[int]]
    parents: list[int]
    added: list[list[int]]

    def chain(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out += self.added[node]
            node = self.parents[node]
        return out


#: An open element: tag, chain node, last names, innermost block tag, label, and the slots it counts.
_Open = tuple[str, int, tuple[str, ...], str, str | None, list[int]]


class _Parser:
    def __init__(self) -> None:
        self.page = Page([], [], [], [], [-1], [[]])
        self.stack: list[_Open] = [("", 0, (), "", None, [])]
        self.open: dict[str, list[int]] = {}
        self.counted: dict[int, int] = {}
        self.hidden = self.links = self.linked = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, node, near, leaf, label, _ = self.stack[-1]
                page = self.page
                own = {
                    f"leaf={leaf}",
                    f"words={min((text.count(' ') + 1).bit_length(), 8)}",
                    f"links={min(4, 5 * self.linked // len(text))}",
                    f"stop={text[-1] if text[-1] in '.!?:,;' else ''}",
                    f"mark={'©' in text or '|' in text or '·' in text or '»' in text}",
                    "bias",
                    *(f"near={w}" for w in near),
                }
                page.texts.append(text)
                page.labels.append(label)
                page.chains.append(node)
                page.own.append([crf.slot(f, SIZE) for f in sorted(own)])
            self.parts, self.linked = [], 0

    def start(self, tag: str, inside: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        inline = tag in INLINE
        if not inline:
            self.flush()
            if tag not in HEAD and self.open.get("head"):
                self.pop_to("head")
            if tag == "body":
                while self.stack[-1][0] not in ("", "html"):
                    self.pop()
            if tag not in VOID and self.open.get("p"):
                self.close(("p",), P_STOPS)
            if tag in CLOSES:
                self.close(CLOSES[tag], STOPS)
        if tag in VOID:
            return
        found = attributes(inside) if inside else {}
        _, node, near, leaf, label, _ = self.stack[-1]
        slots: list[int] = []
        if not inline:
            names = [w for k in ("class", "id", "role") if k in found for w in re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", found[k]).lower())]
            slots = list({crf.slot(f, SIZE) for f in (f"in={tag}", *(f"name={w}" for w in names), *(f"stem={w[:7]}" for w in names))})
            added = [s for s in slots if not self.counted.get(s)]
            for s in slots:
                self.counted[s] = self.counted.get(s, 0) + 1
            if added:
                self.page.parents.append(node)
                self.page.added.append(added)
                node = len(self.page.parents) - 1
            near, leaf = (*near, *names)[-3:], tag
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node, near, leaf, found.get("data-main", label), slots))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def pop(self) -> None:
        tag, *_, slots = self.stack.pop()
        self.open[tag].pop()
        for s in slots:
            self.counted[s] -= 1
        self.hidden -= tag in HIDDEN
        self.links -= tag == "a"

    def pop_to(self, tag: str) -> None:
        at = self.open[tag][-1]
        while len(self.stack) > at:
            self.pop()

    def last(self, tags: tuple[str, ...]) -> int:
        return max((own[-1] for t in tags if (own := self.open.get(t))), default=0)

    def close(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Close the innermost of some tags unless a stop lies inside it."""
        at = self.last(tags)
        if at > self.last(stops):
            while len(self.stack) > at:
                self.pop()

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.open.get(tag):
            self.pop_to(tag)

    def text(self, data: str) -> None:
        if self.stack[-1][0] == "head" and not data.isspace():
            self.pop()
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> Page:
    parser = _Parser()
    for kind, name, inside in tokens(html or ""):
        if kind == "text":
            parser.text(name)
        elif kind == "start":
            parser.start(name, inside)
        else:
            parser.end(name)
    parser.flush()
    page = parser.page
    for k, own in enumerate(page.own):
        own.append(crf.slot(f"place={'first' if k == 0 else 'last' if k == len(page.own) - 1 else ''}", SIZE))
    return page


def features(page: Page) -> crf.Ragged:
    """All feature indices of every block, its chain's included; for pages that models train on."""
    rows = [own + page.chain(node) for own, node in zip(page.own, page.chains, strict=True)]
    return crf.Ragged(np.array([f for r in rows for f in r], np.int32), np.array([len(r) for r in rows], np.int32))


def scores(pages: list[Page], model: crf.Crf) -> np.ndarray:
    """Label scores of all blocks of the pages; every chain node is summed once."""

    def sums(lists: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((f for own in lists for f in own), np.int64, int(sizes.sum()))
        out, some = np.zeros((len(lists), 2)), sizes > 0
        if some.any():
            out[some] = np.add.reduceat(model.weights[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        return out

    chain = sums([a for p in pages for a in p.added]).tolist()
    at, node = 0, []
    for p in pages:
        for k in range(1, len(p.parents)):  # a parent comes before its children
            up, own = chain[at + p.parents[k]], chain[at + k]
            own[0] += up[0]
            own[1] += up[1]
        node += [at + c for c in p.chains]
        at += len(p.parents)
    return sums([o for p in pages for o in p.own]) + np.array(chain).reshape(-1, 2)[np.array(node, np.int64)]


# Names that page templates commonly give to the parts of a page.
CONTENT_NAMES = "content main article post entry body story text page post-content entry-content article-body article-content story-body main-content prose".split()
OTHER_NAMES = {
    "menu": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs toc skip".split(),
    "header": "header masthead top site-header banner logo branding hero-header page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon foot imprint".split(),
    "sidebar": "sidebar aside widget related recommended rail secondary side popular trending tags".split(),
    "notice": "cookie cookies consent notice alert gdpr banner-notice popup modal overlay paywall warning message".split(),
    "advert": "ad ads advert advertisement sponsored promo promotion adsense ad-slot banner-ad partner commercial".split(),
    "form": "form search subscribe newsletter login signup contact search-form".split(),
    "comments": "comments comment comment-list commentlist replies discussion responses comment-body disqus reply".split(),
    "share": "share social sharing follow share-buttons socials".split(),
}
OTHER_TAGS = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "aside"), "advert": ("div", "aside", "ins", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul")}


def labelled_pages(n: int = 500, seed: int = 11) -> list[str]:
    """Pages from templates, every content block under data-main="1", the others under "0"."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        out = ["".join(rng.choices("abcdefghilmnoprstuväéñ", k=rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
        return " ".join(out) + rng.choice(["", ".", ".", "!", "..."])

    def linked(text: str) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{text}</a>'

    def named(kind: list[str], chance: float) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(kind)}"' if rng.random() < chance else ""

    def other(kind: str, inside: bool = False) -> str:
        tags = OTHER_TAGS[kind]
        tag = rng.choice(tags)
        plain = tag in ("div", "section", "ol", "ul", "ins") or inside
        inner = []
        for _ in range(rng.randint(1, 6 if kind in ("menu", "sidebar", "comments", "footer") else 2)):
            if kind in ("menu", "share"):
                inner.append(f"<li>{linked(words(1, 3))}</li>")
            elif kind == "form":
                inner.append(f"<label>{words(1, 4)}</label><input type=text><button>{words(1, 2)}</button>")
            elif kind == "comments":
                inner.append(rng.choice(["<p>{}</p>", "<li><p>{}</p></li>", '<article class="comment"><p>{}</p></article>', '<div class="comment"><h4>name</h4>{}</div>']).format(words(3, 60)))
            elif kind == "footer":
                inner.append(rng.choice(["&copy; {}", "<p>{}</p>", "{} &middot; x"]).format(words(1, 14)))
            elif kind == "sidebar":
                inner.append(rng.choice(["<h3>{}</h3>", "<li><a href='/'>{}</a></li>", "<p>{}</p>"]).format(words(2, 25)))
            else:
                inner.append(rng.choice(["<p>{}</p>", "{}", "<span>{}</span>", "<h2>{}</h2>"]).format(words(2, 40)))
        return f'<{tag}{named(OTHER_NAMES[kind], 1.0 if plain else 0.4)} data-main="0">{"".join(inner)}</{tag}>'

    def content(k: int) -> str:
        kind = rng.random()
        if k == 0 and rng.random() < 0.8:
            return rng.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(words(1, 12))
        if kind < 0.68:
            text = words(1, 6) if rng.random() < 0.2 else words(8, 120)
            return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>"]).format(text)
        if kind < 0.76:
            return f"<h2>{words(1, 8)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{words(1, 14)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{words(4, 40)}</p></blockquote>"
        if kind < 0.96:
            return f"<p>{words(2, 20)} {linked(words(1, 4))} {words(2, 20)}</p>"
        return rng.choice(["<figure><figcaption>{}</figcaption></figure>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>"]).format(words(1, 25))

    pages = []
    for _ in range(n):
        kinds = list(OTHER_NAMES)
        before = [other(k) for k in rng.sample(["menu", "header", "notice", "advert", "form", "menu"], rng.randint(0, 4))]
        after = [other(k) for k in rng.sample(["footer", "sidebar", "comments", "share", "advert", "form", "notice"], rng.randint(0, 5))]
        main = []
        for k in range(rng.randint(1, 14)):
            main.append(content(k))
            if rng.random() < 0.12:
                main.append(other(rng.choice([k for k in kinds if k not in ("header", "menu")]), True))
        if rng.random() < 0.25:
            main.append(other(rng.choice(["comments", "share", "form"]), True))
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        mark = named(CONTENT_NAMES, 0.95 if tag in ("div", "section") else 0.3)
        body = f'<{tag}{mark} data-main="1">{"".join(main)}</{tag}>'
        if rng.random() < 0.4:
            body = f"<{(wrap := rng.choice(['main', 'div']))}{named(['wrapper', 'container', 'content', 'layout', 'site'], 0.8)}>{body}{''.join(after)}</{wrap}>"
            after = []
        pages.append(f'<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var t="</p>";</script></head><body data-main="0">{"".join(before)}{body}{"".join(after)}</body></html>')
    return pages


def fit(pages: list[str] | None = None) -> crf.Crf:
    """Train on labelled pages; by default those of ``labelled_pages``, once a session."""
    return _fit(tuple(pages)) if pages else _default()


def _fit(pages: tuple[str, ...]) -> crf.Crf:
    found = [blocks(p) for p in pages]
    rows = crf.Ragged.join([features(f) for f in found])
    labels = np.array([m == "1" for f in found for m in f.labels], np.int64)
    return crf.train(rows, labels, [len(f.texts) for f in found], SIZE)


@functools.cache
def _default() -> crf.Crf:
    return _fit(tuple(labelled_pages()))


def extract(html: list[str | None], model: crf.Crf) -> list[str]:
    """Main texts of several pages."""
    found = [blocks(h) for h in html]
    label = model.viterbi(scores(found, model), [len(f.texts) for f in found]).tolist()
    out, at = [], 0
    for own in found:
        out.append(" ".join(t for t, keep in zip(own.texts, label[at : at + len(own.texts)], strict=True) if keep))
        at += len(own.texts)
    return out


def extract_table(pages: DataFrame, model: crf.Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                text = extract(part.column(2).to_pylist(), model)
                arrays = [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(run, f"page_id {narrow.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")

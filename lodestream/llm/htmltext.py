"""Operator 4: main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is read in one pass into leaf blocks: the texts between block-level tags, each
with what its ancestors' tags, classes, ids and roles say, the share of linked text and
features of the text itself.  The field is trained on labelled pages (html_pages.py
makes TRAIN_PAGES of them, bare articles and pages whose parts have no telling names among them; fit() takes any)
and decoded by Viterbi over each page.

Defined results: null and empty pages give an empty text; scripts, styles, templates,
inline frames, form controls and titles never give text; an end tag without a start is
passed over, an unclosed element ends with its parent; a `<` that no tag follows is text,
and so is a tag without its `>`; an unclosed comment or script runs to the end.  Time is
linear in a page's length, whatever it holds.  Of equally likely labellings Viterbi takes
the one with less text.  Repeated rows and ids are extracted each for itself, null ids
are kept, other columns of the table are neither read nor returned."""

from __future__ import annotations

import functools
import html as _html
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import textkernel as tk
from lodestream.llm.common import require
from lodestream.llm.crf import LinearChainCRF
from lodestream.llm.html_pages import MAIN, REST, training_pages

TRAIN_PAGES = 900
#: Bytes of pages, and leaf blocks, that are handled at a time; a longer page by itself.
PAGE_BYTES, STEP = 2 << 20, 8192

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul label".split())
#: What is in these isn't text of the page.
_RAW = frozenset("script style template iframe textarea select button title".split())
#: An inline end tag doesn't reach out of these.
_WALLS = frozenset("td th article body main nav footer aside".split())
#: An opening tag of the key ends an open element of these, up to the barrier.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_P_ENDERS = _BLOCK - {"label", "option", "optgroup", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "title"}

_TAGS = "article main section nav header footer aside form ul ol li table td div p h1 h2 h3 a b figure figcaption blockquote pre label dl address details dialog span".split()
_NAMES = [
    r"(?:^|[\W_])(?:article|content|post|entry|story|text|body)(?:$|[\W_])", r"main", r"nav|menu|crumb|pagination|pager|tabs", r"(?:^|[\W_])ads?(?:$|[\W_\d])|advert|sponsor|promo|banner",
    r"comment|disqus|repl(?:y|ies)|discussion|responses", r"side|rail|widget|related|recommend|trending|popular", r"share|social|tags|meta|byline", r"foot|copyright|legal|bottom",
    r"head(?:er)?(?:$|[\W_])|masthead|topbar", r"cookie|consent|gdpr|notice|popup|modal|alert|paywall|overlay", r"newsletter|subscribe|signup|login|search", r"wrapper|container|page",
]
_ROLES = ["navigation", "banner", "contentinfo", "complementary", "main", "search", "dialog", "article"]
_TAG_BIT = {t: 1 << i for i, t in enumerate(_TAGS)}
_NAME_BIT = [(re.compile(p), 1 << (len(_TAGS) + i)) for i, p in enumerate(_NAMES)]
_ROLE_BIT = {r: 1 << (len(_TAGS) + len(_NAMES) + i) for i, r in enumerate(_ROLES)}
_N_BITS = len(_TAGS) + len(_NAMES) + len(_ROLES)

#: Tags whose attributes hold no angle bracket; nothing here looks beyond the next one.
_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/<>]*)([^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*|'[^'<>]*'[^<>\"']*)*)>")
_NAME, _PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)"), re.compile(r"[^<>\"']*")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SAYS = ("cookie", "©", "copyright", "subscribe", "all rights", "sign up", "log in", "advert", "imprint", "terms of", "privacy")


@functools.lru_cache(65536)
def _mask(tag: str, attrs: str) -> int:
    m = _TAG_BIT.get(tag, 0)
    for k, *v in _ATTR.findall(attrs) if attrs else ():
        value = "".join(v).lower()
        if k.lower() == "role":
            m |= _ROLE_BIT.get(value.strip(), 0)
        else:
            for rx, bit in _NAME_BIT:
                if rx.search(value):
                    m |= bit
    return m


class _Tags:
    """The tags of a page, one after the other, in time linear in its length: what a failed look
    has seen isn't looked at again."""

    def __init__(self, page: str):
        self.page, self.last, self.dead, self.ends = page, page.rfind(">"), set(), {}

    def at(self, lt: int) -> tuple[int, str | None, bool, str]:
        """End of the tag at lt (-1 if there is none), its name (None for comments and declarations), whether it ends, attributes."""
        page = self.page
        if lt > self.last:
            return -1, None, False, ""
        m = _TOKEN.match(page, lt)
        if m is not None:
            if m[2] is None:
                end = page.find("-->", lt + 2)
                return (len(page) if end < 0 else end + 3), None, False, ""
            return m.end(), m[2].lower(), bool(m[1]), m[3]
        if page.startswith(("<!", "<?"), lt):
            return page.find(">", lt) + 1, None, False, ""
        m = _NAME.match(page, lt)
        end = -1 if m is None else self._close(m.end())
        return (-1, None, False, "") if end < 0 else (end + 1, m[2].lower(), bool(m[1]), page[m.end() : end])

    def _close(self, i: int) -> int:
        """The first `>` from i on outside quotes, or -1."""
        page, seen = self.page, []
        while True:
            i = _PLAIN.match(page, i).end()
            if i >= len(page) or page[i] == "<" or i in self.dead:
                break
            if page[i] == ">":
                return i
            seen.append(i)
            j = page.find(page[i], i + 1)
            if j < 0:
                break
            i = j + 1
        self.dead.update(seen)
        return -1

    def raw_end(self, tag: str, at: int) -> int:
        """The end of a raw element's content; that there is none is remembered."""
        if self.ends.get(tag) == -1:
            return len(self.page)
        m = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(self.page, at)
        if m is None:
            self.ends[tag] = -1
            return len(self.page)
        end = self.page.find(">", m.end())
        return len(self.page) if end < 0 else end + 1


class _Open:
    """The open elements, with the places of each name."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = []  # tag, mask of the path, mask of the nearest block
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # blocks but p
        self.walls: list[int] = []

    def last(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def push(self, tag: str, mask: int, near: int) -> None:
        k = len(self.stack)
        self.stack.append((tag, mask, near))
        self.where.setdefault(tag, []).append(k)
        if tag in _BLOCK and tag != "p":
            self.blocks.append(k)
        if tag in _WALLS:
            self.walls.append(k)

    def cut(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        for tag, _, _ in self.stack[k:]:
            self.where[tag].pop()
        del self.stack[k:]
        for places in (self.blocks, self.walls):
            while places and places[-1] >= k:
                places.pop()

    def masks(self) -> tuple[int, int]:
        return self.stack[-1][1:] if self.stack else (0, 0)


def leaf_blocks(page: str) -> list[tuple[str, int, int, int, float]]:
    """Leaf blocks in page order: text, what all ancestors say, what the nearest block says, depth, linked share."""
    out: list[tuple[str, int, int, int, float]] = []
    tags, up = _Tags(page), _Open()
    text: list[str] = []
    linked, said = 0, False
    first = (0, 0, 0)
    at, n = 0, len(page)

    def add(s: str) -> None:
        nonlocal linked, first, said
        if s and not s.isspace():
            if not said:
                first, said = (*up.masks(), len(up.stack)), True
            if up.where.get("a"):
                linked += len(s)
        if s:
            text.append(s)

    def flush() -> None:
        nonlocal linked, said
        if said:
            raw = "".join(text)
            s = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if s:
                out.append((s, *first, min(1.0, linked / len(raw))))
        text.clear()
        linked, said = 0, False

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > tags.last:
            add(page[at:])
            break
        add(page[at:lt])
        end, tag, closes, attrs = tags.at(lt)
        if end < 0:
            add("<")
            at = lt + 1
            continue
        at = end
        if tag is None:
            continue
        block = tag in _BLOCK
        if closes:
            if block:
                flush()
            k = up.last(tag)
            if k >= 0 and (block or not up.walls or k > up.walls[-1]):
                up.cut(k)
            continue
        if tag in _RAW:
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                at = tags.raw_end(tag, at)
            if text:
                text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if block:
            flush()
            if tag in _P_ENDERS and (k := up.last("p")) > (up.blocks[-1] if up.blocks else -1):
                up.cut(k)
            if tag in _ENDS and (k := up.last(*_ENDS[tag])) > up.last(*_BARRIER[tag]):
                up.cut(k)
            if tag == "body":
                up.cut(0)
        if tag in _VOID:
            continue
        own = _mask(tag, attrs)
        mask, near = up.masks()
        up.push(tag, mask | own, own if block else near)
    flush()
    return out


def features(page: list[tuple[str, int, int, int, float]], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Features of a page's blocks from lo to hi; they look at one block on either side."""
    whole = len(page)
    hi = whole if hi is None else min(hi, whole)
    start, stop = max(lo - 1, 0), min(hi + 1, whole)
    blocks, n = page[start:stop], stop - start
    if hi <= lo:
        return np.zeros((0, 2 * _N_BITS + 19 + 8))
    path = np.array([b[1] for b in blocks], np.uint64)
    near = np.array([b[2] for b in blocks], np.uint64)
    shift = np.arange(_N_BITS, dtype=np.uint64)
    bits = np.hstack([(path[:, None] >> shift) & np.uint64(1), (near[:, None] >> shift) & np.uint64(1)]).astype(np.float64)
    num = np.empty((n, 19))
    for i, (s, _, _, depth, linked) in enumerate(blocks):
        k = len(s)
        w = s.count(" ") + 1
        stops = s.count(".") + s.count("!") + s.count("?")
        num[i] = (np.log1p(k), np.log1p(w), linked, linked > 0.6, min(depth, 12) / 12, stops / w, np.log1p(stops), s.count(",") / w, s[-1] in ".!?:;\"'”»", s[0].isupper(), k / w / 10, s.isupper(), any(map(s.lower().__contains__, _SAYS)), w <= 3, (start + i) / whole, start + i == 0, start + i == whole - 1, whole == 1, np.log1p(whole))
    near_num = num[:, [0, 2, 6, 8]]
    prev, nxt = np.zeros((n, 4)), np.zeros((n, 4))
    prev[1:], nxt[:-1] = near_num[:-1], near_num[1:]
    return np.hstack([bits, num, prev, nxt])[lo - start : hi - start]


def _many(pages: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
    x = [features(b) for b in pages]
    return np.concatenate(x) if x else features([]), np.r_[0, np.cumsum([len(f) for f in x])].astype(np.int64)


def fit(pages: Iterable[tuple[list, list[int]]]) -> LinearChainCRF:
    """Train on pages as (leaf blocks, labels); label 1 is main text."""
    pages = [(b, y) for b, y in pages if b]
    x, off = _many(b for b, _ in pages)
    return LinearChainCRF(2, l2=2e-4).fit(x, np.concatenate([np.array(y) for _, y in pages]), off, rounds=60)


def _labelled(n: int, seed: int = 3):
    for page in training_pages(n, seed):
        got = leaf_blocks(page)
        yield [(b[0].replace(MAIN, "").replace(REST, "").strip() or "-", *b[1:]) for b in got], [int(MAIN in b[0]) for b in got]


@functools.lru_cache(2)
def default_model(pages: int = TRAIN_PAGES) -> LinearChainCRF:
    return fit(_labelled(pages))


def main_texts(pages: list[str | None], model: LinearChainCRF) -> list[str]:
    """The main text of each page. Features are made STEP blocks at a time, so that a page of very many blocks needs no more."""
    blocks = [leaf_blocks(p) if p else [] for p in pages]
    off = np.r_[0, np.cumsum([len(b) for b in blocks])].astype(np.int64)
    scores, held, size = [], [], 0
    for b in blocks:
        for lo in range(0, len(b), STEP):
            held.append(features(b, lo, lo + STEP))
            size += len(held[-1])
            if size >= STEP:
                scores.append(model.scores(np.concatenate(held)))
                held, size = [], 0
    if held:
        scores.append(model.scores(np.concatenate(held)))
    y = model.decode(np.concatenate(scores) if scores else np.zeros((0, 2)), off)
    return [" ".join(b[0] for b, k in zip(bs, y[off[i] : off[i + 1]], strict=True) if k) for i, bs in enumerate(blocks)]


def extract(pages: DataFrame, model: LinearChainCRF | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    require(pages, "page_id", "url", "html")
    model = default_model() if model is None else model

    def run(batches):
        for b in batches:
            for lo, up in tk.blocks(tk.column(b.column(2))[1], PAGE_BYTES):
                part = b.slice(lo, up - lo)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")

"""Main text of web pages by tag-path ratios.

A page is cut into text leaves, each with its root-to-leaf tag path (tags with
their class, role and id names). Per path the text length and the number of
punctuation marks are summed and divided by the path's number of leaves; both
ratios are smoothed over neighbouring leaves in page order (Gaussian of
``width`` leaves), scaled by the page's own mean, and fused as their geometric
mean; on a page without any punctuation the length decides alone. That score is multiplied by two factors, on every page alike:

* names: a block whose class, id or role names say notice, advert, comments and
  the like lowers what is in it to ``NAMED`` of itself. A name counts as a whole
  (``share-price`` isn't ``share``); of a compound all words must be such, or say
  nothing (``ad-box``). Inline elements count only where they are all of their
  block, so no sentence loses a word. Such names count from the least number of
  them that a fifth of the page's weight (fused ratio times length) has, so a
  wrapper named so around the whole text changes nothing;
* container: with a share h of the page's weight in its articles (``article``,
  ``main``, role main), what isn't a link in these gains 1 + ``HOME`` * h, so text
  without punctuation stays, and paths outside are lowered to 1 - ``AWAY`` * h.

Paths whose leaves reach ``threshold`` times the page's mean, on average, are content.
A region (``article``, ``main``, ``section``, ``div``) that holds content itself
is kept whole, however short a heading, a list item or a table cell in it is; so
is a region within one of an article that does, unless half of its text or more
is links. Only elements that never hold article text (navigation, headers and
footers of the page, sidebars, forms, scripts, styles ...) and hidden ones are
left out whatever they score.

Blocks are closed by block-level tags; inline tags don't break text. Character
references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by two line feeds. ``p`` closes an open ``p``, and end
tags that nothing opened are ignored, so unclosed tags do no harm.

Defined cases: null or empty html gives an empty text and n_chars 0; so do
pages without content, and those without a letter or digit. Text outside any tag counts as body text. Repeated rows
are extracted each. Nothing is capped: a page is worked on whole, in time linear
in its length. Paths of equal scores are content together or not at all. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav header footer aside form script style noscript template button select textarea iframe head title menu dialog label input svg math".split())
# Words in class, id and role names that tell against article text, and the weights of names and articles.
NAMED, HOME, AWAY = 0.02, 1.0, 0.5
UNWANTED = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments comentarios complementary contentinfo consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo promoted recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
SAYS_NOTHING = frozenset("area bar block body bottom box buttons container content group inner item items left link links list outer panel post posts right section site top unit wrap wrapper".split())
REGIONS = frozenset("article div main section".split())
CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTES = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_BRACKET = re.compile("[<>]")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¡¿]")


@dataclass(slots=True)
class Leaf:
    """A run of text: its block, its path's number, and what the elements above it say."""

    block: int
    path: int
    text: str
    veto: bool  # in an element that never holds article text, or hidden
    home: bool  # in an article
    named: int  # blocks of unwanted names above it
    inline: bool  # in an inline element of an unwanted name
    region: int
    link: bool


@dataclass(slots=True)
class _Open:
    tag: str
    leaf: Leaf  # what a run of text right here is


def unwanted(name: str) -> bool:
    """Whether a whole class, id or role name tells against article text: one of its words does, and none says anything else."""
    words = [w for w in re.split(r"[^a-z0-9]+", name.lower()) if w]
    return not UNWANTED.isdisjoint(words) and all(w in UNWANTED or w in SAYS_NOTHING for w in words)


def leaves(page: str) -> tuple[list[Leaf], list[int]]:
    """The text leaves in page order, and the region around each region."""
    out: list[Leaf] = []
    stack = [_Open("", Leaf(0, 0, "", False, False, 0, False, 0, False))]
    paths: dict[tuple[int, str], int] = {}
    regions = [0]
    depth: dict[str, int] = {}
    block = at = 0
    lower = None

    def close(n: int) -> None:
        nonlocal block
        while len(stack) > n:
            gone = stack.pop()
            depth[gone.tag] -= 1
            if gone.tag in BLOCK:
                block += 1

    def add(text: str) -> None:
        out.append(replace(stack[-1].leaf, block=block, text=text))

    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            add(page[at:end])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag and page[at : at + 1] in ("'", '"'):  # a quote that nothing closes: the tag ends at the next bracket
            cut = _BRACKET.search(page, at)
            at = len(page) if not cut else cut.end() if cut[0] == ">" else cut.start()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>"), False))
            continue
        tag = tag.lower()
        if m[1]:
            if depth.get(tag):
                n = len(stack) - 1
                while stack[n].tag != tag:
                    n -= 1
                close(n)
            elif tag in BLOCK:
                block += 1
            continue
        for kind, by in CLOSES.items():
            if tag in by and depth.get(kind):
                n = len(stack) - 1
                while n and stack[n].tag != kind and stack[n].tag not in ("table", "ul", "ol", "dl", "article", "div", "section", "td"):
                    n -= 1
                if stack[n].tag == kind:
                    close(n)
        if tag in BLOCK:
            block += 1
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        attributes = m[3] or ""
        names: list[str] = []
        role, hidden, against = "", False, False
        for name, x, y, z in _ATTRIBUTES.findall(attributes):
            name, value = name.lower(), x or y or z
            if name in ("class", "id", "role"):
                own = value.split()
                names += own
                against = against or any(map(unwanted, own))
                role = own[0].lower() if name == "role" and own else role
            hidden = hidden or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and bool(_NO_DISPLAY.search(value)))
        top = stack[-1].leaf
        against = against and tag not in ("html", "body", "article", "main")
        home = top.home or tag in ("article", "main") or role == "main"
        veto = top.veto or hidden or (tag in NEVER and not (tag == "header" and top.home))
        if tag in RAW:
            if lower is None:
                lower = page.lower() if page.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), page)
            stop = lower.find(f"</{tag}", at)
            if not attributes.endswith("/"):
                at = len(page) if stop < 0 else stop
                after = page.find(">", at)
                at = len(page) if stop < 0 or after < 0 else after + 1
            continue
        if attributes.endswith("/"):
            continue
        path = paths.setdefault((top.path, ".".join([tag, *names])), len(paths) + 1)
        region = top.region
        if tag in REGIONS:
            region = len(regions)
            regions.append(top.region)
        stack.append(_Open(tag, Leaf(0, path, "", veto, home, top.named + (against and tag in BLOCK), top.inline or (against and tag not in BLOCK), region, top.link or tag == "a")))
        depth[tag] = depth.get(tag, 0) + 1
    return out, regions


def _smooth(values: list[float], width: float) -> list[float]:
    """Gaussian smoothing over neighbours; weights renormalised at the ends."""
    reach = max(1, math.ceil(2 * width))
    kernel = [math.exp(-(d * d) / (2 * width * width)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        num = den = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = kernel[abs(i - j)]
            num += w * values[j]
            den += w
        out.append(num / den)
    return out


def fused_ratios(nodes: list[Leaf], width: float = 1.0) -> list[float]:
    """The fused tag-path ratio of each leaf, as a multiple of the page's mean."""
    by_path: dict[int, list[float]] = {}
    for n in nodes:
        if not n.text.isspace():
            own = by_path.setdefault(n.path, [0, 0, 0])
            own[0] += len(n.text.strip())
            own[1] += len(_PUNCTUATION.findall(n.text))
            own[2] += 1
    ratio = lambda k: _smooth([by_path[n.path][k] / by_path[n.path][2] if n.path in by_path else 0.0 for n in nodes], width)
    text, marks = ratio(0), ratio(1)
    mean_t, mean_p = sum(text) / max(1, len(text)) or 1.0, sum(marks) / max(1, len(marks))
    return [math.sqrt((t / mean_t) * (0.1 + p / mean_p if mean_p else 1.0)) for t, p in zip(text, marks, strict=True)]


def _against(nodes: list[Leaf]) -> list[int]:
    """Unwanted names over each leaf; an inline one counts if nothing else is in its block."""
    plain = {n.block for n in nodes if not n.inline and not n.text.isspace()}
    return [n.named + (n.inline and n.block not in plain) for n in nodes]


def _kept_regions(nodes: list[Leaf], regions: list[int], content: list[bool]) -> set[int]:
    """Regions that hold content, and those in kept ones of articles whose text isn't mostly links."""
    kept = {n.region for n, c in zip(nodes, content, strict=True) if c}
    home = {n.region for n in nodes if n.home}
    size, links = [0] * len(regions), [0] * len(regions)
    for n in nodes:
        if not n.veto:
            size[n.region] += (own := len(n.text.strip()))
            links[n.region] += own * n.link
    for r in range(len(regions) - 1, 0, -1):  # inner regions come later
        size[regions[r]] += size[r]
        links[regions[r]] += links[r]
    for r in range(1, len(regions)):
        if r in home and regions[r] in kept and 2 * links[r] < size[r]:
            kept.add(r)
    return kept


def main_text(page: str | None, threshold: float = 0.5) -> str:
    if not page:
        return ""
    nodes, regions = leaves(page)
    scores, against = fused_ratios(nodes), _against(nodes)
    own = [(n, k, score * len(n.text.strip())) for n, k, score in zip(nodes, against, scores, strict=True) if not n.veto and not n.text.isspace()]
    total = sum(w for *_, w in own)
    by_names: dict[int, float] = {}
    for _, k, w in own:
        by_names[k] = by_names.get(k, 0.0) + w
    base, met = 0, 0.0
    for base in sorted(by_names):
        met += by_names[base]
        if met >= 0.2 * total:
            break
    damped = lambda k: NAMED ** max(0, k - base)
    total = sum(w * damped(k) for _, k, w in own)
    share = sum(w * damped(k) for n, k, w in own if n.home) / (total or 1.0)
    # A path's score is the mean of its leaves', so that a leaf beside the text doesn't take its whole path along.
    by_path: dict[tuple[int, int], list[float]] = {}
    for n, k, score in zip(nodes, against, scores, strict=True):
        if not n.veto and not n.text.isspace():
            by_path.setdefault((n.path, k), []).append(score * damped(k) * (1 + HOME * share * (not n.link) if n.home else 1 - AWAY * share))
    paths = {path for path, own in by_path.items() if sum(own) / len(own) >= threshold}
    content = [not n.veto and (n.path, k) in paths for n, k in zip(nodes, against, strict=True)]
    # A block is content whole, so that inline tags in it don't lose their text; what has more unwanted names stands alone.
    blocks = {n.block for n, c in zip(nodes, content, strict=True) if c}
    kept = _kept_regions(nodes, regions, content)
    parts: dict[int, list[str]] = {}
    for n, k, c in zip(nodes, against, content, strict=True):
        if c or (not n.veto and k <= base and (n.block in blocks or n.region in kept)):
            parts.setdefault(n.block, []).append(n.text)
    texts = (" ".join(html.unescape("".join(p)).split()) for p in parts.values())
    text = "\n\n".join(t for t in texts if t)
    return text if any(map(str.isalnum, text)) else ""


def _extract(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p, threshold) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract(threshold), "page_id long, url string, text string, n_chars long")


def op7_htmltext(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_htmltext": op7_htmltext}
ORACLE: dict[str, str] = {}

"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events once over each page; block-level tags cut the page into lines.
Every line has a text-to-tag ratio (characters per tag, at least one tag), the ratios are smoothed by a
Gaussian over neighbouring lines, and lines are clustered by a threshold set by the page's own spread. The region is
the page's ``main`` parts, else the innermost container that holds the whole content cluster: with the ``article`` parts
beside it if it is one, else widened to the containers around it below the body as long as that adds no line made
mostly of links (a lead above the story stays, a list of links doesn't come in). All text blocks of that region, and h1 headings outside it, are returned in page order.

Boilerplate containers (menus, headers, footers, sidebars, notices, adverts, scripts, styles, reader comments) never give
lines. They are known by element, role or a noise word in class or id; forms, and containers known by class or id alone,
stay if they hold most of the content cluster (a page may lie in one form as a whole). Of a compound name the noise word
must be the last word or be followed by words for parts of a page only (``related-posts``, not ``related-work``), and names
that state a layout (has-, no-, with-, -open, -enabled) name no boilerplate.

Containers are numbered and point to their parents, and open elements are looked up by name, so nested and very long
pages take time in proportion. Null or empty html, and pages without text: empty string. Unclosed and stray tags are
tolerated. Ties: of containers that hold the whole cluster the innermost is the region. Pages are independent of one
another; repeated rows get equal results; null ids and urls are passed on; extra columns play no part. Empty table:
empty result.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import mapped, only

SIGMA = 1.0
#: HTML element names by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head nav footer aside button select textarea iframe object svg canvas menu dialog".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "legend", "summary"}
SELF_NESTING_OFF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table menu article section main aside nav div body".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent notice popup modal newsletter subscribe signup share sharing social related recommended widget comment comments commentlist respond reply replies disqus login pagination pager toolbar".split()
)
#: Words that make a class name a statement about layout or state, not a name of the container's role.
MODIFIERS = frozenset("has have no not non with without hide show".split())
STATES = frozenset("open opened closed enabled disabled on off active visible hidden".split())
PARTS = frozenset(
    "area articles bar block bottom box button buttons container content entries extra feed footer form group header holder icon icons inner inside item items label left link links list main menu more news outer panel posts right row section sections slot slots stories strip tabs text title tools top unit units widget widgets wrap wrapper zone".split()
)
#: A container with this share of the content cluster's characters isn't boilerplate, if it is named by a noise word
#: alone or by a compound with one.
NAMED_SHARE, COMPOUND_SHARE = 0.9, 0.5
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
SPACE = re.compile(r"\s+")


def noise_share(value: str) -> float | None:
    """The share of the content from which a container with this class or id isn't noise; None if it isn't named so."""
    share = None
    for token in value.lower().split():
        if token in NOISE:
            return NAMED_SHARE
        words = re.split("[_-]+", token)
        if not MODIFIERS.isdisjoint(words) or words[-1] in STATES:
            continue
        first = next((k for k, word in enumerate(words) if word in NOISE), len(words))
        if first < len(words) and all(word in NOISE or word in PARTS or word.isdigit() for word in words[first:]):
            share = COMPOUND_SHARE
    return share


class _Lines(HTMLParser):
    """Cuts a page into block lines: (text, tags, innermost container). Container 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, int, bool, int]] = []  # name, container, starts a skipped part, blocks up to here
        self.places: dict[str, list[int]] = {}  # where the open elements of a name are in the stack
        self.scopes: list[int] = []
        self.skipping = 0
        self.text: list[str] = []
        self.tags = 0
        self.parents = [-1]
        self.kinds = [""]
        self.inside = 0
        self.noise: dict[int, float] = {}  # containers named like noise, with their limit
        self.titles: set[int] = set()  # lines inside h1
        self.links: list[bool] = []  # lines made mostly of links
        self.linked = 0

    def _flush(self) -> None:
        if self.text:
            line = SPACE.sub(" ", "".join(self.text)).strip()
            self.text.clear()
            if line:
                if self.places.get("h1"):
                    self.titles.add(len(self.lines))
                self.lines.append((line, self.tags, self.inside))
                self.links.append(2 * self.linked > len(line))
                self.tags = 0
            self.linked = 0

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of a name, or -1."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def _push(self, tag: str, container: int, skip: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, container, skip, (self.stack[-1][3] if self.stack else 0) + (tag in BLOCKS)))
        self.skipping += skip
        if container:
            self.inside = container

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, container, skip, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.skipping -= skip
            if container:
                self.inside = self.parents[container]

    def _end_inside_scope(self, tags) -> None:
        """End the innermost open element of some names unless a scope lies inside it."""
        at = max(self._last(tag) for tag in tags)
        if at >= 0 and at >= (self.scopes[-1] if self.scopes else -1):
            self._pop(at)

    def _implied_ends(self, tag: str) -> None:
        if tag in CLOSES_P:
            self._end_inside_scope(("p",))
        if tag in SELF_NESTING_OFF:
            self._end_inside_scope(SELF_NESTING_OFF[tag])

    def handle_starttag(self, tag: str, attrs) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            self._implied_ends(tag)
        elif tag == "br" or tag == "img":
            if not self.skipping:
                self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        noise = NAMED_SHARE if tag == "form" else None
        skip = tag in SKIPPED or (tag == "header" and self._last("article") < 0 and self._last("main") < 0)
        if not skip and block and tag not in ("html", "body", "article", "main", "p") and not (len(tag) == 2 and tag[0] == "h"):
            for name, value in attrs:
                if value and name == "role" and value.lower() in NOISE_ROLES:
                    skip = True
                    break
                if value and name in ("class", "id") and (share := noise_share(value)):
                    noise = max(noise or 0.0, share)
        container = 0
        if block and tag != "p" and not (tag[0] == "h" and tag[1:].isdigit()):
            container = len(self.kinds)
            self.kinds.append(tag)
            self.parents.append(self.inside)
            if noise and not skip:
                self.noise[container] = noise
        self._push(tag, container, skip)

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID or tag not in BLOCKS:
            if tag in BLOCKS:
                self._flush()
            self.tags += 1
            if tag == "br" and not self.skipping:
                self.text.append(" ")
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self.tags += 1
        at = self._last(tag)
        if at < 0 or (at > 0 and tag not in BLOCKS and self.stack[-1][3] > self.stack[at][3]):
            return  # nothing to end, or an inline end tag that can't close blocks opened after it
        self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.text.append(data)
            if self.places.get("a"):
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian over neighbouring lines, renormalised at the ends."""
    reach = max(1, math.ceil(sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for k in range(-reach, reach + 1):
            if 0 <= i + k < len(values):
                total += values[i + k] * weights[k + reach]
                norm += weights[k + reach]
        out.append(total / norm)
    return out


def _cluster(lines: list[tuple[str, int, int]]) -> list[bool]:
    """Which lines belong to the content cluster."""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _ in lines])
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    threshold = min(mean, spread) if spread else mean
    return [r >= threshold for r in ratios]


def _held(weights: list[tuple[int, int]], parents: list[int]) -> list[int]:
    """The sum of the weights (container, weight) at or below each container. Parents come before their parts."""
    total = [0] * len(parents)
    for container, weight in weights:
        total[container] += weight
    for container in range(len(parents) - 1, 0, -1):
        total[parents[container]] += total[container]
    return total


def _below(roots: set[int], parents: list[int]) -> list[bool]:
    """Which containers are or lie in one of some containers."""
    inside = [k in roots for k in range(len(parents))]
    for container in range(1, len(parents)):
        inside[container] |= inside[parents[container]]
    return inside


LISTS = frozenset("li ul ol td tr table tbody blockquote pre dd dt dl figure figcaption".split())


def content_region(lines: list[tuple[str, int, int]], links: list[bool], kinds: list[str], parents: list[int]) -> set[int]:
    """The containers whose lines are the main text: the page's ``main`` parts, else the innermost container that
    holds the whole content cluster, with the articles beside it or widened; container 0 is the page."""
    cluster = [(container, 1) for (_, _, container), inside in zip(lines, _cluster(lines), strict=True) if inside]
    mains = {k for k, kind in enumerate(kinds) if kind == "main"}
    in_main = _below(mains, parents)
    if any(in_main[container] for container, _ in cluster):
        return mains
    held = _held(cluster, parents)
    region = max(k for k, n in enumerate(held) if n == len(cluster))
    while region and kinds[region] in LISTS:
        region = parents[region]
    if kinds[region] == "article":
        return {k for k, kind in enumerate(kinds) if kind == "article" and parents[k] == parents[region]}
    linked = _held([(container, int(link)) for (_, _, container), link in zip(lines, links, strict=True)], parents)
    while region and parents[region] and kinds[parents[region]] not in ("body", "html") and linked[parents[region]] == linked[region]:
        region = parents[region]
    return {region}


def noise_containers(lines: list[tuple[str, int, int]], noise: dict[int, float], parents: list[int]) -> set[int]:
    """The containers named like noise that don't hold most of the page's content lines."""
    held = _held([(container, len(text)) for (text, _, container), inside in zip(lines, _cluster(lines), strict=True) if inside], parents)
    return {c for c, share in noise.items() if held[c] <= share * held[0]}


def extract(html: str | None) -> list[str]:
    """The blocks of the main text, in page order."""
    if not html:
        return []
    parser = _Lines()
    parser.feed(html)
    parser.close()
    if not parser.lines:
        return []
    noisy = _below(noise_containers(parser.lines, parser.noise, parser.parents) if parser.noise else set(), parser.parents)
    lines, titles, links, tags = [], [], [], 0
    for k, (text, own, container) in enumerate(parser.lines):
        tags += own
        if not noisy[container]:
            lines.append((text, tags, container))
            titles.append(k in parser.titles)
            links.append(parser.links[k])
            tags = 0
    if not lines:
        return []
    region = _below(content_region(lines, links, parser.kinds, parser.parents), parser.parents)
    return [text for (text, _, container), title in zip(lines, titles, strict=True) if title or region[container]]


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) per page. Map-only: pages stream through Arrow batches."""
    pages = only(df, page_id=id_col, url=url_col, html=html_col)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long, n_blocks long"

    def run(batches):
        for batch in batches:
            blocks = [extract(h.as_py()) for h in batch.column("html")]
            texts = ["\n".join(b) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in blocks], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    return mapped(pages, run, schema)

"""HTML extraction (3): consensus paths of a host.

Each page's containers are scored by the prose that they hold, summed by path: the tags and classes from the root
down, numbers generalised. Every path votes with its share of the page's best score. In Spark the votes of a host's pages
are added up, and each page is then read at its host's winning path, however little of the page it holds. Only a page
without text at that path is read at its own best path.

A path may be the inner part of an article. So what lies directly in the containers around it is read too, and the path
itself goes up as long as that adds prose that is not the greater part; the sums of a host's pages decide how far.

A page is parsed twice, once for its votes and once to be read, so that no text is written for paths that lose.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import join_small, prepared, slices, strings
from martloom.llm.url_reputation import host_of

# Element kinds.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul""".split()
)
CONTAINERS = frozenset("article blockquote body center div main section table tbody td tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object noframes xmp".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu".split())
CLOSED_BY_BLOCK = "p"
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class names and ids that tell what is not, and what is, the article.
ASIDE = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice
    notices notification overlay paging pagination popup promo promos promoted recommended related reply replies respond rss search
    share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets
    reactions discussion alert""".split()
)
BODY = frozenset("article articlebody content entry main post story text body".split())
#: A class whose last word is one of these holds an article, so a header inside it is the article's.
HOLDERS = frozenset("article entry post story".split())
#: What may stand beside a word of ASIDE without telling of anything else.
FURNITURE = frozenset(
    """area bar block bottom box button buttons container footer form header inner item items left link links list module outer
    panel posts right row section thread threads title top wrap wrapper""".split()
)
#: Words of ASIDE that are chapters of articles as well.
CHAPTERS = frozenset("alert discussion navigation reactions replies search".split())
#: After these a word tells what a layout has or lacks, not what the element is.
MODIFIERS = frozenset("has no non not with without".split())

DECAY, BONUS = 0.7, 1.5

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: str
    dropped: bool
    bonus: float = 1.0
    aside: bool = False  # by its names
    clearly: bool = False  # its names say nothing else
    within: bool = False  # in an article, or one itself


@dataclass(slots=True)
class Held:
    """Characters of prose and of links in a container, prose that is in no container inside it; whether it is declared
    as the article."""

    score: float = 0.0
    prose: int = 0
    linked: int = 0
    direct: int = 0
    declared: bool = False


@dataclass
class Page:
    """Elements in page order, and blocks of text: the element each is in, the text, its characters in links."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def containers(self, at: int) -> Iterator[int]:
        """From the inside out. The last is the page itself, -1, which stands for a body that has no tag."""
        while at >= 0:
            if self.elements[at].tag in CONTAINERS:
                yield at
            at = self.elements[at].parent
        yield -1

    def path(self, at: int) -> str:
        return self.elements[at].path if at >= 0 else ""

    def held(self) -> dict[str, Held]:
        """What the containers of each path hold. The score is less from one level to the next."""
        out: dict[str, Held] = {}
        for at, text, linked in self.blocks:
            prose = max(0, len(text) - linked)
            worth, direct = float(prose), prose
            for k in self.containers(at):
                bonus = self.elements[k].bonus if k >= 0 else 1.0
                own = out.setdefault(self.path(k), Held())
                own.score += worth * bonus
                own.prose += prose
                own.linked += len(text) - prose
                own.direct += direct
                own.declared |= bonus > 1
                worth, direct = worth * DECAY, 0
        return out

    def text(self, path: str) -> str:
        """The blocks at a path, and the prose that lies directly in the containers around it."""
        around = {k for at, e in enumerate(self.elements) if e.path == path for k in self.containers(e.parent)}
        found = []
        for at, text, linked in self.blocks:
            chain = list(self.containers(at))
            if any(self.path(k) == path for k in chain) or (chain[0] in around and 2 * linked < len(text)):
                found.append(text)
        return "\n\n".join(found)


def whole(path: str, held: dict[str, Held]) -> str:
    """The path up to which the article goes: an ancestor is taken if it adds prose, not links, and if other containers
    in it hold no more than what an inner container may win by; around a declared article they hold nothing."""
    for above in sorted((p for p in held if path.startswith(f"{p}>")), key=len, reverse=True):
        now, more = held[path], held[above]
        prose, linked = more.prose - now.prose, more.linked - now.linked
        if not prose and not linked:
            continue
        if linked > prose or prose - more.direct > (0 if now.declared else (1 - DECAY) * now.prose):
            break
        path = above
    return path


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)}


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]


def _is_aside(names: list[str]) -> tuple[bool, bool]:
    """Whether a name tells of an aside, and whether one tells of nothing else."""
    says = clearly = False
    for words in map(_words, names):
        if not words or words[-1] == "free":
            continue
        if words[0] in ASIDE or (words[-1] in ASIDE and not (BODY | MODIFIERS).intersection(words)):
            says = True
            clearly |= set(words) <= ASIDE | FURNITURE and not set(words) <= CHAPTERS | FURNITURE
    return says, clearly


@lru_cache(maxsize=10_000)
def _kind(tag: str, raw: str, in_article: bool) -> tuple[str, bool, float, bool, bool, bool]:
    """Name in a path, whether it is dropped whatever it holds, the bonus, whether an element's names say aside, and
    nothing else, and whether it holds an article."""
    given = _attributes(raw) if raw and not raw.isspace() else {}
    classes = given.get("class", "").split()
    name = ".".join([tag, *sorted({_DIGITS.sub("#", c.lower().replace(">", "")) for c in classes})])
    dropped = tag in DROPPED or (tag == "header" and not in_article) or "hidden" in given or given.get("aria-hidden") == "true"
    dropped |= tag == "label" and "for" in given  # of a control; other labels are words of the text
    aside = clearly = holds = False
    if tag not in ("html", "body", "main", "article"):
        aside, clearly = _is_aside([*classes, *given.get("id", "").split()])
        holds = any(words and words[-1] in HOLDERS for words in map(_words, classes))
        dropped |= given.get("role", "").lower() in ROLES
        dropped |= "display:none" in re.sub(r"\s", "", given.get("style", "").lower())
    content = tag in ("article", "main") or given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody"
    return name, dropped, BONUS if content else 1.0, aside, clearly, content or holds


@lru_cache(maxsize=100)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE)


def parse(source: str) -> Page:
    """Unclosed, misnested and cut-off markup is taken as browsers do, roughly: a block ends an open paragraph, a
    list item the one before, an end tag everything inside; an end tag of nothing that is open is skipped."""
    page, stack = Page(), []
    #: Pieces of the open block and of all blocks: the element, the text, its characters in links.
    parts: list[tuple[int, str, int]] = []
    blocks: list[tuple[int, list[tuple[int, str, int]]]] = []
    links = 0

    def flush() -> None:
        if parts:
            blocks.append((stack[-1] if stack else -1, parts.copy()))
            parts.clear()

    def pop(count: int) -> None:
        nonlocal links
        for _ in range(count):
            tag = page.elements[stack[-1]].tag
            if tag in BLOCKS:
                flush()
            links -= tag == "a"
            stack.pop()

    def depth_of(tags: tuple[str, ...], until: frozenset[str] = frozenset()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            tag = page.elements[stack[k]].tag
            if tag in tags:
                return len(stack) - k
            if tag in until:
                return 0
        return 0

    def add(raw: str) -> None:
        if stack and page.elements[stack[-1]].dropped:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append((stack[-1] if stack else -1, text, len(text.strip()) if links else 0))

    at = 0
    while at < len(source):
        mark = _MARKUP.search(source, at)
        if not mark:
            add(source[at:])
            break
        if mark.start() > at:
            add(source[at : mark.start()])
        at = mark.end()
        closing, tag, raw = (mark[1], mark[2], mark[3]) if mark[2] else (mark[4], mark[5], mark[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing and tag in ("html", "body"):  # what follows is in the body all the same
            flush()
            continue
        if closing:
            depth = depth_of((tag,))
            if depth and not (tag not in BLOCKS and any(page.elements[k].tag in BLOCKS for k in stack[-depth:])):
                pop(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            if not raw.endswith("/"):
                end = _end_of(tag).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag == "br" or tag in VOID:
            parts.append((-1, " ", 0))
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            if depth := depth_of((CLOSED_BY_BLOCK,), BLOCKS - {CLOSED_BY_BLOCK}):
                pop(depth)
        if tag in CLOSES and (depth := depth_of(CLOSES[tag], frozenset({"ul", "ol", "dl", "table"}))):
            pop(depth)
        if tag in ("td", "th"):
            parts.append((-1, " ", 0))
        above = page.elements[stack[-1]] if stack else Element("", -1, "", False)
        name, dropped, bonus, aside, clearly, holds = ("", True, 1.0, False, False, False) if above.dropped else _kind(tag, raw, above.within)
        page.elements.append(Element(tag, stack[-1] if stack else -1, f"{above.path}>{name}", dropped, bonus, aside, clearly, above.within or holds))
        stack.append(len(page.elements) - 1)
        links += tag == "a"
    flush()
    out = _asides(page.elements, blocks)
    for at, pieces in blocks:
        kept = [piece for piece in pieces if piece[0] not in out]
        if text := " ".join("".join(t for _, t, _ in kept).split()):
            page.blocks.append((at, text, sum(linked for _, _, linked in kept)))
    return page


def _asides(elements: list[Element], blocks: list[tuple[int, list[tuple[int, str, int]]]]) -> set[int]:
    """The elements inside asides. An element that holds most of the page's prose is no aside by its name alone, unless
    the page declares an article outside it. Inside an article a name that tells of other things too, or that chapters
    bear as well, needs evidence: more of its text is links than is not."""
    if not any(e.aside for e in elements):
        return set()
    declared: list[bool] = []  # inside an article
    for e in elements:
        declared.append(e.bonus > 1 or (e.parent >= 0 and declared[e.parent]))
    prose, articles, links = ([0] * (len(elements) + 1) for _ in range(3))  # the last entry is the page
    for _, pieces in blocks:
        for at, text, linked in pieces:
            worth = len(text.strip()) - linked
            prose[at] += worth
            links[at] += linked
            articles[at] += worth if at >= 0 and declared[at] else 0
    for k in range(len(elements) - 1, -1, -1):
        prose[elements[k].parent] += prose[k]
        articles[elements[k].parent] += articles[k]
        links[elements[k].parent] += links[k]
    out: set[int] = set()
    for k, e in enumerate(elements):
        inside = e.parent >= 0 and elements[e.parent].within
        proven = e.clearly or not inside or links[k] > prose[k]
        if e.parent in out or (e.aside and proven and (2 * prose[k] <= prose[-1] or articles[-1] > articles[k])):
            out.add(k)
    return out


def candidates(page: Page) -> list[dict]:
    """The paths that hold prose, best first: their share of the best score, and the text of the article at the best.

    A page without containers of prose has one candidate without a path: its blocks outside links.
    """
    held = page.held()
    best = max((h.score for h in held.values()), default=0.0)
    if not best:
        return [{"path": None, "share": 0.0, "text": "\n\n".join(text for _, text, linked in page.blocks if linked < len(text))}]
    chosen = sorted((p for p in held if held[p].score), key=lambda p: (-held[p].score, p))
    return [{"path": p, "share": held[p].score / best, "text": None if k else page.text(whole(p, held))} for k, p in enumerate(chosen)]


def read(page: Page, winner: str | None, up_to: str | None) -> tuple[str | None, str]:
    """The path at which a page is read, the winner if it holds text, and the text up to the path that goes with it."""
    if winner is not None and winner in page.held():
        return winner, page.text(up_to)
    own = candidates(page)[0]
    return own["path"], own["text"]


_VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("share", pa.float64()), ("prose", pa.int64()), ("linked", pa.int64()), ("direct", pa.int64()), ("declared", pa.bool_())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "html"):
            cast = []
            for host, source in zip(piece.column("host").to_pylist(), strings(piece.column("html")), strict=True):
                held = parse(source).held()
                best = max((h.score for h in held.values()), default=0.0)
                cast += [(host, p, h.score / best, h.prose, h.linked, h.direct, h.declared) for p, h in held.items() if best]
            columns = list(zip(*cast, strict=True)) if cast else [()] * len(_VOTES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _VOTES, strict=True)], schema=_VOTES)


def _up_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts' winners, with what they and the paths above them hold, to the paths up to which pages are read."""
    for batch in batches:
        held = [{h.pop("path"): Held(0.0, **h) for h in hs} for hs in batch.column("held").to_pylist()]
        found = [whole(winner, h) for winner, h in zip(batch.column("winner").to_pylist(), held, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "winner")), pa.array(found, pa.string())], names=["host", "winner", "up_to"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "html"):
            winners = (piece.column(c).to_pylist() for c in ("winner", "up_to"))
            found = [read(parse(source), *w) for source, *w in zip(strings(piece.column("html")), *winners, strict=True)]
            columns = [piece.column(c) for c in ("page_id", "url")]
            paths, texts = (pa.array([f[k] for f in found], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*columns, texts, paths], names=["page_id", "url", "text", "path"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, path of every page. Blocks are joined by a blank line; white space inside a block
    is one space.

    Null or empty html gives an empty text. Pages without a host follow no consensus. Equal votes go to the first path
    in order. Repeated pages vote, and are extracted, one by one. An empty table gives an empty result. Other columns
    are not looked at.
    """
    ws = prepared(pages.sparkSession)
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), url.alias("url"), pages[html_col].cast("string").alias("html"), host_of(url).alias("host"))
    kind = "host string, path string, share double, prose long, linked long, direct long, declared boolean"
    cast = rows.where("host != ''").select("host", "html").mapInArrow(_votes, kind)
    sums = [F.sum(c).alias(c) for c in ("prose", "linked", "direct")]
    cast = ws.save(cast.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes"), *sums, F.max("declared").alias("declared")), "votes").df
    winners = cast.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("winner"))
    winners = ws.save(winners, "winners")
    above = join_small(cast, winners.df, winners.rows, "host").where(F.expr("path = winner OR startswith(winner, path || '>')"))
    above = above.groupBy("host", "winner").agg(F.collect_list(F.struct("path", "prose", "linked", "direct", "declared")).alias("held"))
    up_to = ws.save(above.mapInArrow(_up_to, "host string, winner string, up_to string"), "up_to")
    joined = join_small(rows, up_to.df, up_to.rows, "host", "left").select("page_id", "url", "html", "winner", "up_to")
    out = joined.mapInArrow(_read, "page_id long, url string, text string, path string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")

"""Main text of web pages, with the places of a host's pages deciding together.

Each page is read once into blocks of text under generalised paths of containers (tag and first classes,
digits folded). Its containers are scored by the text they hold that is neither link nor page furniture,
and the page votes for the deepest path that holds all of it. Votes are summed for each host and path in Spark; pages are then
extracted from the paths that their host has chosen, and pages whose text these do not cover fall back to
their own best container, as do pages without a host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.common import by_batch
from verdictframe.session import materialize

#: Comments and declarations, tags with their quotes in order, tags with a quote too many (to the next >), a tag cut off at the end.
_markup = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^<\"]*\"|'[^<']*')*+>|[^>]*(?:>|\Z))",
    re.DOTALL,
)
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup: it ends only at the closing tag.
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
#: Elements whose text is never part of an article.
DROPPED = RAW | frozenset("head nav footer aside select button template svg math dialog menu object canvas audio video datalist".split())
CONTAINERS = frozenset("body main article section div td th tr table tbody thead tfoot ul ol dl blockquote header center fieldset details figure html".split())
BLOCKS = CONTAINERS | frozenset("nav footer aside form menu dialog p h1 h2 h3 h4 h5 h6 li dt dd pre address hr figcaption caption summary hgroup legend".split())
#: What an opening tag closes if it is open, up to the nearest of the second set.
IMPLIED = {
    "p": (frozenset({"p"}), frozenset()),
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
}
#: Words of class, id and role that mark page furniture wherever they stand, also as the beginning of a longer
#: word for the second set. Names such as has-sidebar say something of what a container holds, not what it is.
FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo"
    " banner cookie cookies consent gdpr notice notices alert newsletter subscribe signup popup modal overlay share sharing social related recommended"
    " recommendations comment comments respond disqus reply replies pagination pager search login toolbar skip complementary contentinfo copyright colophon".split()
)
FURNITURE_BEGINS = ("comment", "advert", "sidebar", "breadcrumb", "newsletter", "cookie")
#: Words that begin like these but name texts.
TEXTS = ("commentar", "commentat", "advertor")
#: Words that also name subjects: a container of theirs with text that is not links stays (all in articles, elsewhere those with the word in a longer name).
SUBJECTS = frozenset(
    "menu widget promo banner consent notice notices alert subscribe signup popup modal overlay share sharing social related recommended recommendations respond reply replies pager"
    " search login toolbar skip navigation sponsor sponsored complementary contentinfo newsletter newsletters header masthead topbar".split()
)
#: Words that add nothing to a name of furniture: share-buttons, related-posts, ad-slot-2, but not social-history or ad-hoc.
FILLERS = frozenset(
    "area list lists post posts button buttons slot box block section container wrapper wrap link links bar articles stories form thread count feed unit zone top bottom left right header"
    " footer icon icons panel sticky sign up main primary secondary items item module inner outer group row site page global mobile desktop message policy section sections".split()
)
#: Free characters and share of links that tell text from furniture.
LEAST_TEXT = 100
MOST_LINKED = 0.3
_headings = frozenset("h1 h2 h3 h4 h5 h6".split())
_about = re.compile(r"(?:has|with|no|without|is)[-_]")
#: These only outside an article: inside, they hold its own heading.
HEADING = frozenset("header masthead topbar".split())
#: Share of a host's votes that a path needs besides the one with most votes.
LEAST_VOTES = 0.1
#: Share of a page's free text that a host's path must cover; less for a template's own container with several blocks.
LEAST_COVERED = 0.9
LEAST_OF_TEMPLATE = 0.05
LEAST_BLOCKS = 3


@dataclass
class Block:
    """A run of text: the container it stands in and the innermost element around it that is furniture or not by what it holds (-1: none)."""

    place: int
    within: int
    text: str
    linked: int
    furniture: bool


class Places:
    """The containers of a page as a tree of steps, so that no path is ever written for each of them.

    ``kind`` numbers paths: containers of one path have one kind. Parents come before their children in both lists.
    """

    def __init__(self) -> None:
        self.kind, self.known = [0], {}
        self.above, self.step = [-1], [""]

    def open(self, parent: int, step: str) -> int:
        key = (self.kind[parent], step)
        if key not in self.known:
            self.known[key] = len(self.step)
            self.above.append(key[0])
            self.step.append(step)
        self.kind.append(self.known[key])
        return len(self.kind) - 1

    def path(self, kind: int) -> str:
        steps = []
        while kind:
            steps.append(self.step[kind])
            kind = self.above[kind]
        return "/".join(reversed(steps))

    def find(self, path: str) -> int | None:
        kind: int | None = 0
        for step in path.split("/") if path else []:
            kind = self.known.get((kind, step)) if kind is not None else None
        return kind

    def under(self, kind: int | None) -> list[bool]:
        """For each kind whether it is ``kind`` or below it."""
        out = [k == kind for k in range(len(self.step))]
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.above[k]]
        return out

    def is_article(self, kind: int | None) -> bool:
        return bool(kind) and self.step[kind].split(".")[0] in ("article", "main")

    def sums(self, blocks: list[Block]) -> list[int]:
        """Free text that is in each kind, with all below it."""
        held = [0] * len(self.step)
        for b in blocks:
            held[self.kind[b.place]] += _free(b)
        for k in range(len(held) - 1, 0, -1):
            held[self.above[k]] += held[k]
        return held


@dataclass
class Part:
    """An element that is furniture or not by what it holds, or an article: which rule decides, the parts around it, its article."""

    rule: str
    up: int
    article: int


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(rest)} if rest and not rest.isspace() else {}


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = sorted(attributes.get("class", "").lower().split())[:2] if tag not in ("html", "body") else ()
    return ".".join([tag, *(re.sub(r"\d+", "#", x) for x in names)])


def _words(name: str) -> list[str]:
    return [w for w in map(str.lower, _word.findall(name)) if not w.isdigit()]


def _names_furniture(name: str) -> bool:
    """Whether all that a name says is furniture."""
    words = _words(name)
    return any(map(_marks, words)) and all(_marks(w) or w in FILLERS for w in words)


def _in_article(tag: str, attributes: dict[str, str]) -> str:
    """As ``_is_furniture``, for elements inside an article or main.

    Names of furniture alone mark it, whatever is in it: comments, adverts, sidebars, also in longer names (related-posts). A single
    word that also names subjects (notice, share) marks what holds less than half of the article, as a class or role; as an
    id it is a place to jump to. Paragraphs stay.
    """
    if tag == "p":
        return ""
    named = {key: [x for x in attributes.get(key, "").split() if not _about.match(x) and _names_furniture(x)] for key in ("class", "role", "id")}
    single = lambda x: len(_words(x)) == 1 and x.lower() in SUBJECTS
    found = [x for names in named.values() for x in names]
    if any(not single(x) for x in found):
        return "always"
    return "" if not named["class"] + named["role"] else "unless half" if tag in BLOCKS else "always"


def _is_furniture(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """``always``, ``unless text`` or ``unless half`` (by what the element holds), ``unless most`` (if it does not wrap the page's text) or nothing."""
    if tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "always"
    if not in_article and tag == "header":
        return "always"
    if tag == "form":
        return "unless most"
    if tag == "article" and "teaser" in _words(attributes.get("class", "")):
        return "unless most"
    if tag in ("body", "html", "article", "main") or tag in _headings:
        return ""
    if in_article:
        return _in_article(tag, attributes)
    tokens = [x for key in ("class", "role") for x in attributes.get(key, "").split() if not _about.match(x)]
    names = [*tokens, *(x for x in attributes.get("id", "").split() if not _about.match(x))]
    whole = {x.lower() for x in names}
    marks = {w for x in names for w in map(str.lower, _word.findall(x)) if _marks(w) or w in HEADING}
    if tag == "p":
        marks &= whole - SUBJECTS
    return "" if not marks else "unless text" if tag in BLOCKS and marks <= SUBJECTS and not marks & whole else "always"


def _marks(word: str) -> bool:
    return word in FURNITURE or word.startswith(FURNITURE_BEGINS) and word.isalpha() and not word.startswith(TEXTS)


def read(page: str) -> tuple[list[Block], Places]:
    """Blocks of a page in order, with white space folded and character references decoded, and its containers."""
    places, parts = Places(), []
    found = list(_blocks(page, places, parts))
    if parts:
        _decide(found, parts)
    return found, places


def _decide(found: list[Block], parts: list[Part]) -> None:
    """Marks the blocks of those elements that are furniture by what they hold."""
    total, linked, free = ([0] * len(parts) for _ in range(3))
    for b in found:
        if not b.furniture and b.within >= 0:
            i = b.within
            total[i], linked[i], free[i] = total[i] + len(b.text), linked[i] + b.linked, free[i] + _free(b)
    for i in range(len(parts) - 1, -1, -1):
        up = parts[i].up
        if up >= 0:
            total[up], linked[up], free[up] = total[up] + total[i], linked[up] + linked[i], free[up] + free[i]
    everything = sum(_free(b) for b in found if not b.furniture)
    dropped = [False] * len(parts)
    for i, part in enumerate(parts):
        dropped[i] = part.up >= 0 and dropped[part.up]
        if part.rule == "unless most":
            dropped[i] |= 2 * free[i] < everything
        elif part.rule == "unless half":
            dropped[i] |= 2 * free[i] < (free[part.article] if part.article >= 0 else everything)
        elif part.rule == "unless text":
            dropped[i] |= free[i] < LEAST_TEXT or linked[i] > MOST_LINKED * total[i]
    for b in found:
        b.furniture = b.furniture or b.within >= 0 and dropped[b.within]


def _blocks(page: str, places: Places, parts: list[Part]) -> Iterator[Block]:
    """Blocks of the page; containers are added to ``places``, elements that are furniture by what they hold to ``parts``."""
    # open elements: tag, container, furniture, the article's part (-1: in none), within a link, innermost part
    stack: list[tuple[str, int, bool, int, bool, int]] = [("", 0, False, -1, False, -1)]
    text: list[str] = []
    linked = 0
    at = 0

    def block() -> Iterator[Block]:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                yield Block(stack[-1][1], stack[-1][5], joined, min(linked, len(joined)), stack[-1][2])
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if stack[-1][4]:
            linked += len(piece.strip())

    while at < len(page):
        m = _markup.search(page, at)
        if not m:
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in BLOCKS:
                yield from block()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth and not any(stack[i][0] in CONTAINERS for i in range(depth + 1, len(stack)) if tag not in CONTAINERS):
                if stack[-1][2] != stack[depth - 1][2]:
                    yield from block()
                del stack[depth:]
            continue
        if tag in BLOCKS:
            yield from block()
        elif tag == "br":
            add(" ")
        if tag in RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = close + 1 if close >= 0 else len(page)
            continue
        if tag in VOID or m["rest"].endswith("/>") and tag in ("svg", "path", "use"):
            continue
        if tag in IMPLIED or tag in BLOCKS:
            # a block ends an open paragraph; a list item or cell ends the one before
            ends, stop = IMPLIED.get(tag, (frozenset({"p"}), frozenset()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in stop or stack[i][0] in CONTAINERS and stack[i][0] not in ends and not stop:
                    break
        attributes = _attributes(m["rest"].rstrip("/>"))
        _, place, furniture, article, in_link, within = stack[-1]
        rule = "" if furniture else _is_furniture(tag, attributes, article >= 0)
        now = furniture or rule == "always"
        if rule.startswith("unless"):
            parts.append(Part(rule, within, article))
            within = len(parts) - 1
        if not now and (tag in ("article", "main") or attributes.get("role") == "main"):
            parts.append(Part("article", within, article))
            within = article = len(parts) - 1
        if now != furniture:
            yield from block()
        stack.append((tag, places.open(place, _step(tag, attributes)) if tag in CONTAINERS and not now else place, now, article, in_link or tag == "a", within))
    if at < len(page):
        add(page[at:])
    yield from block()


def clean(blocks: list[Block]) -> list[Block]:
    return [b for b in blocks if not b.furniture]


def best_path(blocks: list[Block], places: Places) -> tuple[int, float]:
    """The kind of the best container and its score: the free text it holds.

    From the whole page downwards, as long as one part holds all of its free text, down to the first article or main.
    Parts of a text, as lists, are not gone into.
    """
    held = places.sums(clean(blocks))
    whole = {}  # of each kind, the first part that holds all of it
    for k in range(len(held) - 1, 0, -1):
        if held[k] == held[places.above[k]] and places.step[k].split(".")[0] in LEADING:
            whole[places.above[k]] = k
    here = 0
    while held[here] and here in whole and not places.is_article(here):
        here = whole[here]
    return here, float(held[here])


#: Containers that may be the main one.
LEADING = frozenset("html body main article section div center table tbody thead tfoot tr td th".split())


def _free(block: Block) -> int:
    return max(0, len(block.text) - 2 * block.linked)


def main_text(page: str, paths: list[str]) -> tuple[str, str]:
    """Text of the main container of a page and its path: of the host's ``paths`` the one that fits, else the page's own best.

    The host's first path of a template (it names a class, one container of the page has it and several blocks are in
    it) decides, but not against an article, and not where several containers have it, as teasers do. Of other paths the one
    that covers the page's free text best is taken if it covers LEAST_COVERED of it. Whatever its length, a page is read once
    and its containers are gone through a fixed number of times.
    """
    blocks, places = read(page)
    kept = clean(blocks)
    best = best_path(blocks, places)[0]
    held = places.sums(kept)
    # main text belongs to the container around the main one, whose other parts (heading, lead, further sections) go with it; articles stand alone
    around = lambda kind: kind if not kind or places.is_article(kind) else places.above[kind]
    fits: list[tuple[float, int, int]] = []
    own = None
    for path in filter(None, paths):
        kind = places.find(path)
        if kind is None:
            continue
        below = places.under(kind)
        under = [b for b in kept if below[places.kind[b.place]]]
        if not under:
            continue
        template = "." in path.rsplit("/", 1)[-1] and places.kind.count(kind) == 1 and len(under) >= LEAST_BLOCKS
        if not fits and template and held[kind] >= LEAST_OF_TEMPLATE * held[0] and not _has_article_outside(kept, places, below, held[kind]):
            own = kind
            break
        fits.append((held[around(kind)] / held[0] if held[0] else 1.0, path.count("/"), kind))
    if own is None:
        covered, _, own = max(fits, default=(0.0, 0, best))
        if covered < LEAST_COVERED:
            own = best
    inside = places.under(own if own == best else around(own))
    return "\n".join(b.text for b in kept if inside[places.kind[b.place]]), places.path(own)


def _has_article_outside(blocks: list[Block], places: Places, below: list[bool], there: int) -> bool:
    """Whether articles or mains have more free text outside of a container (the kinds ``below``) than is in it (``there``)."""
    inner = [places.is_article(k) for k in range(len(places.step))]
    for k in range(1, len(inner)):
        inner[k] = inner[k] or inner[places.above[k]]
    return sum(_free(b) for b in blocks if inner[places.kind[b.place]] and not below[places.kind[b.place]]) > there


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """``host``, ``paths`` (those with most votes first) from one vote of each page for its best container.

    Votes are added up before the shuffle; a host has few paths, so none grows with its number of pages.
    """

    def run(host, page):
        found = [(read_, *best_path(*read_)) for read_ in map(read, page.to_pylist())]
        return host, pa.array([read_[1].path(kind) for read_, kind, _ in found], type=pa.string()), pa.array([s for *_, s in found], type=pa.float64())

    source = pages.select(host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).where("host <> ''")
    cast = by_batch(source, run, "host string, path string, score double").where("score > 0")
    counted = cast.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    ranked = counted.withColumns({"place": F.row_number().over(order), "all": F.sum("n").over(Window.partitionBy("host"))})
    won = ranked.where((F.col("place") == 1) | (F.col("n") >= LEAST_VOTES * F.col("all")))  # at most 1 + 1 / LEAST_VOTES a host
    return won.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` and ``path`` (where the text was found) of every page.

    Null and empty pages have an empty text. Pages without a host in their url use their own path. Repeated rows
    stay repeated. Columns other than ``page_id``, ``url`` and ``html`` are not carried.
    """
    chosen = materialize(votes(pages), "paths")
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of("url").alias("host"))
    with_paths = source.join(chosen, "host", "left").select("page_id", "url", "html", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))

    def run(page_id, url, page, paths):
        found = [main_text(x, y) for x, y in zip(page.to_pylist(), paths.to_pylist(), strict=True)]
        texts = [x for x, _ in found]
        return page_id, url, pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64()), pa.array([x for _, x in found], type=pa.string())

    kind = source.schema["page_id"].dataType.simpleString()
    return by_batch(with_paths, run, f"page_id {kind}, url string, text string, n_chars long, path string")

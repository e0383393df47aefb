"""HTML extraction by tag-path ratios.

Text length and punctuation are added up per root-to-leaf tag path, divided by the path's nodes, smoothed over the paths in
page order, fused to one score and cut at a threshold. The nodes above it only show where the article is: all blocks of the
article or main element around them are taken, short ones too. Without such an element their common ancestor is taken, and
what stands next to it and belongs to it (see reach). A class or id that names boilerplate removes an element unless the
article is inside it (see release).
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names and name parts, as HTML defines them or pages use them: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas textarea title select annotation annotation-xml".split())
ASIDE = frozenset("nav header footer aside form menu button dialog head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
ROLES = re.compile(r"""\brole\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|form|menu|menubar|dialog|alert)\b""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice\w*|alert\w*|popup\w*|modal|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumbs?|sidebars?|side|widgets?|footer\w*|header|masthead|comments?(?:list|area|body|form|thread|box|section|wrap\w*)?|disqus\w*|replies|reply|respond|related|recommend\w*|share|sharing|social|tags|pagination|pager|toolbar|search|skip|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<?[^<]*", re.S)
#: A tag: quotes delimit a value only behind its equals sign; nothing is tried twice, so a scan is linear.
OPENS = re.compile(r"</?[a-zA-Z]")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: Names that are boilerplate outside an article; inside, only whole class or id words of elements that are no text element count.
WEAK = frozenset("search side social header tags legal skip menu banner login signup reply respond widget".split())
#: Names that no wrapper of an article has: such an element needs a heading or an article inside to be let in again.
HARD = re.compile(r"(?:^|[\s_-])(?:footer\w*|copyright|comments?\w*|disqus\w*|cookies?|consent|gdpr|breadcrumbs?|pagination|pager|related|newsletter|legal|disclaimer)(?:$|[\s_-])", re.I)
#: Levels of a tree; elements that are nested deeper stand side by side on the last one.
DEPTH = 256
#: Class and id words that say what an element has, not what it is.
HAS = re.compile(r"\S*?(?<![^\s_-])(?:has|with|without|no)[_-]\S*", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")
MAIN = frozenset(("article", "main"))
#: Elements that hold text of an article, not parts of a layout.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 hgroup p ul ol dl table blockquote pre figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element; ``boiler`` if it or one above is boilerplate for certain, ``named`` the nearest that is so by its name only,
    ``hard`` if its name is one of ``HARD``.

    ``opener`` is the element that was open when it began, ``parent`` the one above it in the tree, ``main`` the outermost article
    or main element, ``path`` the number of its tag path, ``link`` whether it is or stands in one.
    """

    __slots__ = ("tag", "opener", "parent", "depth", "boiler", "named", "hard", "main", "path", "link")

    def __init__(self, tag: str, opener: Node | None, boiler: bool, named: str, paths: dict[tuple, int]):
        self.tag, self.opener = tag, opener
        self.parent = opener.parent if opener and opener.depth >= DEPTH else opener
        above = self.parent
        self.depth = above.depth + 1 if above else 0
        self.boiler = boiler or (opener is not None and opener.boiler)
        self.named, self.hard = self if named else opener.named if opener else None, named == "hard"
        self.main = (opener.main if opener else None) or (self if tag in MAIN else None)
        self.link = tag == "a" or (opener is not None and opener.link)
        self.path = paths.setdefault((above.path if above else -1, tag), len(paths))


def is_boiler(tag: str, attributes: str) -> bool:
    if tag in ASIDE or tag in RAW:
        return True
    if not attributes or tag in MAIN or tag in ("body", "html"):
        return bool(attributes and HIDDEN.search(attributes))
    return bool(ROLES.search(attributes) or HIDDEN.search(attributes))


def is_named(tag: str, attributes: str, inside: bool = False) -> str:
    """"hard" or "soft" if a class or an id names boilerplate, else "". Inside an article weak names count only as whole words
    of elements that are no text element: a paragraph on search or a part on social science is the article's own."""
    if not attributes or tag in MAIN or tag in ("body", "html"):
        return ""
    kind = ""
    for x, y, z in NAMED.findall(attributes):
        value = HAS.sub(" ", x or y or z)
        if inside:
            words = value.split()
            value = " ".join(w for w in words if w.lower() not in WEAK and not any(part in WEAK for part in re.split("[_-]", w.lower())))
            if tag not in TEXTUAL and any(w.lower() in WEAK for w in words):
                kind = "soft"
        if BOILER.search(value):
            kind = "soft"
            if HARD.search(value):
                return "hard"
    return kind


def text_nodes(page: str) -> Iterator[tuple[Node, str, bool]]:
    """(element, raw text, whether a block border comes before) in page order, of what can be seen at all."""
    paths: dict[tuple, int] = {}
    at, node, broken = 0, Node("", None, False, "", paths), True
    size, tags = len(page), TAG
    opened: dict[str, int] = {}  # how many elements of a name are open
    while at < size:
        if not OPENS.match(page, at):
            match = PIECE.match(page, at)
            piece = match.group()
            if not piece:
                break
            at = match.end()
            if piece[0] != "<" or piece[1:2] not in ("!", "?"):
                yield node, piece, broken
                broken = False
            continue
        tag = tags.match(page, at)
        if not tag and tags is TAG:
            # A quote that never ends: from here on tags end at the next sign that closes one.
            tags = BARE_TAG
            tag = tags.match(page, at)
        if not tag:
            break  # a tag that the page's end cuts off
        at = tag.end()
        name, attributes = tag[2].lower(), tag[3]
        broken = broken or name not in INLINE
        if tag[1]:
            found = node if opened.get(name) else None
            while found and found.opener and found.tag != name:
                if name in INLINE and found.tag not in INLINE:
                    found = None
                    break
                found = found.opener
            if found and found.opener:
                node = close(node, found.opener, opened)
            continue
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in CLOSES_P or name in CLOSES:
            while node.tag in INLINE and node.opener:  # a formatting element that was left open ends with its block
                node = close(node, node.opener, opened)
            closing, scopes = CLOSES.get(name, ("p",)), SCOPES.get(name, ())
            found = node if any(opened.get(c) for c in closing) else None
            steps = 0
            while found and found.opener and steps < DEPTH and found.tag not in closing and found.tag not in scopes and (name in CLOSES or found.tag in INLINE):
                found, steps = found.opener, steps + 1
            if found and found.opener and found.tag in closing:
                node = close(node, found.opener, opened)
        if name in VOID or attributes.endswith("/"):
            continue
        node = Node(name, node, is_boiler(name, attributes), is_named(name, attributes, node.main is not None), paths)
        opened[name] = opened.get(name, 0) + 1


def close(node: Node, upto: Node, opened: dict[str, int]) -> Node:
    """Close the open elements from ``node`` up to, but not, ``upto``."""
    while node is not upto:
        opened[node.tag] -= 1
        node = node.opener
    return upto


def path_scores(blocks: list[tuple[int | str, int, int]], spread: float = 1.0) -> dict[int | str, float]:
    """Of (path, characters, punctuation) of text nodes: each path's smoothed and fused ratio.

    Length and punctuation of a path are divided by the root of its number of nodes, so that many short nodes count
    little; paths stand in the order of their first nodes and are smoothed with a Gaussian.
    """
    total: dict[int | str, list[float]] = {}
    for path, chars, marks in blocks:
        x = total.setdefault(path, [0, 0, 0])
        x[0] += chars
        x[1] += marks
        x[2] += 1
    paths = list(total)
    ratios = [(c / math.sqrt(n), m / math.sqrt(n)) for c, m, n in total.values()]
    near = [math.exp(-(d * d) / (2 * spread * spread)) for d in range(3)]
    scores = {}
    for i, path in enumerate(paths):
        seen = [(near[abs(j - i)], ratios[j]) for j in range(max(0, i - 2), min(len(paths), i + 3))]
        weight = sum(w for w, _ in seen)
        length, marks = (sum(w * r[k] for w, r in seen) / weight for k in (0, 1))
        own_length, own_marks = ratios[i]
        scores[path] = math.sqrt((own_length + length) / 2) * (1 + math.log1p((own_marks + marks) / 2))
    return scores


class Block:
    """Text between block borders: the block element it stands in, the elements above that (``above``), and its links' length."""

    __slots__ = ("node", "text", "linked", "home", "above")

    def __init__(self, node: Node, text: str, linked: int, known: dict[Node, list[Node]]):
        self.node, self.text, self.linked, self.home = node, text, linked, node
        while self.home.parent and self.home.tag in INLINE:
            self.home = self.home.parent
        if self.home not in known:
            known[self.home] = lineage(self.home)
        self.above = known[self.home]

    @property
    def main(self) -> Node | None:
        """The outermost article or main element around it."""
        return self.home.main


def blocks_of(pieces: list[tuple[Node, str, bool]], released: set[Node]) -> tuple[list[Block], set[int]]:
    """The blocks that are not boilerplate, and the numbers of those that boilerplate text stands before."""
    runs: list[tuple[Node | None, list[tuple[Node, str]]]] = []
    for node, raw, broken in pieces:
        if dropped(node, released):
            if broken or not runs:
                runs.append((None, [(node, raw)]))
            continue
        if broken or not runs or runs[-1][0] is None:
            runs.append((node, [(node, raw)]))
        else:
            runs[-1][1].append((node, raw))
    blocks, after, known = [], set(), {}
    for first, parts in runs:
        text = " ".join(html.unescape("".join(raw for _, raw in parts)).split())
        if text and first is None:
            after.add(len(blocks))
        elif text:
            linked = sum(len(" ".join(raw.split())) for node, raw in parts if node.link)
            blocks.append(Block(first, text, linked, known))
    return blocks, after


def dropped(node: Node, released: set[Node]) -> bool:
    if node.boiler:
        return True
    named = node.named
    while named and named in released:
        named = named.parent.named
    return named is not None


def values(blocks: list[Block]) -> list[float]:
    """The score of each block's path. An article element is the page's own word for where its text is: paths outside it have none."""
    scores = path_scores([(b.home.path, len(b.text), len(PUNCTUATION.findall(b.text))) for b in blocks])
    mains = [b.main is not None for b in blocks]
    marked = any(mains)
    return [scores[b.home.path] if inside or not marked else 0.0 for b, inside in zip(blocks, mains, strict=True)]


def release(pieces: list[tuple[Node, str, bool]], share: float) -> set[Node]:
    """Elements with a name of boilerplate that hold the article: what is outside of them scores below the threshold.

    An element with the page's only article or main inside needs to come to the threshold itself. They are looked for from
    outside in, the best first, so that comments beside a released article stay out.
    """
    released: set[Node] = set()
    everything = {n for node, _, _ in pieces if not node.boiler for n in (node.named,) if n}
    if not everything:
        return released
    for node in list(everything):
        while node := node.parent.named:
            everything.add(node)
    blocks = blocks_of(pieces, everything)[0]
    inside: dict[Node, list[Block]] = {}
    for block in blocks:
        for node in lineage(block.node):
            if node in everything:
                inside.setdefault(node, []).append(block)
    best = {node: max(values(held)) for node, held in inside.items()}
    sole = {node: len({b.main for b in held} - {None}) == 1 and not any(n.tag in MAIN for n in lineage(node)) for node, held in inside.items()}
    while True:
        free = [b for b in blocks if not dropped(b.node, released)]
        marked = any(b.main for b in free)
        limit = max(values(free), default=0.0)
        fit = []
        for node, held in inside.items():
            if node in released or dropped(node.parent, released):
                continue
            if node.hard and not any(b.main or any(n.tag == "h1" for n in b.above) for b in held):
                continue
            value = best[node] if not marked or any(b.main for b in held) else 0.0
            if share * value > limit or (sole[node] and not marked and value >= share * limit):
                fit.append((sole[node] and not marked, value, node))
        if not fit:
            return released
        released.add(max(fit, key=lambda x: x[:2])[2])


def reach(blocks: list[Block], after: set[int], region: Node) -> list[Block]:
    """The blocks of a region without an article element, and those around it that belong to the same text.

    From the region outwards, the children of each ancestor are taken on both sides as far as no boilerplate, no list of
    links and no part of the layout comes between: text elements as they are, a layout element before the region if it
    holds the title or the title stands farther out, one behind it if it holds text elements without a heading.
    """
    held = [i for i, b in enumerate(blocks) if region in b.above]
    low, high = held[0], held[-1] + 1
    title = next((i for i in range(low - 1, -1, -1) if any(n.tag == "h1" for n in blocks[i].above)), None)
    has_title = any(n.tag == "h1" for i in held for n in blocks[i].above)
    top = region
    open_low, open_high = True, True

    def parts(at: int, step: int) -> tuple[Node, list[Block]]:
        """The child of the ancestor that a block stands in, and its blocks from there on."""
        block = blocks[at]
        child = block.above[block.above.index(top) - 1] if block.above[0] is not top else top
        out = []
        while 0 <= at < len(blocks) and top in blocks[at].above and (child in blocks[at].above if child is not top else blocks[at].above[0] is top):
            out.append(blocks[at])
            at += step
        return child, out

    def plain(found: list[Block]) -> bool:
        return 2 * sum(b.linked for b in found) <= sum(len(b.text) for b in found)

    while top.parent and (open_low or open_high):
        top = top.parent
        outer = top.tag in ("body", "html", "")
        while open_low and low and top in blocks[low - 1].above:
            child, found = parts(low - 1, -1)
            from_ = low - len(found)
            titled = title is not None and not has_title and title < low and title >= (from_ if outer else 0)
            if any(i in after for i in range(from_ + 1, low + 1)) or not plain(found) or not (child.tag in TEXTUAL or titled):
                open_low = False
            else:
                low = from_
        while open_high and high < len(blocks) and top in blocks[high].above:
            child, found = parts(high, 1)
            loose = any(n.tag in HEADINGS for b in found for n in b.above) or not all(any(n.tag in TEXTUAL for n in b.above) for b in found)
            if any(i in after for i in range(high, high + len(found))) or not plain(found) or not (child.tag in TEXTUAL or not (outer or loose)):
                open_high = False
            else:
                high += len(found)
    return blocks[low:high]


def main_text(page: str | None, share: float = 0.4) -> str:
    """The article of a page: blocks in page order, white space as one space. Null, empty or textless pages give ""."""
    if not page:
        return ""
    pieces = list(text_nodes(page))
    blocks, after = blocks_of(pieces, release(pieces, share))
    if not blocks:
        return ""
    value = values(blocks)
    limit = share * max(value)
    chosen = [b.home for b, v in zip(blocks, value, strict=True) if v >= limit and v > 0]
    region = chosen[0].parent or chosen[0]
    for node in chosen:
        above = set(lineage(node))
        while region not in above:
            region = region.parent
    mains = [n for n in lineage(region) if n.tag in MAIN]
    if mains:
        # The nearest such element, or one around it that holds no other.
        region = mains[0]
        for wider in mains[1:]:
            if all(region in b.above or not any(n.tag in MAIN for n in b.above[: b.above.index(wider)]) for b in blocks if wider in b.above):
                region = wider
    taken = [b for b in blocks if region in b.above] if mains or any(b.main for b in blocks) else reach(blocks, after, region)
    return " ".join(b.text for b in taken)


def lineage(node: Node) -> list[Node]:
    out = []
    while node:
        out.append(node)
        node = node.parent
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; see main_text. Null ids and urls stay null, repeated rows are kept,
    other columns are ignored, and an empty table gives an empty result. Pages are read whole; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.record_batch({
                    "page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                })

    cast = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cast.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by tag-path ratios.

A tolerant reader cuts a page into blocks of text, each with the path of tags from the root
to it. Elements that are never article text (scripts, navigation, asides) are left out as they
are read. Forms and elements named as adverts, comments, notices and the like are left out
when the page is known: one that holds the page's main element or first-level heading, or most
of its text where no article, main element or such heading stands outside of them all, is no
advert whatever its name. Names of paragraphs and other small parts count as whole words only. For every path the
text length and punctuation of all its blocks are aggregated; the ratios per block are
smoothed over neighbouring blocks, fused into one score, and paths whose score reaches half
a standard deviation of the page's scores are content. The smallest element around all
content blocks that is no mere part (list, quote, section) bounds the article, or the
outermost article or main element around them;
blocks under the parents of content paths or of the bounding element, such as headings and
short paragraphs, belong to it unless they are mostly links. No content block is left out,
except those outside main elements that hold ``HOLDS`` of the content text.

Every page is read whole, in its task; nothing is shuffled. Null, empty and text-free pages
give an empty text. Broken markup never fails: unknown end tags are ignored, open elements
end with the page, a tag that the page's end cuts off is no text. Repeated rows give repeated rows, an empty table an empty one; only
``page_id``, ``url`` and ``html`` are read, so further columns are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, with raw content, that break a text, and whose start ends another.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split()
)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
SCOPE = frozenset("table td th caption button object".split())
# Elements that hold no article text, and words in class, id or role that say the same.
DROPPED = frozenset("script style nav aside footer header noscript template button select textarea iframe svg math canvas menu dialog head title object audio video".split())
NAMED = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner sidebar aside comment comments commentlist disqus "
    "reply replies respond cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup signin login menu navbar nav navigation "
    "navigations breadcrumb breadcrumbs footer masthead related recommended recommendations share sharing social popup modal overlay toolbar pagination pager paywall "
    "complementary contentinfo skiplink copyright disclaimer".split()
)
# Elements that only their class tells apart; its words belong to the path.
GENERIC = frozenset("div section td".split())
PAGE_HEAD = frozenset("header topbar".split())
PAGE = ("", "html", "body", "html/body")
GENERIC_STEP = re.compile(r"/(?:div|section|td)\b")
KEPT = frozenset("html body main".split())
# Elements that are a whole article, and such that are only a part of one.
WHOLE = frozenset("article main".split())
PARTS = frozenset("p pre ul ol li dl dt dd blockquote figure figcaption section h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>|<[a-zA-Z/][^<>]*+\Z", re.S
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/]|$)|hidden\s*=|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")
PUNCTUATION = re.compile(r"[^\w\s]")
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int"
SMOOTH = (0.25, 0.5, 0.25)
THRESHOLD = 0.5
HOLDS = 0.6
MOST = 0.5
# What tells where the article is.
SIGNS = frozenset("article main h1".split())


def _named(attributes: str) -> set[str]:
    """Words of class, id and role; a word after has, with or no does not count."""
    words: set[str] = set()
    for match in NAMES.finditer(attributes):
        for value in html.unescape(match[2] or match[3] or match[4] or "").split():
            parts = [p.lower() for p in CAMEL.split(value) if p]
            words.update(p for i, p in enumerate(parts) if not (i and parts[i - 1] in ("has", "with", "no", "without")))
    return words


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is left out whatever it holds."""
    if tag in KEPT:
        return False
    if tag in DROPPED:
        return not (tag == "header" and in_article)
    return bool(attributes) and bool(HIDDEN.search(attributes))


def _doubtful(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is left out unless the page has its article there."""
    if tag in KEPT:
        return False
    if tag == "form":
        return True
    if "=" not in attributes:
        return False
    if tag in PARTS and tag != "section":
        # a paragraph on copyright law is no copyright notice
        words = {w.lower() for m in NAMES.finditer(attributes) for w in html.unescape(m[2] or m[3] or m[4] or "").split()}
        return bool(words & NAMED)
    words = _named(attributes)
    return bool(words & NAMED) or bool(words & PAGE_HEAD and not in_article)


def blocks(page: str) -> list[tuple[tuple[int, ...], str, str, int]]:
    """Blocks in page order: ids of the elements around it, tag path, text, characters in links."""
    found, doubted = _read(page)
    if not doubted:
        return [block[:4] for block in found]
    total = sum(len(text) for _, _, text, *_ in found)
    held: dict[int, int] = defaultdict(int)
    signed: set[int] = set()  # doubtful elements around a main element or first-level heading
    signs_outside = False
    for elements, path, text, _, doubtful in found:
        tags = {t.partition(".")[0] for t in path.split("/")}
        for n in doubtful:
            held[n] += len(text)
        signs_outside |= not doubtful and bool(tags & SIGNS)
        # a heading within a doubtful element is a sign for the elements around it
        signed.update(n for n in doubtful if any(t in ("h1", "main") and e > n for t, e in zip(path.split("/"), elements, strict=True)))
    kept = {n for n in held if n in signed or (not signs_outside and held[n] >= MOST * total)}
    return [block[:4] for block in found if kept.issuperset(block[4])]


def _read(page: str) -> tuple[list[tuple[tuple[int, ...], str, str, int, tuple[int, ...]]], bool]:
    """All blocks with the ids of the doubtful elements around them, and whether there are any."""
    found: list[tuple[tuple[int, ...], str, str, int, tuple[int, ...]]] = []
    stack: list[tuple[str, int, bool, str, bool]] = []  # tag, element id, whether it is an article, class in paths, whether it is doubtful
    text: list[str] = []
    linked = at = number = links = articles = doubts = paragraphs = 0
    dropping = 0  # height of the stack at which leaving out ends; 0: not leaving out
    ever = False

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                around = [(t + label, n) for t, n, _, label, _ in stack if t not in INLINE]
                unsure = tuple(n for _, n, _, _, doubtful in stack if doubtful) if doubts else ()
                found.append((tuple(n for _, n in around), "/".join(t for t, _ in around), whole, min(linked, len(whole)), unsure))
            text.clear()
        linked = 0

    def cut(height: int) -> None:
        nonlocal dropping, links, articles, doubts, paragraphs
        if any(t not in INLINE for t, *_ in stack[height:]) and not dropping:
            flush()
        for tag, _, article, _, doubtful in stack[height:]:
            links -= tag == "a"
            articles -= article
            doubts -= doubtful
            paragraphs -= tag == "p"
        del stack[height:]
        if dropping and len(stack) < dropping:
            dropping = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not dropping:
            text.append(piece)
            if links:
                linked += len(piece.strip())

    position = 0
    while match := TOKEN.search(page, position):
        say(page[at : match.start()])
        at = position = match.end()
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not tag:
            if match[0].startswith("<![CDATA["):
                say(match[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if closing:
            height = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if height >= 0:
                cut(height)
            elif tag in ("br", "p") and not dropping:
                text.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, position)
            at = position = end.end() if end else len(page)
            if tag not in INLINE and not dropping:
                flush()
            continue
        if paragraphs and tag not in INLINE and tag not in VOID:
            # a block ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    cut(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            height = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bounds:
                    break
                if stack[i][0] in ended:
                    height = i
            cut(height)
        if tag in VOID:
            if not dropping:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
            continue
        if attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        doubtful = not dropping and _doubtful(tag, attributes, bool(articles))
        if not dropping and tag not in INLINE:
            flush()
        if not dropping and (_dropped(tag, attributes, bool(articles)) or doubtful and tag in INLINE):
            dropping, doubtful = len(stack) + 1, False
        number += 1
        ever = ever or doubtful
        article = tag in ("article", "main")
        links, articles, doubts, paragraphs = links + (tag == "a"), articles + article, doubts + doubtful, paragraphs + (tag == "p")
        stack.append((tag, number, article, "." + ".".join(sorted(_named(attributes))) if tag in GENERIC and "=" in attributes else "", doubtful))
    say(page[at:])
    if not dropping:
        flush()
    return found, ever


def scores(found: list[tuple[tuple[int, ...], str, str, int]]) -> dict[str, float]:
    """Path to fused score: smoothed text ratio times punctuation ratio, less what is links."""
    length, nodes, marks, links = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for _, path, text, linked in found:
        length[path] += len(text)
        nodes[path] += 1
        marks[path] += len(PUNCTUATION.findall(text))
        links[path] += linked
    ratio = {p: (length[p] / nodes[p], (1 + marks[p]) / nodes[p], 1 - links[p] / length[p]) for p in length}
    row = [ratio[path][0] for _, path, _, _ in found]
    smooth = defaultdict(list)
    for i, (_, path, _, _) in enumerate(found):
        near = [(w, row[i + d]) for d, w in zip((-1, 0, 1), SMOOTH, strict=True) if 0 <= i + d < len(row)]
        smooth[path].append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return {p: math.sqrt(t * sum(smooth[p]) / len(smooth[p])) * math.log(2 + mark) * math.log(2 + length[p]) * unlinked for p, (t, mark, unlinked) in ratio.items()}


def _bound(around: tuple[int, ...], tags: list[str], every: list[tuple[int, ...]]) -> int:
    """How many of the elements ``around`` one block lead to the one that bounds the article."""
    depth = min(next((i for i, (a, b) in enumerate(zip(around, other, strict=False)) if a != b), min(len(around), len(other))) for other in every)
    for i, tag in enumerate(tags[:depth]):
        if tag in WHOLE:
            return i + 1
    if depth == max(map(len, every)):
        depth -= depth > 0  # one element's own text
    while depth and tags[depth - 1].partition(".")[0] in PARTS:
        depth -= 1
    return depth


def main_blocks(found: list[tuple[tuple[int, ...], str, str, int]]) -> list[str]:
    """Texts of the article's blocks, in page order."""
    if not found:
        return []
    score = scores(found)
    mean = sum(score.values()) / len(score)
    deviation = math.sqrt(sum((s - mean) ** 2 for s in score.values()) / len(score))
    content = {p for p, s in score.items() if s >= min(max(score.values()), THRESHOLD * deviation + 0.25 * max(score.values())) and s > 0}
    within = [(elements, path.split("/"), len(text)) for elements, path, text, _ in found if path in content]
    if not within:
        return []
    # a page that names its main part says that the rest is none
    of_main = [block for block in within if "main" in block[1]]
    if sum(n for *_, n in of_main) >= HOLDS * sum(n for *_, n in within):
        within = of_main
    around, tags, _ = within[0]
    depth = _bound(around, tags, [elements for elements, *_ in within])
    bound = "/".join(tags[:depth])
    parents = {path.rpartition("/")[0]: path.rpartition("/")[0] in PAGE for path in content}
    parents.setdefault(bound, not depth or tags[depth - 1] not in WHOLE)
    kept = []
    for elements, path, text, linked in found:
        if elements[:depth] != around[:depth]:
            continue
        beside = any(path == p or path.startswith(f"{p}/") and not (flat and GENERIC_STEP.search(path, len(p))) for p, flat in parents.items())
        if path in content or (beside and linked < 0.5 * len(text)):
            kept.append(text)
    return kept


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, main ``text``, its code points, and the numbers of blocks read and kept."""

    def run(batches):
        for batch in batches:
            out = []
            for page in batch.column(2).to_pylist():
                found = blocks(page or "")
                kept = main_blocks(found)
                out.append((" ".join(kept), len(found), len(kept)))
            texts = [t for t, _, _ in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                    pa.array([n for _, n, _ in out], pa.int32()), pa.array([n for _, _, n in out], pa.int32()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, SCHEMA)

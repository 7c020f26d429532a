"""Main text of web pages by two passes of block rules (operator 10).

The first pass judges each block by its length, link density and density of
stop words. Blocks too short to judge, and those with neither many nor few stop
words, take the label of the nearest decided neighbours in the second pass.
What stands in elements made for navigation, forms, notices and the like is
decided from the start.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.scratch import map_frames

# Common function words of four languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or
    she that the their they this to was were which will with you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par
    pas pour qu que qui sa se ses son sur un une vous
    als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es
    für hat ich im in ist mit nach nicht sich sie sind so und von war wie zu zum zur
    al como con del el ella ellos en entre era es esta este fue ha las lo los más muy no o para
    pero por se sin sobre son su sus también una y ya
    """.split()
)
# Elements by their role.
SKIPPED = frozenset(
    "script style noscript template iframe object svg canvas math head title audio video "
    "select textarea button datalist".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q "
    "s samp small span strike strong sub sup time tt u var wbr br".split()
)
EMPTY = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
# Words of a class, id or role that name a part beside the article.
MARKED = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side-bar|comments?"
    r"|comment-?(?:list|section|area)|respond|disqus\w*|cookies?|consent|notices?|gdpr|popup"
    r"|modal|newsletter|subscribe|signup|social|share|sharing|menu|nav\w*|breadcrumbs?"
    r"|pagination|footer|masthead|site-header|page-header|header|toolbar|widgets?|related"
    r"|recommend\w*|complementary|contentinfo|search)(?![a-z])"
)
PLAIN_HEADER = re.compile(r"header")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
WORD = re.compile(r"\w+")

GOOD, BAD, SHORT, NEAR = 1, 0, 2, 3
SHORT_CHARS = 70  # blocks below are too short to judge
LONG_CHARS = 200  # blocks with many stop words beyond are good by themselves
MOST_LINKS = 0.33
FEW_STOPS, MANY_STOPS = 0.10, 0.20


class Block:
    """Text between two block boundaries and where it stands."""

    __slots__ = ("text", "linked", "region", "article", "boilerplate")

    def __init__(self, text: str, linked: int, region: int, article: bool, boilerplate: bool):
        self.text, self.linked = text, linked
        self.region, self.article, self.boilerplate = region, article, boilerplate


def _beside(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element holds something beside the article."""
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True
    if name in ARTICLE or name in ("html", "body") or not rest:
        return False
    if HIDDEN.search(rest):
        return True
    for found in ATTRIBUTE.finditer(rest):
        value = next(x for x in found.groups() if x is not None).lower().replace("_", "-")
        marks = MARKED.findall(value)
        if in_article:
            marks = [mark for mark in marks if not PLAIN_HEADER.fullmatch(mark)]
        if marks:
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, white space folded, empty ones left out."""
    found: list[Block] = []
    # Of every open element: name, region, in an article, beside it, in a link.
    open_: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    parts: list[str] = []
    linked, regions, skip = 0, 0, ""

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, region, article, beside, _ = open_[-1]
                found.append(Block(text, linked, region, article, beside))
            parts.clear()
            linked = 0

    for token in TOKEN.finditer(page):
        name = token["name"]
        if name is None:
            text = token[0]
            if not skip and not (text[0] == "<" and len(text) > 1):
                parts.append(text if text != "<" else "&lt;")
                if open_[-1][4]:
                    linked += len(" ".join(text.split()))
            continue
        name = name.lower()
        if skip:
            if token["end"] and name == skip:
                skip = ""
            continue
        if token["end"]:
            at = next((i for i in range(len(open_) - 1, 0, -1) if open_[i][0] == name), 0)
            if name not in INLINE:
                close_block()
            if at:
                del open_[at:]
            continue
        if name in SKIPPED:
            if name not in INLINE and name not in ("button", "select"):
                close_block()
            if not token["rest"].endswith("/"):
                skip = name
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            close_block()
            # A block element ends an open paragraph and what is open in it.
            at = next(
                (i for i in range(len(open_) - 1, 0, -1) if open_[i][0] not in INLINE), 0
            )
            if at and open_[at][0] in CLOSED_BY_BLOCK:
                del open_[at:]
        if name in EMPTY:
            continue
        _, region, article, beside, link = open_[-1]
        if not beside and _beside(name, token["rest"], article):
            beside = True
        if name in ARTICLE:
            article = True
        if name in ARTICLE or (beside and not open_[-1][3]):
            regions += 1
            region = regions
        open_.append((name, region, article, beside, link or name == "a"))
    close_block()
    return found


def _first_pass(block: Block) -> int:
    """Label of a block by itself."""
    if block.boilerplate:
        return BAD
    size = len(block.text)
    if block.linked > MOST_LINKS * size:
        return BAD
    if size < SHORT_CHARS:
        return SHORT if not block.linked or block.article else BAD
    words = WORD.findall(block.text.lower())
    share = sum(word in STOP_WORDS for word in words) / max(1, len(words))
    if share >= MANY_STOPS:
        return GOOD if size > LONG_CHARS or block.article else NEAR
    if share >= FEW_STOPS:
        return NEAR
    # Prose of a language without a word list: the element decides.
    return NEAR if block.article else BAD


def labels(found: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    label = [_first_pass(block) for block in found]
    first = list(label)
    regions: dict[int, list[int]] = {}
    for i, block in enumerate(found):
        regions.setdefault(block.region, []).append(i)
    for members in regions.values():
        article = found[members[0]].article
        before, last = {}, None
        for i in members:
            before[i] = last
            if first[i] in (GOOD, BAD):
                last = first[i]
        after, last = {}, None
        for i in reversed(members):
            after[i] = last
            if first[i] in (GOOD, BAD):
                last = first[i]
        for i in members:
            if first[i] in (GOOD, BAD):
                continue
            around = {x for x in (before[i], after[i]) if x is not None}
            if around == {GOOD}:
                label[i] = GOOD
            elif around == {BAD}:
                label[i] = GOOD if article else BAD
            elif around:
                label[i] = GOOD if article or first[i] == NEAR else BAD
            else:
                label[i] = GOOD if article or first[i] == NEAR else BAD
    return [x == GOOD for x in label]


def main_text(page: str | None) -> str:
    """Main text of one page; empty where there is none."""
    found = blocks(page or "")
    # Where a page names its article, only blocks in it can be main text.
    if any(block.article and not block.boilerplate for block in found):
        found = [block for block in found if block.article]
    return "\n\n".join(b.text for b, good in zip(found, labels(found)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row, from the whole html.

    A null or empty html has the empty text; repeated rows come out repeated.
    Broken markup never fails: an open comment or element reaches to the end.
    One row in, one row out, no shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(page) for page in frame["page_html"]]
            yield pd.DataFrame(
                {
                    "page_id": frame["page_id"],
                    "url": frame["url"],
                    "text": texts,
                    "n_chars": [len(text) for text in texts],
                }
            )

    id_kind = pages.schema["page_id"].dataType.simpleString()
    found = map_frames(
        pages.select(
            pages["page_id"].cast("string").alias("page_id"),
            "url",
            pages["html"].alias("page_html"),
        ),
        run,
        "page_id string, url string, text string, n_chars bigint",
    )
    return found.withColumn("page_id", F.col("page_id").cast(id_kind))

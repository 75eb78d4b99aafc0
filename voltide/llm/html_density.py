"""Main text of web pages by composite text density.

Every node of a page gets its characters per tag, lowered where they are link text. The densities of a node's children are summed; the
node with the largest sum lies in the main text. Of the article or main around it every block is kept, as are those of further articles.
Without one, that holds for the highest element around it of which nothing is skipped, but at least the one that holds its list, table or
section. The smallest density on the path up to the body is the threshold: parts outside must reach it, and inside, lists of links that
do not reach it are left out.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("body caption html tbody td tfoot th thead tr".split())
#: Never main text; parts of a page that are skipped unless they hold its main text.
SKIPPED = frozenset(
    "audio button canvas datalist embed head iframe input map math noscript object script select style svg template textarea title video".split()
)
ASIDES = frozenset("aside dialog footer form menu nav".split())
#: Words of classes, ids or roles that mark such a part, unless a word that denies them is before them, as in has-sidebar, or right behind.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies "
    "copyright disclaimer discussion disqus footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification overlay pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
DENIALS, DENIALS_BEHIND = frozenset("has is no not with without".split()), frozenset("free less".split())
NAME_WORD = re.compile("[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")
LANDMARKS = frozenset(("article", "main"))
#: Part of the text of the article with the main text that another article must have, or else it is a card that points elsewhere.
LEAST_ARTICLE = 0.2
#: What a page that is cut within markup ends with, and the end of the declarations inside a document type.
CUT_MARKUP = re.compile(r"<(?:[a-zA-Z!?]|/[a-zA-Z])")
SUBSET_END = re.compile(r"\]\s*>")
#: Blocks that are always a part of a larger text; blocks that are no list of links, however many they have; elements without visible text.
PARTS = frozenset("blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre section summary table tbody tfoot thead tr ul".split())
KEPT = frozenset("h1 h2 h3 h4 h5 h6 p".split()) | {"html", "body"}
UNSEEN = frozenset("head noscript script select style template textarea title".split())
#: Open elements that a new one of these kinds closes, up to the given limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


class _Tree(HTMLParser):
    """Nodes in page order: ``tags``, ``parents``, whether ``skipped``; ``texts`` are (node, text), text None where a block begins or ends.

    Only ``close`` skips the parts that are marked as ``aside``, as what they hold must be known.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.skipped, self.aside, self.open = ["#root"], [-1], [False], [False], [0]
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag, where in ``open`` it stands
        self.texts: list[tuple[int, str | None]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"td", "th", "button", "table", "object"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        parent = self.open[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.skipped.append(self.skipped[parent] or tag in SKIPPED)
        self.aside.append(tag in ASIDES or (tag == "header" and not self._in_landmark()) or (tag not in ("html", "body", "article", "main") and self._named_aside(attrs)))
        if tag in BLOCK:
            self.texts.append((parent, None))
        elif tag == "br":
            self.texts.append((parent, " "))
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, <div/> opens an element

    def handle_endtag(self, tag: str) -> None:
        if place := self._last({tag}):
            self._pop(place)

    def handle_data(self, data: str) -> None:
        self.texts.append((self.open[-1], data))

    def _last(self, kinds: set[str]) -> int:
        """Place of the innermost open element of these kinds; 0 if there is none."""
        return max((self.places[kind][-1] for kind in kinds if self.places.get(kind)), default=0)

    def _close(self, kinds: set[str], limits: set[str]) -> None:
        place = self._last(kinds)
        if place > self._last(limits - kinds):
            self._pop(place)

    def _in_landmark(self) -> bool:
        return self._last(LANDMARKS) > 0

    def _pop(self, place: int) -> None:
        gone = [self.tags[k] for k in self.open[place:]]
        if not BLOCK.isdisjoint(gone):
            self.texts.append((self.open[-1], None))
        for tag in gone:
            self.places[tag].pop()
        del self.open[place:]

    @staticmethod
    def _named_aside(attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
                return True
            if name in ("class", "id", "role") and value:
                for whole in value.split():
                    words = [word.lower() for word in NAME_WORD.findall(whole)]
                    denied = next((k for k, word in enumerate(words) if word in DENIALS), len(words))
                    if any(word in ASIDE_NAMES and behind not in DENIALS_BEHIND for word, behind in zip(words[:denied], [*words[1:], ""])):
                        return True
        return False

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """As browsers do, ``<![`` begins a comment that ends at the next ``>``."""
        return self.rawdata.find(">", i) + 1 or -1

    def parse_html_declaration(self, i: int) -> int:
        """A document type ends behind the declarations that it may hold."""
        end, inner = self.rawdata.find(">", i), self.rawdata.find("[", i)
        if self.rawdata[i : i + 9].lower() == "<!doctype" and 0 <= inner < end and (found := SUBSET_END.search(self.rawdata, inner)):
            return found.end()
        return super().parse_html_declaration(i)

    def close(self) -> None:
        """Skips the asides, but none that holds a main or half of the text in articles; on a page without either, none with most of the text outside links."""
        if self.cdata_elem is None and CUT_MARKUP.match(self.rawdata):
            self.rawdata = ""  # what is left is an element or comment that never ends
        super().close()
        tags, parents, n = self.tags, self.parents, len(self.tags)
        in_link, landmark, main = [False] * n, [False] * n, [False] * n
        plain, chars = [0] * n, [0] * n  # outside links; in landmarks
        for k in range(1, n):
            in_link[k] = tags[k] == "a" or in_link[parents[k]]
            landmark[k] = tags[k] in LANDMARKS or landmark[parents[k]]
        for k, text in self.texts:
            if text and not self.skipped[k]:
                size = len("".join(text.split()))
                plain[k] += size * (not in_link[k])
                chars[k] += size * landmark[k]
        for k in range(n - 1, 0, -1):
            main[k] |= tags[k] == "main" and chars[k] > 0
            plain[parents[k]] += plain[k]
            chars[parents[k]] += chars[k]
            main[parents[k]] |= main[k]
        for k in range(1, n):
            needed = main[k] or 2 * chars[k] >= chars[0] if chars[0] else 2 * plain[k] > plain[0]
            self.skipped[k] |= self.skipped[parents[k]] or (self.aside[k] and not needed)


def densities(tags: list[str], parents: list[int], skipped: list[bool], texts: list[tuple[int, str | None]]) -> tuple[list[float], list[float], list[int], list[int], list[int]]:
    """Of every node composite density, sum, characters, those of links, links; the sum is that of the densities of the blocks right inside a block.

    Inline elements count as tags of their block. A block without blocks inside has its own density as sum.
    """
    n = len(tags)
    around = [0] * n  # the block that holds a node
    chars, linked, counts, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = tags[k] == "a" or in_link[parents[k]]
        around[k] = parents[k] if tags[parents[k]] in BLOCK or not parents[k] else around[parents[k]]
    for k, text in texts:
        if text and not skipped[k]:
            size = len("".join(text.split()))
            chars[k] += size
            linked[k] += size * in_link[k]
    for k in range(n - 1, 0, -1):
        if not skipped[k]:
            up = parents[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            counts[up] += counts[k] + 1
            links[up] += links[k] + (tags[k] == "a")
    share = linked[0] / chars[0] if chars[0] else 0.0
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if chars[k] and not skipped[k]:
            c, t = chars[k], max(1, counts[k])
            base = math.log(c / max(1, c - linked[k]) * linked[k] + share * c + math.e)
            density[k] = c / t * max(0.0, math.log(c / max(1, linked[k]) * t / max(1, links[k]))) / base
            if k == 0 or tags[k] in BLOCK:
                sums[k] = sums[k] or density[k]
                if k:
                    sums[around[k]] += density[k]
    return density, sums, chars, linked, links


def main_nodes(tree: _Tree, density: list[float], sums: list[float], chars: list[int], linked: list[int], links: list[int]) -> tuple[set[int], set[int]]:
    """Roots of the subtrees that hold the main text, and roots of what is left out below them."""
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    if not chars[0]:
        return set(), set()
    best = max((k for k in range(n) if chars[k]), key=lambda k: (sums[k], -k))
    inside = [False] * n  # an article or main is around it
    for k in range(1, n):
        inside[k] = inside[parents[k]] or tags[parents[k]] in LANDMARKS
    marks = [k for k in range(n) if tags[k] in LANDMARKS and chars[k] and not inside[k]]
    top = next((k for k in _upward(parents, best) if tags[k] in LANDMARKS and not inside[k]), None)
    if top is None and len(marks) == 1 and 2 * chars[marks[0]] > chars[best]:  # the sum of the whole page won over its only article
        best = top = marks[0]
    page = next((k for k in _upward(parents, best) if tags[k] == "body"), 0)
    threshold = min(density[k] for k in _until(parents, best, page))
    aside = _link_lists(tree, density, chars, linked, links, threshold)
    cards = _cards(tree, best, chars, linked)
    if top is not None:
        found = {k for k in marks if k == top or k not in aside | cards}
    else:
        root = next(k for k in _until(parents, best, page) if tags[k] not in PARTS or k == page)
        apart = _skipped_chars(tree)
        root = [root, *(k for k in _until(parents, root, page) if not apart[k])][-1]
        found = {root} | _dense(parents, density, sums, chars, threshold, page, root)
    path = set(_upward(parents, best))
    below = [False] * n  # the node with the largest sum is kept whole
    for k in range(1, n):
        below[k] = below[parents[k]] or k == best
    return found, {k for k in aside if k not in path and k not in found and not below[k]} | cards


def _cards(tree: _Tree, best: int, chars: list[int], linked: list[int]) -> set[int]:
    """Articles that do not hold ``best`` and have little text outside links next to the one that does, or to the largest in the main that does."""
    tags, parents = tree.tags, tree.parents
    path = list(_upward(parents, best))
    plain = [c - x for c, x in zip(chars, linked)]
    others = [k for k in range(len(tags)) if tags[k] == "article" and chars[k] and k not in path] if "article" in tags else []
    home = next((k for k in path if tags[k] in LANDMARKS), None)
    if not others or home is None:
        return set()
    most = plain[home]
    if tags[home] == "main":
        inside = set()  # nodes below the main
        for k in range(home, len(tags)):
            if k == home or parents[k] in inside:
                inside.add(k)
        most = max((plain[k] for k in others if k in inside), default=0)
    return {k for k in others if plain[k] < LEAST_ARTICLE * most}


def _dense(parents: list[int], density: list[float], sums: list[float], chars: list[int], threshold: float, page: int, root: int) -> set[int]:
    """Outside ``root``, of each part that reaches the threshold the node with the largest sum."""
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[parents[k]].append(k)
    around = set(_upward(parents, root))
    most = list(range(n))  # of each subtree, the node with the largest sum
    for k in range(n - 1, 0, -1):
        up = parents[k]
        if (sums[most[k]], -most[k]) > (sums[most[up]], -most[up]):
            most[up] = most[k]
    found, todo = set(), [page]
    while todo:
        k = todo.pop()
        if k == root or k in found:
            continue
        if k not in around and density[k] >= threshold and chars[k]:
            found.add(most[k])
            if most[k] == k:
                continue
        todo.extend(children[k])
    return found


def _link_lists(tree: _Tree, density: list[float], chars: list[int], linked: list[int], links: list[int], threshold: float) -> set[int]:
    """Blocks of two links or more that are thinner than the threshold and hold no block or text of their own that is not mostly link text."""
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    block, in_link, own = list(range(n)), [False] * n, [0] * n  # own: characters in no block further down, those of links subtracted
    for k in range(1, n):
        in_link[k] = tags[k] == "a" or in_link[parents[k]]
        block[k] = k if tags[k] in BLOCK else block[parents[k]]
    for k, piece in tree.texts:
        if piece and not tree.skipped[k]:
            own[block[k]] += len("".join(piece.split())) * (-1 if in_link[k] else 1)
    text = [k > 0 and tags[k] in BLOCK and own[k] > 0 for k in range(n)]
    for k in range(n - 1, 0, -1):
        text[parents[k]] |= text[k]
    return {k for k in range(1, n) if tags[k] in BLOCK and tags[k] not in KEPT and links[k] > 1 and not text[k] and 2 * linked[k] > chars[k] and density[k] < threshold}


def _skipped_chars(tree: _Tree) -> list[int]:
    """Characters of every node's subtree that could be seen but are skipped."""
    unseen, out = [False] * len(tree.tags), [0] * len(tree.tags)
    for k, up in enumerate(tree.parents):
        unseen[k] = tree.tags[k] in UNSEEN or (k > 0 and unseen[up])
    for k, text in tree.texts:
        if text and tree.skipped[k] and not unseen[k]:
            out[k] += len("".join(text.split()))
    for k in range(len(out) - 1, 0, -1):
        out[tree.parents[k]] += out[k]
    return out


def _upward(parents: list[int], k: int) -> Iterator[int]:
    while k >= 0:
        yield k
        k = parents[k]


def _until(parents: list[int], k: int, last: int) -> Iterator[int]:
    """From ``k`` upwards to ``last``, which is around it or ``k`` itself."""
    for up in _upward(parents, k):
        yield up
        if up == last:
            return


def main_text(html: str | None) -> str:
    """Blocks of the main text in page order, joined by two line feeds; empty if there is none."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tags, parents, skipped = tree.tags, tree.parents, tree.skipped
    density, sums, chars, linked, links = densities(tags, parents, skipped, tree.texts)
    found, left_out = main_nodes(tree, density, sums, chars, linked, links)
    wanted = [False] * len(tags)
    for k, up in enumerate(parents):
        wanted[k] = (k in found or (up >= 0 and wanted[up])) and not skipped[k] and k not in left_out
    blocks: list[list[str]] = [[]]
    for k, text in tree.texts:
        if text is None:
            blocks.append([])
        elif wanted[k]:
            blocks[-1].append(text)
    return "\n\n".join(filter(None, (" ".join("".join(pieces).split()) for pieces in blocks)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` and ``n_chars`` (code points, long).

    A null or empty page gives an empty text; no markup, however broken, is an error, and what a page that is cut leaves of an element or
    comment is no text. Repeated rows and null ids each get their row; an empty table gives an empty result; other columns don't matter.
    Pages are worked on one at a time, each with time and memory in proportion to its length.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    schema = f"_id {dict(pages.dtypes)[id_col]}, _url {dict(pages.dtypes)[url_col]}, text string"
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((main_text(h.as_py()) for h in batch.column(2)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["_id", "_url", "text"])

    out = rows.mapInArrow(run, fields)
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))

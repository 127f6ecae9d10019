"""Main text of web pages by consensus host paths.

A page is parsed once, into its text blocks with their containers' generalised path (tags with their sorted classes, digits removed) and its
vote: the container that holds the article. Containers are scored by the text below them outside links; the tightest one with most of it leads to the
nearest article or main element around it, or, without one, to the outermost container around it below the body. All that lies in there is the text, of any
size; the score only tells where the article is.

Spark adds up per host how often a path is voted for and on how many pages it occurs at all. A page's text is then what lies below
the path, of the host's most voted ones and the page's own vote, that is most often the article where it occurs: a short page, whose own best container might be a
notice, is read like the rest of its site, and on a host of several templates each page is read by its own. The blocks of that
path are picked by column functions, so pages are neither parsed nor shipped twice.

Menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and styles are
left out wherever they stand: by their tags and roles (an article's own header stays), and where a class or id of a container, list or
paragraph consists of their words only (``comment-list``, not ``hljs-comment`` or ``related-work``); outside article and main elements also containers whose
text is mostly links. Where the only article or main element, or without any such element over half of the text, lies in a container
marked like that, the container is a mere wrapper and stays; reader comments never do. Blocks come in page
order; inside a block, character references are decoded and white space becomes one blank.

Votes are combined before they are shuffled; winners are one row per host with at most ``winners`` votes
(a top-k). Pages meet winners and scores without a shuffle while their measured size is small, else in salted joins.

Defined cases: a null or empty page has the empty text; a null url belongs to the empty host; tags may
be unclosed, nested wrongly or cut, of any length and depth, in linear time; a "<" that opens no tag is text; equal
scores go to the path with more votes, then to the one that sorts first; repeated rows vote and are extracted as often as they come; an empty
table gives no rows; existing columns named like the added ones are replaced, further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.arrow import pieces, put
from docspark.llm.skew import salted_join
from docspark.storage import Workspace

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_CONTAINERS = frozenset("article body center div main section table tbody tr td".split())
_CLOSES_P = _BLOCK - frozenset("body head html option".split())
_OF_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_NOT_SELF_CLOSED = _BLOCK | frozenset("a b code em i small span strong sub sup u".split())
# Tags that are never the article, tags that wrap it at most, and roles like them.
_NEVER = frozenset("button datalist footer head menu nav noscript option select svg template".split())
_WRAPPERS = frozenset("aside dialog form header".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
# Words of a class or id that mark what is not the article, and words that may stand beside them.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer header menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "related recommended replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
_READERS = frozenset("comment comments commentlist disqus replies respond".split())
_BESIDE = frozenset(
    "area articles bar block bottom box button buttons container content first form global group icons inner item items last left link links list main "
    "mobile outer overlay page panel post posts primary reader readers right row secondary section site slot sticky stories thread title top unit user wrap wrapper".split()
)
_MENUS = frozenset("center div section".split())
_MARKED_TAGS = frozenset("article blockquote center details div dl figure li ol p section table ul".split())

_NAME = re.compile(r"/?[A-Za-z][^\s/<>]*")
_STEP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"[\d>|]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in _RAW}


@dataclass(slots=True)
class Block:
    """A run of text inside one block element, with its innermost container."""

    node: int
    text: str
    linked: int
    marked: int = -1


class Page:
    """A page's wanted blocks and the tree of its generalised container paths; node 0 is the page."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parents, self.labels = [-1], [""]
        self._nodes: dict[tuple[int, str], int] = {}

    def node(self, parent: int, label: str) -> int:
        """The node of a container; equal paths share one."""
        found = self._nodes.setdefault((parent, label), len(self.labels))
        if found == len(self.labels):
            self.parents.append(parent)
            self.labels.append(label)
        return found

    def path(self, node: int) -> str:
        out = []
        while node:
            out.append(self.labels[node])
            node = self.parents[node]
        return ">".join(reversed(out))

    def sums(self) -> tuple[list[int], list[int]]:
        """By node, the characters outside and inside links below it."""
        plain, linked = [0] * len(self.labels), [0] * len(self.labels)
        for b in self.blocks:
            plain[b.node] += len(b.text) - b.linked
            linked[b.node] += b.linked
        for i in range(len(self.labels) - 1, 0, -1):
            plain[self.parents[i]] += plain[i]
            linked[self.parents[i]] += linked[i]
        return plain, linked


def _label(tag: str, attributes: dict[str, str]) -> str:
    """The tag with its sorted classes, digits removed: the same on all pages of a template."""
    classes = sorted({_DIGITS.sub("", x) for x in attributes.get("class", "").lower().split()} - {""})
    return ".".join([tag, *classes])


def _marks(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether tag, role, class or id mark an element as no article, and as comments of readers; an article's header is its own."""
    words: set[str] = set()
    if tag in _MARKED_TAGS:
        for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
            parts = {x for x in _PARTS.split(token) if x}
            if parts & _MARKS and parts <= _MARKS | _BESIDE:
                words |= parts
    return bool(words) or (tag in _WRAPPERS and not (in_article and tag == "header")) or attributes.get("role", "").lower() in _ROLES, bool(words & _READERS)


@dataclass(slots=True)
class _Open:
    tag: str
    dropped: bool
    node: int
    marked: int


def blocks(html_text: str | None) -> Page:
    """The wanted text blocks of a page in order; blocks without text are left out."""
    page, text = Page(), html_text or ""
    stack = [_Open("", False, 0, -1)]
    where: dict[str, list[int]] = {}  # the open elements of a tag, by their places in the stack
    marked: list[list] = []  # parent, comments of readers, holds an article, characters outside links
    held: list[str] = []
    links = linked = at = 0
    bare = plain_end = False  # an article outside marked containers; tags end at the next ">" whatever the quotes

    def flush() -> None:
        nonlocal linked
        if held:
            said = " ".join(html.unescape("".join(held)).split())
            if said:
                page.blocks.append(Block(stack[-1].node, said, min(linked, len(said)), stack[-1].marked))
            held.clear()
        linked = 0

    def say(said: str) -> None:
        nonlocal linked
        if said and not stack[-1].dropped:
            held.append(said)
            if links:
                linked += len(said)

    def close(depth: int) -> None:
        """Close the elements from ``depth`` on."""
        nonlocal links
        if any(x.tag in _BLOCK for x in stack[depth:]):
            flush()
        for x in reversed(stack[depth:]):
            where[x.tag].pop()
            links -= x.tag == "a"
        del stack[depth:]

    def last(tags: tuple[str, ...], until: tuple[str, ...] = ()) -> int:
        """The place of the innermost open one of ``tags``, unless one of ``until`` is further in."""
        found = max((where[t][-1] for t in tags if where.get(t)), default=0)
        return found if found > max((where[t][-1] for t in until if where.get(t)), default=-1) else 0

    def tag_end(start: int) -> int:
        """Behind the tag's ``>``, or -1; once a quote has no end, quotes no longer count on this page."""
        nonlocal plain_end
        place = start
        while not plain_end:
            m = _STEP.search(text, place)
            if m is None:
                plain_end = True
            elif m[1] is None:
                return m.end()
            else:
                place = text.find(m[1], m.end()) + 1
                plain_end = not place
        return text.find(">", start) + 1 or -1

    while (cut := text.find("<", at)) >= 0:
        if text.startswith("<!--", cut):
            say(text[at:cut])
            end = text.find("-->", cut + 4)
            at = end + 3 if end >= 0 else len(text)
            continue
        m = _NAME.match(text, cut + 1)
        declared = text[cut + 1 : cut + 2] in ("!", "?")
        end = text.find(">", cut) + 1 or -1 if declared else tag_end(m.end()) if m else -1
        if end < 0:
            say(text[at : cut + 1])
            at = cut + 1
            if m or declared:  # no ">" is left, so no tag either
                break
            continue
        say(text[at:cut])
        at = end
        if declared:
            continue
        tag, rest = m[0].lower(), text[m.end() : end - 1]
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "br":
                say(" ")
            elif i := last((tag,), () if tag in _BLOCK else tuple(_CONTAINERS)):
                close(i)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if where.get("head") and tag not in _IN_HEAD:
            close(where["head"][-1])
        if tag in _CLOSES_P and (i := last(("p",), ("td", "th", "article", "section", "div", "body"))):
            close(i)
        if tag in _OF_KIND and (i := last(_ALIKE.get(tag, (tag,)), _OF_KIND[tag])):
            close(i)
        if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
            close(len(stack) - 1)
        if tag in _BLOCK:
            flush()
        closed = rest.rstrip().endswith("/")
        if tag in _RAW:
            found_end = _RAW_END[tag].search(text, at)
            at = found_end.end() if found_end else len(text)
            continue
        if tag in _VOID or (closed and tag not in _NOT_SELF_CLOSED):
            continue
        found: dict[str, str] = {}
        for x in _ATTRIBUTE.finditer(rest):
            found.setdefault(x[1].lower(), html.unescape(x[2] or x[3] or x[4] or ""))
        above = stack[-1]
        dropped = above.dropped or tag in _NEVER or "hidden" in found
        if dropped and not above.dropped and tag not in _BLOCK:
            say(" ")
        node, mark = above.node, above.marked
        if not dropped and tag not in ("html", "body", "main"):
            is_marked, of_readers = _marks(tag, found, bool(where.get("article")))
            if is_marked:
                marked.append([mark, of_readers, False, 0])
                mark = len(marked) - 1
        if not dropped and (tag in ("article", "main") or found.get("role", "").lower() == "main"):
            if mark < 0:
                bare = True
            elif mark == above.marked:  # an article that is marked itself is no reason to keep its wrapper
                marked[mark][2] = True
        if tag in _CONTAINERS:
            node = page.node(node, _label(tag, found))
        where.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, dropped, node, mark))
        links += tag == "a"
    say(text[at:])
    flush()
    _leave_out(page, marked, bare)
    _leave_out_menus(page)
    return page


def _leave_out(page: Page, marked: list[list], bare: bool) -> None:
    """Remove the blocks in marked containers but for mere wrappers of the article."""
    if not marked:
        return
    total = 0
    for b in page.blocks:
        n = len(b.text) - b.linked
        total += n
        if b.marked >= 0:
            marked[b.marked][3] += n
    for parent, _, holds, n in reversed(marked):  # a parent stands before its children
        if parent >= 0:
            marked[parent][2] |= holds
            marked[parent][3] += n
    any_holds = any(x[2] and not x[1] for x in marked)
    kept: list[bool] = []
    for parent, of_readers, holds, n in marked:
        wraps = not bare and not of_readers and (holds if any_holds else 2 * n > total)
        kept.append(wraps and (parent < 0 or kept[parent]))
    page.blocks = [b for b in page.blocks if b.marked < 0 or kept[b.marked]]


def _tag(page: Page, node: int) -> str:
    return page.labels[node].split(".")[0]


def _leave_out_menus(page: Page) -> None:
    """Remove the blocks in containers that are mostly links, but for those in articles and for pages of nothing else."""
    plain, linked = page.sums()
    if not plain[0]:
        return
    menu, inside = [False] * len(plain), [False] * len(plain)
    for i in range(1, len(plain)):
        above, tag = page.parents[i], _tag(page, i)
        inside[i] = inside[above] or tag in ("article", "main")
        menu[i] = not inside[i] and (menu[above] or (tag in _MENUS and linked[i] > plain[i]))
    page.blocks = [b for b in page.blocks if not menu[b.node]]


def vote(page: Page, most: float = 0.75) -> int:
    """The container of the article: around the tightest one with over ``most`` of the text outside links."""
    plain, _ = page.sums()
    below: dict[int, list[int]] = {}
    for i in range(1, len(plain)):
        below.setdefault(page.parents[i], []).append(i)
    best = 0
    while plain[0] and below.get(best):
        inner = min(below[best], key=lambda i: (-plain[i], page.labels[i]))
        if plain[inner] <= most * plain[0]:
            break
        best = inner
    up = best
    while up:
        if _tag(page, up) in ("article", "main"):
            return up
        up = page.parents[up]
    # sections are parts of one text, and so is what lies beside it in containers below the body
    while best and _tag(page, best) not in ("html", "body") and (_tag(page, best) == "section" or (page.parents[best] and _tag(page, page.parents[best]) not in ("html", "body"))):
        best = page.parents[best]
    return best


def parse(html_text: str | None) -> tuple[str, list[tuple[str, str]]]:
    """The path that a page votes for (empty: all of it), and its blocks as path and text."""
    page = blocks(html_text)
    paths: dict[int, str] = {}
    found = []
    for b in page.blocks:
        if b.node not in paths:
            paths[b.node] = page.path(b.node)
        found.append((paths[b.node], b.text))
    return page.path(vote(page)), found


_PARSED = "page_id bigint, url string, host string, ballot string, blocks array<struct<path:string,text:string>>"


def parsed(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, ballot, blocks)`` of every row of ``pages(page_id, url, html)``."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^:/?#]*://([^/?#]*)", 1), F.lit("")))
    kind = pages.schema["page_id"].dataType.simpleString()
    listed = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            ballots, offsets, paths, texts = [], [0], [], []
            for page in batch.column("html").to_pylist():
                ballot, found = parse(page)
                ballots.append(ballot)
                paths += [path for path, _ in found]
                texts += [text for _, text in found]
                offsets.append(len(paths))
            held = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], fields=list(listed.value_type))
            made = {"ballot": pa.array(ballots, pa.string()), "blocks": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held)}
            yield put(batch.select(["page_id", "url", "host"]), made)

    return pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(run, _PARSED.replace("page_id bigint", f"page_id {kind}"))


def _prefixes(path: Column) -> Column:
    """A path and those of all containers around it."""
    parts = F.split(path, ">")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ">"))


def scores(pages: DataFrame) -> DataFrame:
    """``(host, path, votes, score)`` of ``pages(host, ballot, blocks)``: how often a path is the article where it occurs."""
    votes = pages.where("ballot <> ''").groupBy("host", F.col("ballot").alias("path")).agg(F.count("*").alias("votes"))
    own = F.array_distinct(F.transform("blocks", lambda b: b["path"]))
    there = pages.select("host", F.explode(F.array_distinct(F.flatten(F.transform(own, _prefixes)))).alias("path")).where("path <> ''")
    there = there.groupBy("host", "path").agg(F.count("*").alias("pages"))
    return votes.join(there, ["host", "path"]).select("host", "path", "votes", (F.col("votes") / F.col("pages")).alias("score"))


def winning_paths(scored: DataFrame, winners: int = 4, least_share: float = 0.1) -> DataFrame:
    """``(host, winners)``: the paths with at least ``least_share`` of the host's votes, most first."""
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= winners)
    totals = scored.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = ranked.join(totals, "host").where(F.col("votes") >= least_share * F.col("total"))
    return kept.groupBy("host").agg(F.collect_list(F.struct(F.col("score"), F.col("votes"), F.col("path"))).alias("winners"))


def _met(pages: DataFrame, found: DataFrame, on: list[str], size: Column, broadcast_chars: int, salts: int) -> DataFrame:
    """``pages`` with what ``found``, one row a key, says.

    Up to ``broadcast_chars`` characters in all go to every task. Beyond that the tables are joined, and a key's pages are dealt
    over ``salts`` tasks, so that one host's pages never meet in one.
    """
    total = found.agg(F.sum(size + 64)).first()[0] or 0
    if total <= broadcast_chars:
        return pages.join(F.broadcast(found), on, "left")
    return salted_join(pages, found, on, ["page_id", "url"], "left", salts)


def main_text(pages: DataFrame, broadcast_chars: int = 8 << 20, salts: int = 64) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``."""
    work = Workspace(pages.sparkSession, "html")
    read = work.table(parsed(pages), "parsed")
    scored = work.table(scores(read), "scores")
    winners = work.table(winning_paths(scored), "winners")
    own = scored.select("host", F.col("path").alias("ballot"), F.struct("score", "votes", "path").alias("own"))
    joined = _met(read, winners, ["host"], F.length(F.array_join(F.transform("winners", lambda w: w["path"]), "|")), broadcast_chars, salts)
    joined = _met(joined, own, ["host", "ballot"], F.length("ballot"), broadcast_chars, salts)
    below = lambda path, at: (at == "") | (path == at) | F.startswith(path, F.concat(at, F.lit(">")))
    kind = "array<struct<score:double,votes:bigint,path:string>>"
    all_ = F.concat(F.coalesce("winners", F.array().cast(kind)), F.when(F.col("own").isNotNull(), F.array("own")).otherwise(F.array().cast(kind)))
    there = F.filter(all_, lambda w: F.exists("blocks", lambda b: below(b["path"], w["path"])))
    better = F.array_sort(there, lambda x, y: F.when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1)).when(x["votes"] != y["votes"], F.when(x["votes"] > y["votes"], -1).otherwise(1)).when(x["path"] < y["path"], -1).when(x["path"] > y["path"], 1).otherwise(0))
    chosen = joined.withColumn("at", F.coalesce(F.get(better, F.lit(0))["path"], F.col("ballot")))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: below(b["path"], F.col("at"))), lambda b: b["text"]), "\n")
    return chosen.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))

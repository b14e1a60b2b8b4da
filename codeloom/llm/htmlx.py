"""Main-text extraction by consensus paths of a host (operator 8).

A page is read once as a stream of tags, in time and memory linear in its length.  Every container (a structural
element outside navigation, forms, adverts and the like) has a generalised path:
the tags from the root with their classes, digits replaced.  Each page scores
its containers by the text they hold, less what is link text, climbs from the
best to what encloses it as long as that adds text and not just links, and casts
one vote for the path it comes to.  Votes are summed per host in Spark; every page
is then read again and gives the text of its containers with the winning path,
or, if it has none, of its own best one.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "canvas"}
SKIP = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "label", "fieldset"}
BOXES = {"html", "body", "div", "article", "section", "main", "table", "tbody", "tr", "td", "th", "ul", "ol", "dl", "center", "blockquote", "figure", "details", "span"}
PARTS = {"ul", "ol", "dl", "blockquote", "figure"}  # of a text, with all that is in them
GRID = {"table", "tbody", "tr", "th"}  # a cell may hold a page's text
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|promo(?:tion)?s?|sponsor(?:ed)?s?|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|side-bar|footers?|headers?|masthead|"
    r"cookies?|consent|notices?|gdpr|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|login|comments?|comment-?list|disqus|replies|respond|share|sharing|social|related|"
    r"recommend(?:ed|ations?)?|pagination|pager|widgets?|toolbar|search|copyright|legal|disclaimer)(?=$|[\s_\d-])",
    re.I,
)
# A plain tag, up to the next "<" at most; possessive, so that a failure costs one pass.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>\"']*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
ODD = re.compile(r"(/?)([A-Za-z][^\s/>]*)(.*)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _noise(tag: str, attrs: str) -> tuple[bool, str]:
    """Whether an element is boilerplate, and its generalised name."""
    if tag in SKIP:
        return True, tag
    if not attrs:
        return False, tag
    found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "menu", "alert"):
        return True, tag
    names = found.get("class", "") + " " + found.get("id", "")
    if tag not in ("html", "body", "main", "article") and NOISE.search(names):
        return True, tag
    classes = sorted(set(re.sub(r"\d+", "0", found.get("class", "")).lower().replace("/", "|").split()))
    return False, ".".join([tag, *classes])


class Tags:
    """The tags and comments of a page, one after the other.

    A tag ends at the first ">" outside quotes.  Plain tags are matched as they come; at the first "<" that is none,
    the ends of all possible tags are worked out once, from the back: at a quote the end is that behind
    its partner.  What has no end is text.
    """

    def __init__(self, s: str):
        self.s = s
        self.at: list[int] | None = None  # places of > " '
        self.ends: list[int] = []  # the end of a tag whose next of these is that one; -1: none
        self.last = s.rfind(">")

    def _end(self, start: int) -> int:
        if self.at is None:
            self.at = [m.start() for m in re.finditer("[>\"']", self.s)]
            n = len(self.at)
            self.ends = [-1] * (n + 1)
            partner = {"'": n, '"': n}
            for k in range(n - 1, -1, -1):
                c = self.s[self.at[k]]
                if c == ">":
                    self.ends[k] = self.at[k]
                else:
                    self.ends[k] = self.ends[partner[c] + 1] if partner[c] < n else -1
                    partner[c] = k
        return self.ends[bisect_left(self.at, start)]

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" or "", tag, attributes) of the first tag from ``at`` on; a comment or the like has no tag."""
        s = self.s
        while True:
            at = s.find("<", at)
            if at < 0:
                return None
            m = TAG.match(s, at)
            if m:
                return at, m.end(), m[1], m[2].lower(), m[3]
            c = s[at + 1 : at + 2]
            if s.startswith("<!--", at):
                end = s.find("-->", at + 4)
                return at, len(s) if end < 0 else end + 3, "", "", ""
            if at < self.last:
                if c in ("!", "?"):
                    return at, s.find(">", at) + 1, "", "", ""
                d = s[at + 2 : at + 3] if c == "/" else c
                if d.isascii() and d.isalpha():
                    end = self._end(at)
                    if end >= 0:
                        odd = ODD.match(s[at + 1 : end])
                        return at, end + 1, odd[1], odd[2].lower(), odd[3]
            at += 1


class Page:
    """Containers of one page: path, text in page order, and characters of link text.

    A path is kept as a number, given to each pair of a path and a name below it.
    """

    def __init__(self, source: str | None):
        self.step: dict[tuple[int, str], int] = {}  # (path, name) -> path
        self.above: list[tuple[int, str]] = [(-1, "")]  # of each path
        self.paths: list[int] = [0]  # container 0 is the page itself
        self.parent: list[int] = [-1]
        self.pieces: list[tuple[int, str]] = []  # container, text; "" container text with a break is " "
        self.linked: list[int] = [0]
        self.unclosed: set[str] = set()  # raw elements without an end tag in the rest of the page
        self._read(source or "")

    def _read(self, s: str) -> None:
        tags = Tags(s)
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, inside boilerplate
        open_: dict[str, list[int]] = {}  # places of each tag in the stack
        skips: list[int] = [0]  # places of tags of SKIP
        at, link, end = 0, 0, len(s)
        box, noise = 0, False
        put = self.pieces.append
        while at < end:
            m = tags.next(at)
            start = m[0] if m else end
            if start > at and not noise:
                text = entities.unescape(s[at:start])
                put((box, text))
                if link:
                    self.linked[box] += len(text)
            if not m:
                break
            _, at, slash, tag, attrs = m
            if not tag:
                continue
            if slash:
                if tag == "a":
                    link = 0
                if tag in BOXES or tag in SKIP:
                    # an inner end tag does not close what encloses its boilerplate or cell
                    k = open_[tag][-1] if open_.get(tag) else 0
                    if k and (k >= skips[-1] or tag in ("html", "body")):
                        for name, _, _ in stack[: k - 1 : -1]:
                            open_[name].pop()
                            if name in SKIP:
                                skips.pop()
                        del stack[k:]
                    box, noise = stack[-1][1], stack[-1][2]
            elif tag in RAW:
                if not attrs.endswith("/"):
                    close = self._close(s, tag, at)
                    if close >= 0:
                        gt = s.find(">", close)
                        at = end if gt < 0 else gt + 1
                    else:
                        at = end if tag in ("script", "style", "textarea", "title") else at
            elif tag == "a":
                link = 1
            elif (tag in BOXES or tag in SKIP) and not attrs.endswith("/"):
                bad, name = _noise(tag, attrs)
                if tag != "span" or bad:
                    if not (noise or bad):
                        here = self.paths[box], name
                        if here not in self.step:
                            self.step[here] = len(self.above)
                            self.above.append(here)
                        self.paths.append(self.step[here])
                        self.parent.append(box)
                        self.linked.append(0)
                        box = len(self.paths) - 1
                    noise = noise or bad
                open_.setdefault(tag, []).append(len(stack))
                if tag in SKIP:
                    skips.append(len(stack))
                stack.append((tag, box, noise))
            if tag not in INLINE and not noise:
                put((box, " "))

    def _close(self, s: str, tag: str, at: int) -> int:
        """Where the end tag of a raw element begins, from ``at`` on; -1 if there is none, which is found out once a tag."""
        if tag in self.unclosed:
            return -1
        m = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(s, at)
        if not m:
            self.unclosed.add(tag)
        return m.start() if m else -1

    def path(self, number: int) -> str:
        names = []
        while number > 0:
            number, name = self.above[number]
            names.append(name)
        return "".join(f"/{n}" for n in reversed(names))

    def number(self, path: str) -> int:
        """The number of a path, -1 if no container has it."""
        at = 0
        for name in path.split("/")[1:]:
            at = self.step.get((at, name), -1)
        return at

    def best(self) -> tuple[str, float]:
        """Path of the container of the main text, and the score of the box it grew from.

        A container has its own text, half of that of its inner containers and
        so on inwards; ties go to the first in the page.  Lists, quotes and figures
        with what is in them, and tables apart from their cells, are only text of
        what they stand in.  The best box may hold a part of the text alone, so
        ``_climb`` follows.
        """
        text = [0.0] * len(self.paths)
        for box, piece in self.pieces:
            text[box] += len(piece.strip())
        score = [o - 2 * k for o, k in zip(text, self.linked)]
        for i in range(len(score) - 1, 0, -1):
            score[self.parent[i]] += max(0.0, score[i]) / 2
        tags = [self.above[p][1].split(".", 1)[0] for p in self.paths]
        part = [False] * len(tags)
        for i in range(1, len(tags)):
            part[i] = part[self.parent[i]] or tags[i] in PARTS
        top = max((i for i in range(len(score)) if not part[i] and tags[i] not in GRID), key=lambda i: (score[i], -i))
        return self.path(self.paths[self._climb(top, tags, text)]), score[top]

    def _climb(self, box: int, tags: list[str], text: list[float]) -> int:
        """The highest container around ``box`` whose further text is mostly no link text, or ``box``.

        The climb ends at an article or main element; body and what is around it
        are taken only if no container below adds text.
        """
        whole, links = text[:], [float(k) for k in self.linked]
        for i in range(len(whole) - 1, 0, -1):
            whole[self.parent[i]] += whole[i]
            links[self.parent[i]] += links[i]
        found, at = box, box
        while tags[at] not in ("article", "main") and self.parent[at] >= 0:
            at = self.parent[at]
            if tags[at] in ("", "html", "body") and found != box:
                break
            if whole[at] > whole[found] and 2 * (links[at] - links[box]) < whole[at] - whole[box]:
                found = at
        return found

    def text(self, path: str) -> str:
        """Text of all containers with this path and what is in them, blocks joined by one space."""
        inside, number = [False] * len(self.paths), self.number(path)
        for i, p in enumerate(self.paths):
            inside[i] = p == number or (self.parent[i] >= 0 and inside[self.parent[i]])
        return " ".join("".join([t for box, t in self.pieces if inside[box]]).split())

    def has(self, path: str) -> bool:
        return self.number(path) >= 0


def host_of(url) -> "F.Column":
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, salt: int = 64) -> DataFrame:
    """(page_id, url, text, path) of every page (page_id, url, html).

    Null and empty pages give an empty text, as do pages without text.  Pages
    without a url share the empty host.  Equal votes go to the path with more
    text, then to the first in order.  Each row gives one row, repeated ones too; other columns
    are ignored, whatever their names; an empty table gives an empty result.  Tags that never end are text,
    and very long or deeply nested pages are read whole in linear time.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(h).best() for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["host", "path", "score"])

    votes = rows.filter("html is not null and html <> ''").select("host", "html").mapInArrow(vote, "host string, path string, score double")
    tally = votes.filter("score > 0").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").cast("decimal(38,2)").alias("score"))
    best = F.min_by(F.col("path"), F.struct(-F.col("n"), -F.col("score"), "path"))
    wins = tally.groupBy("host").agg(best.alias("path"))
    # A host's pages are dealt to ``salt`` keys, each of which has a copy of the host's path.
    wins = wins.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(salt)).cast("int"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = [], []
            for source, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist()):
                page = Page(source)
                path = path if path is not None and page.has(path) else page.best()[0]
                texts.append(page.text(path))
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(paths, pa.string())], names=["page_id", "url", "text", "path"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, path string"
    return rows.join(wins, ["host", "part"], "left").select("page_id", "url", "html", "path").mapInArrow(read, schema)

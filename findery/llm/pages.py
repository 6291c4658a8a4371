"""Main-text extraction by consensus host paths.

1. Every page's containers are scored: a block's text without its links counts in full for the nearest
   container, half for the next one out, and so on. Every container gives votes: a
   *generalised path* (tags with class names, digits as ``#``) and its share of the page's score.
2. Spark adds the votes by (host, path); the path with the largest sum wins its host. Both steps combine
   before the shuffle, so a host with a third of all pages is a few rows a task.
3. Every page is read again. A container on its host's winning path is lifted to the outermost one around it that
   is an article or holds text of its own that is not links (without any: to the outermost main), and the blocks
   below are the page's text. A page without that path uses its own best container.

Paths are kept as digests of 16 letters, each made of its parent's, so deep pages take time in proportion. The winning ones (one a host)
are a written table: up to ``BROADCAST_BYTES`` of hosts and digests they are broadcast and no page is shuffled; beyond, pages join them on (host, salt), salted so that a hot host spreads out.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
out by tag, role, and words of class and id. Headings in an article's own header stay.

Defined results: a null, empty or textless page has the text ''; a null url has the host ''; rows are
independent, so repeated rows and ids do not matter; broken markup (tags, quotes or comments that are
never closed) is read as far as it goes; very long and very deep pages are read whole; other columns are not read, so their names
cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BROADCAST_BYTES = 4 << 20
SALTS = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|</{t}\Z", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center div dd fieldset html main section table tbody td tr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROP_TAGS = frozenset(
    "aside audio button canvas datalist dialog embed footer form head header iframe input label map menu nav noscript"
    " object optgroup option select svg template video math".split()
)
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent"
    " cookie cookies dialog disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice"
    " notification overlay pager pagination popup promo promoted promotion recommended related respond search share"
    " sharing sidebar signup skip social sponsor sponsored subscribe subscription toast toolbar widget".split()
)
#: Elements that their words never drop.
FIRM = frozenset(("html", "body", "main"))
#: A start tag closes an open element of these, up to the next container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("html body article main section div td th table ul ol dl blockquote aside nav header footer form".split())


def attributes(text: str) -> dict[str, str]:
    if "=" not in text and "hidden" not in text:
        return {}
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def is_boilerplate(tag: str, attrs: dict[str, str]) -> bool:
    if tag in DROP_TAGS:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in DROP_ROLES:
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.I):
        return True
    if tag in FIRM:
        return False
    words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(attrs.get(k, ""))}
    if tag == "article":
        words &= {"comment", "comments", "related", "promo", "ad", "advert", "sponsored"}
    return bool(words & DROP_WORDS)


class Page:
    """The containers and the text blocks of one page."""

    def __init__(self, source: str):
        self.parent, self.path, self.tag = [-1], [""], [""]  # container 0 is the page
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self._read(source)

    def _node(self, parent: int, tag: str, attrs: dict[str, str]) -> int:
        names = ".".join(sorted(re.sub(r"\d+", "#", c) for c in attrs.get("class", "").split()))
        self.parent.append(parent)
        self.path.append(blake2b(f"{self.path[parent]}>{tag}.{names}".encode("utf-8", "replace"), digest_size=8).hexdigest())
        self.tag.append(tag)
        return len(self.parent) - 1

    def _read(self, s: str) -> None:
        # an open element: tag, container, dropped, in a header whose headings stay, in a link
        stack: list[tuple[str, int, bool, bool, bool]] = []
        parts: list[str] = []
        links, in_link, pos, end = 0, False, 0, len(s)
        node, drop = 0, False

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join(html_lib.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((node, text, links))
                parts.clear()
            links = 0

        def state() -> None:
            nonlocal node, drop, in_link
            _, node, drop, _, in_link = stack[-1] if stack else ("", 0, False, False, False)

        while pos < end:
            at, m = s.find("<", pos), None
            while at >= 0 and (m := _TOKEN.match(s, at)) is None:
                at = s.find("<", at + 1)
            at = end if m is None else at
            if at > pos and not drop:
                parts.append(s[pos:at])
                if in_link:
                    links += at - pos
            if m is None:
                break
            pos = m.end()
            tag = m[2] or m[5]
            if tag is None:
                if m[0].startswith("<![CDATA[") and not drop:
                    parts.append(html_lib.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag, closing, rest = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            if closing:
                if tag in BLOCK:
                    flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if tag in BLOCK or all(e[0] not in BLOCK for e in stack[i:]):
                            del stack[i:]
                        else:
                            del stack[i]  # an inline end tag does not close blocks inside it
                        state()
                        break
                    if stack[i][0] in _BARRIER and tag not in BLOCK:
                        break
                continue
            if tag in _RAW:
                close = _RAW[tag].search(s, pos)
                pos = close.end() if close else end
                continue
            if tag in BLOCK:
                flush()
                shut = CLOSES.get(tag, frozenset())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in shut or (stack[i][0] == "p" and tag != "br"):
                        del stack[i:]
                        state()
                        break
                    if stack[i][0] in _BARRIER:
                        break
            if tag in VOID or rest.endswith("/") and tag in ("svg", "path"):
                continue
            attrs = attributes(rest)
            inside = stack[-1] if stack else ("", 0, False, False, False)
            own = is_boilerplate(tag, attrs)
            article_header = inside[3] or (
                tag == "header" and not inside[2] and any(e[0] in ("article", "main") for e in stack)
            )
            dropped = (inside[2] or own) and not (tag in HEADING and inside[3])
            at_node = self._node(inside[1], tag, attrs) if tag in CONTAINER and not dropped else inside[1]
            stack.append((tag, at_node, dropped, article_header and not (own and tag != "header"), inside[4] or tag == "a"))
            state()
        flush()

    def scores(self) -> dict[int, float]:
        out: dict[int, float] = {}
        for node, text, links in self.blocks:
            value = max(len(text) - 2 * links, 0)
            weight = 1.0
            while node >= 0 and weight > 0.05:
                bonus = 1.25 if self.tag[node] in ("article", "main") else 1.0
                out[node] = out.get(node, 0.0) + value * weight * bonus
                node, weight = self.parent[node], weight / 2
        return out

    def votes(self) -> list[tuple[str, int]]:
        """The paths, best first, with their thousandths of all the page's scores."""
        by_path: dict[str, float] = {}
        for node, x in self.scores().items():
            p = self.path[node]
            by_path[p] = by_path.get(p, 0.0) + x
        total = sum(by_path.values())
        best = sorted(by_path.items(), key=lambda kv: (-kv[1], kv[0]))
        return [(p, int(1000 * x / total)) for p, x in best if x > 0]

    def lifted(self, node: int, own_text: set[int]) -> int:
        """The outermost article or container with text of its own around ``node``; else the outermost main; else ``node``."""
        around = [node]
        while self.parent[around[-1]] >= 0:
            around.append(self.parent[around[-1]])
        best = [i for i in around if self.tag[i] == "article" or i in own_text and i != node] or [i for i in around if self.tag[i] == "main"]
        return best[-1] if best else node

    def text(self, path: str | None) -> str:
        """All blocks below the lifted containers of a path, in page order."""
        roots = {i for i in range(1, len(self.parent)) if self.path[i] == path} if path else set()
        if not roots:
            own = self.votes()
            roots = {i for i in range(len(self.parent)) if own and self.path[i] == own[0][0]}
        own_text = {node for node, text, links in self.blocks if len(text) > 2 * links}
        roots = {self.lifted(i, own_text) for i in roots}
        inside = [False] * len(self.parent)
        for i in range(len(self.parent)):  # a container comes after its parent
            inside[i] = i in roots or (self.parent[i] >= 0 and inside[self.parent[i]])
        return " ".join(t for node, t, _ in self.blocks if inside[node])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, path."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    src = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))

    def vote(batches):
        for batch in batches:
            got: dict[tuple[str, str], int] = {}
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for p, x in Page(page.as_py()).votes():
                    got[h, p] = got.get((h, p), 0) + x
            rows = [(h, p, x) for (h, p), x in got.items()]
            yield pa.RecordBatch.from_pydict(
                {"host": [r[0] for r in rows], "path": [r[1] for r in rows], "votes": pa.array([r[2] for r in rows], pa.int64())},
                pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())]),
            )

    votes = src.select("host", "html").mapInArrow(vote, "host string, path string, votes long")
    sums = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    winners = materialise(sums.groupBy(F.col("host").alias("at")).agg(F.max_by("path", F.struct("votes", "path")).alias("path")), "paths")
    size = winners.agg(F.sum(F.octet_length("at") + F.octet_length("path"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = src.join(F.broadcast(winners), F.col("host") == F.col("at"), "left")
    else:
        many = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = src.withColumn("dealt", dealt).join(many, (F.col("host") == F.col("at")) & (F.col("dealt") == F.col("salt")), "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches):
        for batch in batches:
            texts = [Page(h.as_py()).text(p.as_py()) for h, p in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(read, f"page_id {kind}, url string, text string")


def op5(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""HTML extraction: templates from equivalence classes of tokens, and the slots that are left."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Each alternative goes on to its end or the page's and never back, so a page is read in one pass, however broken. As in
#: browsers, quotes count behind an equals sign alone.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?[A-Za-z](?>[^>=]++|=\s*+(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|))*+(?:>|\Z)", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>]++)""")
QUOTED = re.compile(r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)")
#: Elements that nest at most; deeper ones stand beside each other, as in browsers.
DEEPEST = 512
BLANK = re.compile(r"\s+")

# Element names of the HTML standard by what they do, and names that sites give to what is not the article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"article", "aside", "body", "div", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "td", "th", "ul"}
OUTSIDE = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "svg", "canvas", "audio", "video", "object", "dialog", "label"}
OUTSIDE_WORD = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|overlay|comments?|commentlist|disqus|respond|reply|replies|sidebar|widgets?|menu|nav\w*|breadcrumbs?|footer|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|toolbar|pagination|pager|skip")
#: Words that may follow one of those in a compound name: a part of the page, not a subject.
PART_WORD = re.compile(r"area|articles?|bar|blocks?|body|bottom|box|btn|buttons?|cards?|center|container|content|count|form|group|header|icons?|inner|items?|left|links?|list|main|module|outer|panel|posts?|region|right|row|section|slot|stories|strip|text|thread|title|toggle|top|unit|wrap|wrapper|\d+|\d+x\d+")
#: Words with which a name tells what an element has or lacks beside it.
BESIDE_WORD = {"has", "no", "with", "without"}
OUTSIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog"}
#: Pages of a host from which a text on all of them is taken for a part of its template.
ALL_PAGES = 8


def outside_name(classes: str, element_id: str) -> bool:
    """Whether an element's classes or id name something other than the article.

    A name does where one of its words is an outside word and what follows it says only which part of the page that is: share-buttons
    does, share-price and notice-period don't. A class `discussion` holds reader comments; as an id it is a section of a paper."""
    names = classes.lower().split()
    for name in [*names, *element_id.lower().split()]:
        words = [w for w in re.split(r"[_-]+", name) if w]
        if BESIDE_WORD & set(words):
            continue
        for k in range(len(words) - 1, -1, -1):
            if OUTSIDE_WORD.fullmatch(words[k]):
                return True
            if not PART_WORD.fullmatch(words[k]):
                break
    return "discussion" in names


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return found[1].lower() if found else ""


class Page:
    """A page's tokens: structural ones (an element's path), and blocks of text with the elements they stand in."""

    def __init__(self, source: str):
        self.paths: list[int] = []  # structural tokens in page order
        self.blocks: list[tuple[str, int, bool, bool, tuple[int, ...]]] = []  # text, token, outside, inside an article, elements
        self.path_of: dict[int, int] = {}
        stack: list[tuple[str, int, int, bool, bool]] = []  # name, element, path, outside, inside an article
        parts: list[str] = []
        self.has_main = False
        n = 0

        def flush() -> None:
            if parts:
                text = BLANK.sub(" ", html.unescape("".join(parts))).strip()
                parts.clear()
                if text:
                    name, element, path, outside, inside = stack[-1] if stack else ("", 0, 0, False, False)
                    self.blocks.append((text, xxhash.xxh64_intdigest(text, seed=path & 0xFFFFFFFF), outside, inside, tuple(s[1] for s in stack)))

        def pop(k: int) -> None:
            if any(s[0] not in INLINE for s in stack[k:]):
                flush()
            del stack[k:]

        at = 0
        while True:
            m = TOKEN.search(source, at)
            if m is None:
                parts.append(source[at:])
                break
            if m.start() > at:
                parts.append(source[at : m.start()])
            tag, at = m[0], m.end()
            if tag[1] in "!?":
                if tag.startswith("<![CDATA["):
                    parts.append(html.escape(tag[9:-3]))
                continue
            name = NAME.match(tag)[1].lower()
            if tag[1] == "/":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
                    if name in INLINE and stack[k][0] in SCOPES:
                        break
                if name == "p" and not any(s[0] == "p" for s in stack):
                    flush()
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                if name not in ("textarea", "title", "iframe"):
                    continue
                flush()
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name not in INLINE:
                flush()
                for closing, within in ((CLOSES_P, {"p"}), ({name} if name in CLOSES_SAME else (), CLOSES_SAME.get(name, ()))):
                    if name in closing:
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] in within:
                                pop(k)
                                break
                            if stack[k][0] in SCOPES and stack[k][0] not in within:
                                break
            _, _, path, outside, inside = stack[-1] if stack else ("", 0, 0, False, False)
            label, attributes = name, {}
            if name not in INLINE or "=" in tag:
                attributes = {a.lower(): v.strip("\"'") for a, v in ATTRIBUTE.findall(tag)}
                label = re.sub(r"\d+", "0", f"{name}.{attributes.get('class', '')}#{attributes.get('id', '')}")
            n += 1
            path = xxhash.xxh64_intdigest(label, seed=path & 0xFFFFFFFF)
            is_main = name in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "") == "articleBody"
            outside = outside or name in OUTSIDE or (name == "header" and not inside) or attributes.get("role", "").lower() in OUTSIDE_ROLE or "hidden" in re.split(r"[\s>]", QUOTED.sub("", tag)) or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))
            if not outside and name not in ("html", "body") and not is_main:
                outside = outside_name(attributes.get("class", ""), attributes.get("id", ""))
            if is_main and not outside:
                inside = self.has_main = True
            if len(stack) >= DEEPEST:
                pop(DEEPEST - 1)
            stack.append((name, n, path, outside, inside))
            self.path_of[n] = path
            if name not in INLINE:
                self.paths.append(path)
        flush()

    def tokens(self) -> dict[tuple[int, int], int]:
        """Each token's number of occurrences: (0, path) for structure, (1, text at a path) for blocks."""
        out: dict[tuple[int, int], int] = defaultdict(int)
        for p in self.paths:
            out[0, p] += 1
        for b in self.blocks:
            out[1, b[1]] += 1
        return out

    def text(self, constant: set[int], skeleton: set[int]) -> str:
        """What fills the template's slots in the article.

        constant: texts of the host's template; they are no slots, unless they were over half of the article (then the
        pages are copies of each other). skeleton: structure of the template; without an article element, the article
        is the element of the skeleton (any element, if none is known) whose own blocks hold most text."""
        own = [b for b in self.blocks if not b[2]]
        if self.has_main:
            own = [b for b in own if b[3]]
        else:
            mass: dict[int, float] = defaultdict(float)
            for b in own:
                for k, e in enumerate(b[4][-2:-4:-1] or b[4][-1:]):
                    mass[e] += len(b[0]) / (k + 1)
            known = {e: v for e, v in mass.items() if self.path_of[e] in skeleton} or mass
            if known:
                best = max(known, key=lambda e: (known[e], -e))
                own = [b for b in own if best in b[4]]
        slots = [b for b in own if b[1] not in constant]
        if 2 * sum(len(b[0]) for b in slots) < sum(len(b[0]) for b in own):
            slots = own
        return " ".join(b[0] for b in slots)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html) to sums over pages for each host's token: pages, two sums of a hash of page and count, and the least and greatest hash of pages."""
    for batch in batches:
        sums: dict[tuple[str, int, int], list[int]] = {}
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            source, host = source or "", host_of(url)
            whole = xxhash.xxh64_intdigest(source)
            sums.setdefault((host, 2, 0), [0, 0, 0, 0, 0])[0] += 1
            for (kind, token), count in Page(source).tokens().items():
                x = xxhash.xxh64_intdigest(count.to_bytes(8, "little"), seed=whole & 0xFFFFFFFF)
                s = sums.setdefault((host, kind, token), [0, 0, 0, whole >> 1, whole >> 1])
                s[0] += 1
                s[1] += x & 0x7FFFFFFF
                s[2] += x >> 33
                s[3], s[4] = min(s[3], whole >> 1), max(s[4], whole >> 1)
        if sums:
            keys = list(sums)
            vals = np.array([sums[k] for k in keys], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([signed(k[2]) for k in keys], pa.int64()), *[pa.array(vals[:, i]) for i in range(5)]],
                names=["host", "kind", "token", "pages", "sum_a", "sum_b", "low", "high"],
            )


def templates(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """(host, constant, skeleton): the tokens of each host's template.

    A token's occurrence vector is its count on every page of its host; two sums of hashes stand for it, so tokens of
    one vector meet by an aggregate and no task sees a host's pages. Tokens of equal vectors form a class. Valid classes
    are on least_pages pages that aren't all equal. The skeleton is made of the structural tokens of valid classes on at least
    half of the pages; a class on fewer pages is nested in it if it has structure of its own. Constant texts are those
    in a class with structural tokens (an element and its text that come and go together), or those on every one of at
    least ALL_PAGES pages."""
    schema = "host string, kind int, token long, pages long, sum_a long, sum_b long, low long, high long"
    found = pages.select("url", F.col("html").alias("html")).mapInArrow(occurrences, schema)
    found = found.groupBy("host", "kind", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "sum_a", "sum_b")], F.min("low").alias("low"), F.max("high").alias("high"))
    found = written(found.filter((F.col("kind") == 2) | ((F.col("pages") >= least_pages) & (F.col("low") < F.col("high")))), "tokens")
    hosts = found.filter("kind = 2").select("host", F.col("pages").alias("all_pages"))
    classes = found.filter("kind < 2").groupBy("host", "pages", "sum_a", "sum_b").agg(F.min("kind").alias("top"))
    own = found.filter("kind < 2").join(classes, ["host", "pages", "sum_a", "sum_b"]).join(hosts, "host")
    constant = (F.col("kind") == 1) & ((F.col("top") == 0) | ((F.col("pages") == F.col("all_pages")) & (F.col("pages") >= ALL_PAGES)))
    skeleton = (F.col("kind") == 0) & (2 * F.col("pages") >= F.col("all_pages"))
    return own.groupBy("host").agg(F.collect_list(F.when(constant, F.col("token"))).alias("constant"), F.collect_list(F.when(skeleton, F.col("token"))).alias("skeleton"))


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cache: dict[str, tuple[set[int], set[int]]] = {}
        texts = []
        for host, source, constant, skeleton in zip(*(batch.column(k) for k in (1, 2, 3, 4)), strict=True):
            key = host.as_py()
            if key not in cache:
                cache[key] = tuple({x & 0xFFFFFFFFFFFFFFFF for x in c.as_py() or ()} for c in (constant, skeleton))
            texts.append(Page(source.as_py() or "").text(*cache[key]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


#: Bytes of templates up to which they are sent to all executors; beyond, pages are joined to them by a shuffle on host, whose hot hosts Spark splits.
MOST_BROADCAST = 4 << 20


def extract_pages(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html): the whole main text, blocks joined by spaces.

    Elements that hold no article (menus, forms, notices, adverts, comments and so on, by element, role or name) are left
    out; of the rest the article element or, without one, the fullest slot of the host's template is taken, less the
    template's own texts. A null html or one without text gives an empty text, a null url a host of its own; repeated
    rows give repeated rows; an empty table gives none. Broken markup is read as browsers do where that is simple:
    what is not closed goes on, comments and scripts to their end. Other columns are not read."""
    made = written(templates(pages, least_pages), "templates")
    size = made.agg(F.coalesce(F.sum(8 * (F.size("constant") + F.size("skeleton")) + 64), F.lit(0))).first()[0]
    known = F.broadcast(made) if size <= MOST_BROADCAST else made
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", host.alias("host"), "html", "url").join(known, "host", "left").select("page_id", "host", "html", "constant", "skeleton", "url")
    kind = pages.schema["page_id"].dataType.simpleString()
    texts = rows.mapInArrow(extract, f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))

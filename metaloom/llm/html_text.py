"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mprescripts mrow mspace msub msup mtext nobr q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
FOREIGN = frozenset("svg math mi mn mo mrow mspace msub msup mtext mprescripts".split())  # a slash before the end of their tag closes them
BREAKS = frozenset({"br", "hr"})  # void elements that end a line
CLOSES = {  # an opening tag ends the innermost open element of these kinds, up to the bound
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
NOT_TEXT = frozenset("head title nav footer aside form menu dialog button select option fieldset".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Names of side parts: the first kind marks what is hardly ever the article, the second what may be a part of it.
SIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead topbar toolbar "
    "comment comments commentlist disqus respond cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing pagination pager".split()
)
WEAK_WORDS = frozenset("aside banner discussion header notice notices promotion recommended recommendations related replies reply social widget".split())
# Elements that hold a line of the article rather than a part of the page: their names count for nothing.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figure figcaption caption summary".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、]")

_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")
_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_RAW_END = {t: re.compile(rf"</{t}(?![a-z0-9])[^>]*>?", re.I) for t in RAW}


class _Element:
    """``number``: in the order of opening; ``last``: the number of the last element within; ``path``: a number for each root-to-leaf tag path; ``top``: the outermost article or main element around, or None."""

    __slots__ = ("tag", "up", "number", "last", "path", "out", "top", "head", "side", "holds")

    def __init__(self, tag: str, up: _Element | None, number: int, path: int):
        self.tag, self.up, self.number, self.last, self.path = tag, up, number, number, path
        self.out = self.holds = False
        self.side, self.top = 0, up.top if up else None
        self.head = tag == "h1" or (tag in INLINE and up is not None and up.head)


def _kind(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element holds something else than the article by its kind or role, and how its names tell: 2 of a side part, 1 perhaps, 0 not."""
    if tag in NOT_TEXT:
        return True, 0
    if "=" not in attrs and "hidden" not in attrs:
        return False, 0
    if _HIDDEN.search(attrs):
        return True, 0
    side = 0
    for name, *values in _NAMES.findall(attrs):
        value = "".join(values).lower()
        if name.lower() == "role":
            if value in NOT_TEXT_ROLES:
                return True, 0
        elif tag not in ("html", "body", "article", "main") and tag not in LINES and tag not in INLINE:
            found = set(_WORDS.split(value))
            weak = found & WEAK_WORDS if tag != "section" else found & WEAK_WORDS - {"discussion"}  # a paper's section of that name
            side = max(side, 2 if found & SIDE_WORDS else 1 if weak else 0)
    return False, side


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, text or tag, attributes) of a page in order: kinds 'text', 'open', 'end'. Each character is looked at a bounded number of times.

    Comments, declarations and raw elements give nothing. A quote counts only after an equals sign; one that nothing
    closes, and a tag without an end, are read as they stand.
    """
    at, n, last_gt = 0, len(page), page.rfind(">")
    last = {q: page.rfind(q) for q in "\"'"}
    start = 0  # of the text not yet given
    while (lt := page.find("<", at)) >= 0:
        end, mark = None, page[lt + 1 : lt + 2]
        if mark == "!" and page.startswith("<!--", lt):
            k = page.find("-->", lt + 4)
            end, token = (n if k < 0 else k + 3), None
        elif mark == "!" and page.startswith("<![CDATA[", lt):
            k = page.find("]]>", lt)
            end, token = (n if k < 0 else k + 3), None
        elif lt >= last_gt:
            break
        elif mark in ("!", "?"):
            end, token = page.find(">", lt) + 1, None
        elif m := _TAG.match(page, lt + 1):
            k = m.end()
            while True:
                if page.startswith(">", k):
                    end = k + 1
                    break
                stop = _STOP.search(page, k)
                if stop is None:
                    end = last_gt + 1
                elif (q := stop[1]) is None:
                    end = stop.end()
                elif stop.end() <= last[q]:
                    k = page.find(q, stop.end()) + 1
                    continue
                else:
                    end = page.find(">", stop.end()) + 1 or last_gt + 1
                break
            end = max(end, m.end())
            tag, attrs = m[1].lower(), page[m.end() : end - 1]
            token = ("end" if mark == "/" else "open", tag, attrs)
            if token[0] == "open" and tag in RAW and not (tag in FOREIGN and attrs.endswith("/")):
                close = _RAW_END[tag].search(page, end)
                end, token = (close.end() if close else n), None
        else:
            at = lt + 1
            continue
        if lt > start:
            yield "text", page[start:lt], ""
        if token:
            yield token
        at = start = end
    if start < n:
        yield "text", page[start:], ""


def nodes(page: str) -> tuple[list[tuple[int, str, _Element]], list[_Element]]:
    """(block number, text, element) of the texts of a page in order, and its elements. Inline elements, images and the like, comments and end tags of nothing don't end a block."""
    root = _Element("", None, 0, 0)
    stack, elements, out, block = [root], [root], [], 0
    paths: dict[tuple[int, str], int] = {}
    open_tags: defaultdict[str, int] = defaultdict(int)
    blocks, marked = [0], False  # places in the stack of elements that aren't inline; whether an article or main element came

    def close(to: int) -> None:
        for e in stack[to:]:
            e.last = elements[-1].number
            open_tags[e.tag] -= 1
        del stack[to:]
        while blocks[-1] >= to:
            blocks.pop()

    for kind, tag, attrs in _tokens(page):
        if kind == "text":
            out.append((block, html.unescape(tag) if "&" in tag else tag, stack[-1]))
        elif kind == "end":
            if tag not in INLINE and (open_tags[tag] > 0 or tag in ("p", "br")):
                block += 1
            if open_tags[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
        else:
            if tag in BREAKS or (tag not in INLINE and tag not in VOID):
                block += 1
                # A block ends an open paragraph, with whatever inline elements were left open in it.
                if tag != "br" and stack[blocks[-1]].tag == "p":
                    close(blocks[-1])
                if tag in CLOSES:
                    kinds, bound = CLOSES[tag]
                    if any(open_tags[x] > 0 for x in kinds):
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k].tag in kinds:
                                close(k)
                                break
                            if stack[k].tag in bound:
                                break
            if tag not in VOID and not (tag in FOREIGN and attrs.endswith("/")):
                up = stack[-1]
                e = _Element(tag, up, len(elements), paths.setdefault((up.path, tag), len(paths) + 1))
                out_here, e.side = _kind(tag, attrs)
                if e.top is None and (tag in ("article", "main") or 'role="main"' in attrs):
                    e.top = e
                e.out = up.out or out_here or (tag == "header" and up.top is None)
                elements.append(e)
                if tag == "h1" or (e.top is e and not marked):
                    # What holds a headline, or the first article or main element, is no side part, whatever its names.
                    marked = marked or e.top is e
                    while up is not None and not up.holds:
                        up.holds = True
                        up = up.up
                stack.append(e)
                open_tags[tag] += 1
                if tag not in INLINE:
                    blocks.append(len(stack) - 1)
    close(1)
    root.last = elements[-1].number
    # Names weigh on an element and all within; a side part that holds the headline or the article is none.
    for e in elements:
        own = 0 if e.holds else e.side
        e.side = max(own, e.up.side) if e.up is not None and not e.up.holds else own
    return out, elements


def _smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over the neighbours in page order, weights renewed at the ends."""
    r = math.ceil(2 * sigma)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    whole, n, out = sum(w), len(values), []
    for i in range(n):
        if r <= i < n - r:
            out.append(sum(map(mul, w, values[i - r : i + r + 1])) / whole)
        else:
            lo, hi = max(0, i - r), min(n, i + r + 1)
            ws = w[lo - i + r : hi - i + r]
            out.append(sum(map(mul, ws, values[lo:hi])) / sum(ws))
    return out


def main_text(page: str | None, spread: float = 0.5, named: float = 0.1) -> str:
    """The article's blocks, one a line.

    Per root-to-leaf tag path, the text length and the punctuation of its nodes are summed and divided by their number;
    both ratios are smoothed along the page and fused as their product. Nodes in an element named like a side part keep
    ``named`` of it. Nodes above ``spread`` standard deviations, before smoothing and after, are content, and so is a headline
    (h1); short texts among them are not, but come with the element around.

    Where half of the content or more stands in article or main elements, the article is that with most of it (and others with
    half as much); else it is the smallest element that holds all content nodes. All its texts are given, in page order, but for those of other kinds (menus, forms,
    footers and the like), of parts with a name of SIDE_WORDS, of parts with a name of WEAK_WORDS that hold no content node by
    their tag paths (in a page without such markup, of all of these unless most content stands in them), and, where no article or main element was marked up, of the element's own parts without a content node.
    """
    texts, elements = nodes(page or "")
    given = [(b, t, e) for b, t, e in texts if not e.out]  # white space alone has no part in the ratios, but parts words
    found = [(b, t, e) for b, t, e in given if not t.isspace()]
    if not found:
        return ""
    sums: dict[int, list[float]] = {}
    for _, t, e in found:
        s = sums.get(e.path)
        if s is None:
            s = sums[e.path] = [0.0, 0.0, 0.0]
        s[0] += len(t)
        s[1] += len(PUNCTUATION.findall(t))
        s[2] += 1
    ratios = {path: (length / n, points / n) for path, (length, points, n) in sums.items()}
    lengths = _smooth([ratios[e.path][0] for _, _, e in found])
    marks = _smooth([ratios[e.path][1] for _, _, e in found])
    fused = [a * (1 + b) * (named if e.side == 2 else 1) for a, b, (_, _, e) in zip(lengths, marks, found, strict=True)]
    mean = sum(fused) / len(fused)
    bound = spread * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    own = [a * (1 + b) for a, b in (ratios[e.path] for _, _, e in found)]
    content = [(len(t), e) for x, y, (_, t, e) in zip(fused, own, found, strict=True) if min(x, y) >= bound and e.side < 2]
    content = content or [(len(t), e) for _, t, e in found if e.side < 2] or [(len(t), e) for _, t, e in found]
    weight: Counter[int] = Counter()
    for n, e in content:
        if e.top is not None:
            weight[e.top.number] += n
    total = sum(n for n, _ in content)
    chosen = {e.number for _, e in content} | {e.number for _, _, e in found if e.head and e.side < 2}
    marked = 2 * sum(weight.values()) >= total
    if marked:
        most = max(weight.values())
        regions = [elements[k] for k in sorted(weight) if 2 * weight[k] >= most]
    else:
        region = elements[min(chosen)]
        while region.up is not None and (region.last < max(chosen) or region.tag in INLINE or region.tag in LINES):
            region = region.up
        regions = [region]
    # The part of the page that each element of a region is in: of those named like a side part the outermost, else the region's child.
    part: dict[int, _Element] = {}
    for region in regions:
        for e in elements[region.number + 1 : region.last + 1]:
            over = part.get(e.up.number)
            part[e.number] = e if over is None or (e.side == 1 and e.up.side == 0) else over
    order, blocks = sorted(chosen), {}
    heads = [r.number for r in regions]
    outside = sum(n for n, e in content if not e.side)
    for b, t, e in given:
        k = bisect.bisect_right(heads, e.number) - 1
        region = regions[k] if k >= 0 and e.number <= regions[k].last else None
        if region is None or (e.side == 2 and region.side < 2):
            continue
        # Without markup of the article, a part with a weak name is one only if most content stands in such parts.
        if not marked and e.side == 1 and region.side == 0 and 2 * outside >= total:
            continue
        over = part.get(e.number)
        if over is not None and (e.side == 1 or not marked) and over.tag not in LINES and over.tag not in INLINE:
            k = bisect.bisect_left(order, over.number)
            if k == len(order) or order[k] > over.last:
                continue
        blocks.setdefault(b, []).append(t)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of each page; n_chars counts the code points of text.

    No shuffle: pages are read one by one from the whole html. A null or empty page, or one without text, gives an empty
    text; broken markup is read as far as it goes; repeated rows are extracted each; other columns are dropped, whatever
    their names; an empty table gives no rows.
    """
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("html")).mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))

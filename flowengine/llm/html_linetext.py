"""Main text of HTML pages by line-block distribution.

1. Strip: a scanner walks the tags once. Block-level tags and breaks end a line, other tags vanish, character references
   are decoded. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known
   by tag, role, class or id, leave an empty line.
2. Distribute: a line weighs its characters outside links (nothing if most of it is links). The weights of `window`
   lines from each line on are summed. A surge is where a line with text begins a window of at least `floor` characters
   (less on a short page), a dive is the first empty line with an empty window behind it, or a stripped element.
3. Keep: every line of a marked article (article, main) that has a surge, and every region outside articles. Regions
   widen over the lines beside them that stand in a container of theirs (short lines, paragraphs that are one link), fill the gap
   to the next region of that container, and take the heading right above. Where the page marks an article, its lines get
   a bounded bonus, and a region outside needs a fifth of the largest part's mass.

A class or id marks an element by a whole word (`sidebar`), by a compound of such words and words of layout (`top-nav-bar`), or
by a compound that ends in one that names a part of any page (`post-comments`); compounds that tell a state
(`has-sidebar`) mark nothing. An element that holds most of the page's unlinked text stays, whatever its class, unless
it holds reader comments.

Each page is read whole and on its own, whatever its length; broken and cut off markup is read as far as it goes.
Defined results: null or empty html has the empty text; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import extended, table, tidy
from .tokens import chunks

WINDOW, FLOOR = 3, 120
#: HTML element names by their part on the page.
OPAQUE = set("script style noscript template svg math iframe object canvas select textarea title".split())
STRIPPED = set("head nav footer aside header form button menu dialog fieldset figcaption".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = set("article aside body center dd details div dl fieldset figure form html main section table td th ul ol".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id attributes that mark what is not the article.
_MARKS = (
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notice\w*|notification\w*|alert\w*|sidebar\w*|side|nav|navbar|navigation|menu\w*|"
    r"breadcrumbs?|footer|header|masthead|comments?|commentlist|disqus|reply|replies|respond|share\w*|social\w*|related|recommended|newsletter|subscribe\w*|signup|login|popup|modal|overlay|widget\w*|copyright|disclaimer|pagination|toolbar|skip"
)
MARK = re.compile(rf"(?:{_MARKS})$")
#: Words that join marks without changing their sense, last words that mark any compound, first words that only tell a state, and marks of reader comments.
LAYOUT = set("site page main global top bottom left right upper lower primary secondary list box block wrapper wrap container area section bar button buttons link links post posts item items icons media form unit slot text inner outer sticky fixed mobile desktop js to the and of by our".split())
LAST = set("nav navbar navigation menu sidebar footer comments commentlist breadcrumbs breadcrumb ad ads advert advertisement newsletter pagination disqus disclaimer copyright".split())
STATE = set("has have with no without is not show hide hidden uses use".split())
REMARKS = re.compile(r"(?:comments?|commentlist|disqus|reply|replies|respond)$")
_NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
_QUOTE, _ANGLE = re.compile(r"""[<>"']"""), re.compile("[<>]")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in OPAQUE}
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HEADING = re.compile(r"h[1-3]$")


def _tag_end(page: str, at: int, known: dict[int, int]) -> int:
    """Where the tag whose name ends at `at` has its `>`; len(page) if the page ends first, -1 if another tag begins first.

    Quoted values hold any character. Where the quotes don't close, they count as letters. `known` has, for each quote
    met, where the tag ends if that quote opens a value, so no stretch of the page is read again and again.
    """
    met, i = [], at
    while True:
        m = _QUOTE.search(page, i)
        if m is None or m[0] == "<":
            end = -1
        elif m[0] == ">":
            end = m.start()
        elif m.start() in known:
            end = known[m.start()]
        else:
            met.append(m.start())
            i = page.find(m[0], m.end()) + 1
            if i:
                continue
            end = -1
        break
    known.update(dict.fromkeys(met, end))
    if end < 0:
        m = _ANGLE.search(page, at)
        end = len(page) if m is None else m.start() if m[0] == ">" else -1
    return end


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, stop, name, closing, attributes) of every tag; comments and declarations have the name '', and an opaque
    element is one tag with all that it holds. One scan: the time grows with the page's length, however broken it is."""
    at, known, last = 0, {}, {}
    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at):
            mark = "-->" if page.startswith("<!--", at) else ">"
            stop = page.find(mark, at + 2 * len(mark) - 2 if len(mark) > 1 else at)
            stop = len(page) if stop < 0 else stop + len(mark)
            yield at, stop, "", False, ""
            at = stop
            continue
        m = _NAME.match(page, at)
        end = _tag_end(page, m.end(), known) if m else -1
        if end < 0:
            at += 1  # a mark of the text
            continue
        stop, name, attrs = min(end + 1, len(page)), m[2].lower(), page[m.end() : end]
        if name in OPAQUE and not m[1] and not (name in ("svg", "math") and attrs.endswith("/")):
            close = last.get(name)
            if close is None or 0 <= close.start() < stop:
                close = _CLOSE[name].search(page, stop)
                last[name] = close
            stop = close.end() if close else len(page)
        yield at, stop, name, bool(m[1]), attrs
        at = stop


def marked(word: str) -> bool:
    """Whether one word of a class or id marks what is not the article."""
    if MARK.match(word):
        return True
    parts = [x for x in re.split("[-_:]+", word) if x]
    if len(parts) < 2 or parts[0] in STATE:
        return False
    marks = [bool(MARK.match(x)) for x in parts]
    return parts[-1] in LAST or any(marks) and all(m or x in LAYOUT or x.isdigit() for m, x in zip(marks, parts)) and not all(x in ("side", "by", "to") for x in parts)


def _noise(tag: str, attrs: str, in_article: bool) -> int:
    """0: part of the article as far as its tag tells. 1: not, by a class or id. 2: not, whatever it holds."""
    if tag in STRIPPED and not (tag in ("header", "figcaption") and in_article):
        return 2
    if not attrs.strip() or tag in ("html", "body", "main"):
        return 0
    found = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                if marked(word):
                    found = max(found, 2 if any(map(REMARKS.match, re.split("[-_:]+", word))) else 1)
        elif name == "role":
            if value in ROLES:
                found = 2
        elif name == "hidden" or value == "true":
            found = 2
    return found


def spared(page: str) -> frozenset[int]:
    """Where elements begin that a class or id marks although they hold most of the page's unlinked text."""
    open_: dict[str, list[tuple[int, int, int]]] = {}
    begun, total, at, in_link = [], 0, 0, False
    for start, stop, tag, closing, attrs in tags_of(page):
        if start > at and not in_link:
            total += start - at
        at = stop
        if not tag or tag in OPAQUE or tag in VOID or attrs.endswith("/"):
            continue
        if tag == "a":
            in_link = not closing
        if not closing:
            open_.setdefault(tag, []).append((start, total, len(begun)))
            if _noise(tag, attrs, False) == 1:
                begun.append([start, total, None])
        elif open_.get(tag):
            first, _, i = open_[tag].pop()
            if i < len(begun) and begun[i][0] == first:
                begun[i][2] = total
    total += 0 if in_link else len(page) - at
    return frozenset(start for start, before, after in begun if 2 * ((total if after is None else after) - before) > total)


def lines_of(page: str) -> list[tuple[str, int, int, bool, int, bool]]:
    """(text, weight, article number or 0, heading, container, paragraph) of every line; a stripped element is ('', -1, ..)."""
    out: list[tuple[str, int, int, bool, int, bool]] = []
    parts: list[str] = []
    linked = article = depth = articles = skip = in_link = 0
    skipped, heading, paragraph, spare = "", False, False, None
    inside, many, open_ = [("", 0)], 0, {}  # containers around, containers so far, how many of a name are open

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            parts.clear()
            if text:
                n = len(text)
                out.append((text, 0 if 2 * linked > n else n - linked, article, heading, inside[-1][1], paragraph))
        linked = 0

    at = 0
    for start, stop, tag, closing, attrs in tags_of(page):
        if start > at and not skip:
            parts.append(page[at:start])
            linked += (start - at) * (in_link > 0)
        at = stop
        if not tag:
            continue
        if tag in OPAQUE:
            if not skip and tag in BLOCKS:
                flush()
            continue
        if skip:
            if tag == skipped and not attrs.endswith("/"):
                skip += -1 if closing else 1
            elif tag in ("article", "main") and not closing and not articles and not _noise(tag, attrs, False):
                skip = 0  # an element that was never closed does not swallow the article
            elif skipped in ("p", "li") and tag in BLOCKS and (tag != "li" or skipped == "li"):
                skip = 0
            if tag in ("body", "html"):
                skip = 0
            if skip or tag == skipped and closing:
                continue
        if not closing and tag not in VOID and not attrs.endswith("/") and (noise := _noise(tag, attrs, article > 0)):
            if noise == 1 and spare is None:
                spare = spared(page)
            if noise == 2 or start not in spare:
                flush()
                out.append(("", -1, article, False, inside[-1][1], False))
                skip, skipped = 1, tag
                continue
        if tag in BLOCKS:
            flush()
            heading = bool(_HEADING.match(tag)) and not closing
            paragraph = tag in ("p", "blockquote", "pre") and not closing or tag == "br" and paragraph
            if tag in CONTAINERS and not attrs.endswith("/"):
                if not closing:
                    many += 1
                    inside.append((tag, many))
                    open_[tag] = open_.get(tag, 0) + 1
                elif open_.get(tag):
                    name = ""
                    while name != tag:
                        name, _ = inside.pop()
                        open_[name] -= 1
            if tag in ("article", "main"):
                depth += -1 if closing else 1
                if not closing and depth == 1:
                    articles += 1
                    article = articles
                elif depth <= 0:
                    depth = article = 0
        elif tag == "a":
            in_link = 0 if closing else 1
    if not skip:
        parts.append(page[at:])
    flush()
    return out


def distribution(lines: list[tuple], window: int, floor: int) -> tuple[list[int], list[int]]:
    """Weight of every line, and the sum of the weights of `window` lines from each on.

    A line with unlinked text in a marked article weighs a little more; the bonus of a window stays below `floor`, so no
    mark alone makes a surge, and text outside keeps its weight.
    """
    bonus = max(floor - 1, 0) // window
    weights = [x[1] + (bonus if x[2] else 0) if x[1] > 0 else 0 for x in lines]
    return weights, [sum(weights[i : i + window]) for i in range(len(weights))]


def regions_of(lines: list[tuple], weights: list[int], sums: list[int], floor: int) -> list[tuple[int, int]]:
    """[surge, dive) of every region."""
    out, i, n = [], 0, len(lines)
    while i < n:
        if not weights[i] or sums[i] < floor:
            i += 1
            continue
        article, j = lines[i][2], i  # surge
        while j < n and lines[j][1] >= 0 and sums[j] > 0 and lines[j][2] == article:
            j += 1  # dive
        while not weights[j - 1]:
            j -= 1
        out.append((i, j))
        i = j
    return out


def widened(lines: list[tuple], a: int, b: int) -> tuple[int, int]:
    """[a, b) and the lines beside it, across stripped elements, that are of its containers: unlinked ones and paragraphs."""
    own = {x[4] for x in lines[a:b] if x[0]}
    mine = lambda x: x[2] == lines[a][2] and (x[1] < 0 or x[4] in own and (x[1] > 0 or x[5]))
    i, j = a - 1, b
    while i >= 0 and mine(lines[i]):
        a = i if lines[i][0] else a
        i -= 1
    while j < len(lines) and mine(lines[j]):
        b = j + 1 if lines[j][0] else b
        j += 1
    if a and lines[a - 1][3] and lines[a - 1][0] and lines[a - 1][2] == lines[a][2]:
        a -= 1
    return a, b


def main_text(page: str | None, window: int = WINDOW, floor: int = FLOOR) -> str:
    lines = lines_of(page or "")
    weights, sums = distribution(lines, window, floor)
    floor = min(floor, max(sums, default=0) // 2 + 1)
    regions, mass, plain = regions_of(lines, weights, sums, floor), {}, {}
    for a, b in regions:
        part = (lines[a][2], 0 if lines[a][2] else a)  # regions of one article stay or go together
        mass[part] = mass.get(part, 0) + sum(weights[a:b])
        plain[part] = plain.get(part, 0) + sum(x[1] for x in lines[a:b] if x[1] > 0)
    most, marks = max(mass.values(), default=0), any(article for article, _ in mass)
    stay = {part for part in mass if 5 * mass[part] >= most or not marks or part[0] and plain[part] >= floor}
    keep = [bool(x[2]) and (x[2], 0) in stay for x in lines]
    before = None
    for a, b in regions:
        if lines[a][2] or (0, a) not in stay:
            continue
        own = {x[4] for x in lines[a:b] if x[0]}
        a, b = widened(lines, a, b)
        if before and own & before[1] and not any(x[2] for x in lines[before[0] : a]):
            a = min(a, before[0])  # nothing is dropped between two regions of one container
        keep[a:b] = [True] * (b - a)
        before = (b, own)
    return " ".join(x[0] for x, stays in zip(lines, keep) if stays and x[0])


def main_texts(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """pages with a column `out` (a name that pages does not have) in place of `source`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, name=source):
            texts = pa.array([main_text(x) for x in b.column(source).to_pylist()], pa.string())
            kept = [i for i, name in enumerate(b.schema.names) if name != source]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], texts], [*[b.schema.names[i] for i in kept], out])

    return pages.mapInArrow(tidy(run), T.StructType([f for f in extended(pages, **{out: T.StringType()}) if f.name != source]))


def op4_main_text(spark, sf_dir: str) -> DataFrame:
    rows = main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))


#: For pages whose main text stands in one article element, as those of the test tables.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<[a-zA-Z/][^<>]*>', chr(10), 'g') AS x FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '&(amp|quot)$', '&\1;'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM b"""

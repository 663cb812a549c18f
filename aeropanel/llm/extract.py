"""HTML extraction by tag-path ratios: text and punctuation of each root-to-leaf tag path, smoothed, fused and thresholded."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

# Elements of HTML by what they do to the text around and in them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER_TEXT = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe label legend menu nav noscript object option select svg template title video".split())
RAW_TEXT = frozenset("script style textarea xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_FLOW = frozenset("blockquote caption center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre summary table tbody td tfoot th thead tr ul".split())
# Words of class, id and role that name what is not an article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer form login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# An element that opens ends these, up to the element that bounds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}

TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']++)))?""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in RAW_TEXT}
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：؟،।]")


@dataclass
class Leaves:
    """The blocks of a page that may be content, in page order, and the tag path, link characters, container and article of each."""

    texts: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    home: list[int] = field(default_factory=list)
    root: list[int] = field(default_factory=list)


def _attributes(tag: str, raw: str) -> tuple[str, bool]:
    """(the first class, for the path; whether the element can't be content)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    names = [found.get(k, "") for k in ("class", "id", "role")]
    words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", " ".join(names)).lower()))
    aside = bool(words & ({"comment", "comments"} if tag == "article" else ASIDE_WORDS)) and tag not in ("html", "body", "main")
    return names[0].split()[0].lower() if names[0].strip() else "", hidden or aside


def leaves(html: str) -> Leaves:
    """Parses a page leniently: end tags may lack or stray, references are decoded, white space (no-break spaces too) becomes one space.

    Inline elements belong to their block and ``br`` is white space. A block's path is made of its block elements and
    their first classes; its ``home`` is the nearest ancestor, or itself, that isn't a paragraph, heading, list or
    table, its ``root`` the nearest ``article`` or ``main`` (0: none).
    """
    out, paths, held = Leaves(), {}, []
    stack = [("", 0, False, 0, 0)]  # tag, path, out of content, home, root
    at = linked = in_link = elements = 0

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                _, path, _, home, root = stack[-1]
                out.texts.append(text)
                out.path.append(path)
                out.links.append(min(linked, len(text)))
                out.home.append(home)
                out.root.append(root)
            held.clear()
            linked = 0

    while at < len(html):
        token = TOKEN.search(html, at)
        piece = html[at : token.start() if token else len(html)]
        if piece and not stack[-1][2]:
            held.append(piece)
            linked += in_link * len(piece)
        if not token:
            break
        at, tag = token.end(), (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS or tag in NEVER_TEXT:
                up = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if tag in BLOCKS:
                    flush()
                if up:
                    del stack[up:]
        elif tag in RAW_TEXT:
            end = RAW_END[tag].search(html, at)
            at = end.end() if end.end() > end.start() else len(html)
            at = html.find(">", at) + 1 or len(html)
        elif tag == "a":
            in_link = 1
        elif tag == "br":
            held.append(" ")
        elif tag == "hr":
            flush()
        elif (tag in BLOCKS or tag in NEVER_TEXT) and tag not in VOID:
            if tag in BLOCKS:
                flush()
                if stack[-1][0] == "p" or stack[-1][0] == "head" and tag not in ("title", "noscript"):
                    stack.pop()
                ends, bounds = ENDS.get(tag, ((), ()))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
            _, path, dropped, home, root = stack[-1]
            name, aside = _attributes(tag, token[3]) if token[3] else ("", False)
            dropped = dropped or aside or tag in NEVER_TEXT or tag == "header" and not root
            elements += 1
            home = home if tag in IN_FLOW else elements
            root = elements if tag in ("article", "main") else root
            stack.append((tag, paths.setdefault((path, tag, name), len(paths) + 1), dropped, home, root))
    flush()
    return out


def path_scores(found: Leaves, spread: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(each leaf's place in the list of paths, each path's fused ratio).

    A path has two ratios: characters outside links and punctuation, both a leaf. Laid out in page order they are
    smoothed by a Gaussian of ``spread`` leaves, averaged over the path's leaves and fused as text * (1 + punctuation).
    """
    _, of = np.unique(np.asarray(found.path), return_inverse=True)
    n = np.bincount(of)
    chars = np.fromiter(map(len, found.texts), np.float64, len(of))
    marks = np.fromiter((len(PUNCTUATION.findall(t)) for t in found.texts), np.float64, len(of))
    reach = max(1, round(3 * spread))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    smooth = lambda x: np.convolve(x, kernel)[reach:-reach]
    weight = smooth(np.ones(len(of)))

    def ratio(amount: np.ndarray) -> np.ndarray:
        return np.bincount(of, smooth((np.bincount(of, amount) / n)[of]) / weight) / n

    return of, ratio(chars - np.asarray(found.links)) * (1 + ratio(marks))


def content(found: Leaves, factor: float = 1.0) -> np.ndarray:
    """Which leaves are content.

    Paths whose fused ratio reaches ``factor`` standard deviations of the page's (over leaves), but for those mostly of
    links, are selected. What stands in the same container as a selected leaf, or in the same article, goes with it
    (headings, short paragraphs, lists, tables), again but for paths mostly of links.
    """
    if not found.texts:
        return np.zeros(0, bool)
    of, fused = path_scores(found)
    chars = np.bincount(of, [len(t) for t in found.texts])
    own_text = np.bincount(of, found.links) * 2 <= chars
    best = ((fused >= factor * fused[of].std()) & own_text)[of]
    home, root = np.asarray(found.home), np.asarray(found.root)
    near = np.isin(home, home[best]) | (root > 0) & np.isin(root, root[best])
    return near & own_text[of]


def main_text(html: str) -> str:
    """The content blocks of a page, a line each."""
    found = leaves(html)
    return "\n".join(t for t, kept in zip(found.texts, content(found).tolist()) if kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``text``, the main text of ``column``, and ``n_chars``, its code points.

    A null page is an empty one and has an empty text; pages of any length are read whole, each by itself, so ties,
    repeated rows and pages of one site need no shuffle; no rows give no rows. Where ``pages`` has a column of a result's
    name, it stays and the results get underscores before theirs.
    """
    text, n = ("text", "n_chars") if not {c.lower() for c in pages.columns} & {"text", "n_chars"} else unused(pages, "text", "n_chars")

    def run(html: pa.Array) -> pa.Array:
        return pa.array((main_text(h.as_py() or "") for h in html), pa.string())

    out = pages.withColumn(text, F.arrow_udf(run, "string")(F.col(f"`{column}`").cast("string")))
    return out.withColumn(n, F.length(text).cast("long"))


def op11(pages: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``pages``.

    Null and empty html: empty text and 0; null page_id or url stay null; very long pages whole; repeated rows each;
    no rows give no rows; other columns go.
    """
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


# The articles of the given tables by their markup alone: an independent way to the same rows.
ORACLE = r"""
WITH article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages),
block AS (SELECT page_id, url, unnest(list_zip(l, range(len(l)))) AS b FROM (SELECT page_id, url, regexp_split_to_array(a, '</?(?:p|h1)>') AS l FROM article)),
plain AS (
  SELECT page_id, url, b[2] AS i,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b[1], '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t
  FROM block)
SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE t <> ''), '') AS text,
  CAST(length(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE t <> ''), '')) AS BIGINT) AS n_chars
FROM plain GROUP BY page_id, url
"""

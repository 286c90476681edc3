"""Main text of web pages by the maximum-scoring run of tokens.

A page is read as words and tags. Tags score negative; words score by where they stand (content, link, outside) on pages
that mark their article, and on others by what their block looks like: its element, its length, its share of links, its
last character. All weights are log-odds counted on labelled pages, those that mark their article themselves, with the
mark hidden for the looks of blocks. One linear scan finds the run of tokens with the largest sum: the content region.
Its blocks are the text, without what stands in menus, notices, forms and other such elements inside it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "select",
       "title", "xmp", "noembed", "noframes")
NOISE = frozenset("nav header footer aside form dialog menu head button".split()) | frozenset(RAW)
ARTICLE = frozenset(("article", "main"))
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                    "ruby s samp small span strike strong sub sup time tt u var wbr").split())
#: Class, id or role words of elements that are no article text.
NOISE_WORDS = re.compile(
    r"(?:^|\s|(?<!has)(?<!with)(?<!no)[_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|"
    r"subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|footer|masthead|site-?header|"
    r"page-?header|toolbar|pagination|pager|share|sharing|social|related|recommended|comments?|commentlist|replies|"
    r"reply|disqus|search|contentinfo|complementary)(?:$|[\s_-])", re.IGNORECASE)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*))(?:>|\Z|(?=<))", re.DOTALL)
_CUES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}\s*(?:>|\Z)|</{name}\s[^>]*>", re.IGNORECASE) for name in RAW}
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden|aria-hidden\s*=\s*[\"']?true)(?=[\s\"'/]|$)", re.IGNORECASE)

CONTENT, LINK, OUTSIDE, NOISY = "content", "link", "outside", "noise"
#: Weights where no page is labelled; the counted ones replace them.
DEFAULT_WEIGHTS = {CONTENT: 1.0, LINK: -0.5, OUTSIDE: -2.0}
LEAST_TAG, DEFAULT_TAG = -0.05, -0.2
#: Names below this share of all counted words and tags are counted together.
RARE_SHARE = 1e-5
RARE = "rare"
#: Words that looks are learned from at least, inside and outside articles; with fewer, pages without a mark are scanned
#: by places alone.
LEAST_WORDS = 100
#: Least and largest weight of a block's element and of its other looks, as sites differ more in their elements than in
#: the length of their paragraphs, and a short block may be a heading.
ELEMENT_WEIGHTS, LOOK_WEIGHTS = (-3.0, 3.0), (-2.0, 4.0)


_ARTICLE = re.compile(r"<(?:article|main)[\s/>]", re.IGNORECASE)


def has_article(page: str) -> bool:
    """True if the page opens an article or main element, scripts and comments apart."""
    if not _ARTICLE.search(page):
        return False
    pos = 0
    while found := _TOKEN.search(page, pos):
        pos = found.end()
        name = (found["name"] or "").lower()
        if not found["close"] and name in ARTICLE:
            return True
        if not found["close"] and name in _RAW_END:
            over = _RAW_END[name].search(page, pos)
            pos = over.end() if over else len(page)
    return False


def tokens(page: str, hide: bool = False) -> Iterator[tuple[str, str, str]]:
    """(kind, value, place): kind 'text' with the raw text, or 'tag' with the element's name (`br` included).

    place: CONTENT inside an article (anywhere on pages without one), LINK, OUTSIDE, NOISY. hide: read the page as
    one that marks no article and names no classes.
    """
    marked = not hide and has_article(page)
    stack: list[tuple[str, bool, bool, bool]] = []  # name, noise, article, link: each true from that element inwards
    noise = link = False
    article = not marked
    pos, end = 0, len(page)

    def place() -> str:
        return NOISY if noise else LINK if link and article else CONTENT if article else OUTSIDE

    while pos < end:
        found = _TOKEN.search(page, pos)
        start = found.start() if found else end
        if start > pos:
            yield "text", page[pos:start], place()
        if not found:
            return
        pos = found.end()
        if found["name"] is None:
            continue
        name = found["name"].lower()
        if found["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    # an article's end is no end of what surrounds it, nor may an inline end close a block
                    if name in INLINE and any(s[0] not in INLINE for s in stack[depth + 1:]):
                        break
                    del stack[depth:]
                    break
            noise, article, link = stack[-1][1:] if stack else (False, not marked, False)
            yield "tag", name, place()
            continue
        yield "tag", name, place()
        if name in VOID or found["rest"].endswith("/") and name in RAW:
            continue
        if name in _RAW_END:
            over = _RAW_END[name].search(page, pos)
            pos = over.end() if over else end
            continue
        if name not in INLINE and stack:
            # a block ends inline elements left open before it, and a paragraph ends the paragraph before
            while stack and (stack[-1][0] in INLINE and not stack[-1][1] or stack[-1][0] == "p" or stack[-1][0] == name == "li"):
                stack.pop()
            noise, article, link = stack[-1][1:] if stack else (False, not marked, False)
        cues = "" if hide else " ".join(a or b or c for _, a, b, c in _CUES.findall(found["rest"]))
        noise = noise or name in NOISE and not (name == "header" and article and marked) or bool(
            cues and name not in ("html", "body", *ARTICLE) and NOISE_WORDS.search(cues)
            or cues and name in ARTICLE and re.search(r"comment|repl(?:y|ies)", cues, re.IGNORECASE)
            or _HIDDEN.search(found["rest"]))
        article = article or name in ARTICLE
        link = link or name == "a"
        stack.append((name, noise, article, link))


def looks(stream: list[tuple[str, str, str]]) -> list[tuple[str, ...]]:
    """For each token the looks of its block (of text outside noise; empty for tags and noise): the block's last tag,
    length, share of linked words, and whether it ends like a sentence."""
    out: list[tuple[str, ...]] = [()] * len(stream)
    block: list[int] = []
    tag = "start"

    def close() -> None:
        texts = [stream[k][1] for k in block]
        n = sum(len(t.split()) for t in texts)
        if n:
            linked = sum(len(stream[k][1].split()) for k in block if stream[k][2] == LINK)
            last = "".join(texts).rstrip()[-1:]
            found = (f"block {tag}", f"length {min(n.bit_length(), 8)}", f"links {round(4 * linked / n)}",
                     f"end {last in '.!?:;…。！？'}")
            for k in block:
                out[k] = found
        block.clear()

    for k, (kind, value, place) in enumerate(stream):
        if kind == "tag":
            if value not in INLINE and value != "br":
                close()
                tag = value
        elif place != NOISY:
            block.append(k)
    close()
    return out


def labelled_counts(page: str) -> dict[tuple[str, bool], int]:
    """Words by place and by looks, and tags by name, inside and outside the article; empty for a page that marks none."""
    counts: dict[tuple[str, bool], int] = {}
    if not has_article(page):
        return counts

    def count(name: str, inside: bool, n: int) -> None:
        counts[name, inside] = counts.get((name, inside), 0) + n

    shown, hidden = list(tokens(page)), list(tokens(page, hide=True))
    for (kind, value, place), (_, _, plain), look in zip(shown, hidden, looks(hidden)):
        inside = place in (CONTENT, LINK)
        if place != NOISY:
            count(f"<{value}>" if kind == "tag" else place, inside, 1 if kind == "tag" else len(value.split()))
        if plain != NOISY:
            if kind == "tag":
                count(f"plain <{value}>", inside, 1)
            for name in look:
                count(name, inside, len(value.split()))
    return counts


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of standing inside the article, smoothed; words inside stay positive and every tag negative."""
    weights = dict(DEFAULT_WEIGHTS)
    kinds: dict[str, list[tuple[str, bool]]] = {}
    for key in counts:
        # looks are shares of their own kind; places and tags of all tokens
        kinds.setdefault(key[0].split(" ")[0] if " " in key[0] else "", []).append(key)
    for kind, keys in kinds.items():
        inside = sum(counts[k] for k in keys if k[1])
        outside = sum(counts[k] for k in keys if not k[1])
        if min(inside, outside) < (LEAST_WORDS if kind and kind != "plain" else 1):
            continue
        for name in {name for name, _ in keys}:
            odds = math.log(((counts.get((name, True), 0) + 1) / (inside + 1))
                            / ((counts.get((name, False), 0) + 1) / (outside + 1)))
            if name.startswith(("<", "plain")):
                weights[name] = min(LEAST_TAG, odds)
            elif name == CONTENT:
                weights[name] = max(0.5, odds)
            elif kind:
                least, most = ELEMENT_WEIGHTS if kind == "block" else LOOK_WEIGHTS
                weights[name] = max(least, min(most, odds))
            else:
                weights[name] = min(-0.1, odds)
    return weights


def region(page: str, weights: dict[str, float]) -> list[tuple[str, str, str]]:
    """The run of tokens with the largest sum.

    Menus, notices and the like are left out before the scan, so they neither add to a region nor cut it. Pages that
    mark no article are scanned by the looks of their blocks, where weights for these were learned.
    """
    by_looks = not has_article(page) and any(name.startswith("length ") for name in weights)
    stream = list(tokens(page))
    seen = looks(stream) if by_looks else None
    prefix = "plain <" if by_looks else "<"
    other = weights.get(f"{prefix}{RARE}>", DEFAULT_TAG)
    best = total = 0.0
    first, found = 0, (0, 0)
    for k, (kind, value, place) in enumerate(stream):
        if total <= 0:
            total, first = 0.0, k
        if place == NOISY:
            continue
        if kind == "tag":
            total += weights.get(f"{prefix}{value}>", other)
        elif by_looks:
            total += len(value.split()) * sum(weights.get(name, 0.0) for name in seen[k])
        else:
            total += weights[place] * len(value.split())
        if total > best:
            best, found = total, (first, k + 1)
    return stream[found[0]:found[1]]


def extract(page: str, weights: dict[str, float]) -> str:
    """Text of the best region: blocks in page order, joined by an empty line."""
    blocks: list[list[str]] = [[]]
    for kind, value, place in region(page, weights):
        if kind == "tag":
            if value == "br":
                blocks[-1].append(" ")
            elif value not in INLINE:
                blocks.append([])
        elif place in (CONTENT, LINK):
            blocks[-1].append(value)
    joined = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


# -- Spark -------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[str, bool], int] = {}
    for batch in batches:
        for page in batch.column("html").to_pylist():
            for key, n in labelled_counts(page).items():
                totals[key] = totals.get(key, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in totals], pa.string()),
                                      pa.array([i for _, i in totals], pa.bool_()),
                                      pa.array(list(totals.values()), pa.int64())], names=["name", "inside", "n"])


def learn_weights(pages: DataFrame, html_col: str = "html", rare_share: float = RARE_SHARE) -> dict[str, float]:
    """Weights from every page that marks its article.

    All names are counted; those below `rare_share` of all counted words and tags are added up as one rare name, so that
    1 / rare_share rows at most reach the driver.
    """
    rows = pages.select(F.col(html_col).alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    each = (rows.mapInArrow(_count, "name string, inside boolean, n long").groupBy("name")
            .agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"),
                 F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o")))
    every = each.agg(F.sum(F.col("i") + F.col("o")).alias("all"))
    rare = F.col("name").contains("<") & (F.col("i") + F.col("o") < F.col("all") * rare_share)
    name = F.when(rare, F.concat(F.substring_index("name", "<", 1), F.lit(f"<{RARE}>"))).otherwise(F.col("name"))
    counts = (each.crossJoin(F.broadcast(every))  # one row on the right
              .groupBy(name.alias("name")).agg(F.sum("i").alias("i"), F.sum("o").alias("o")).collect())
    return weights_from({(r["name"], side): r[c] for r in counts for side, c in ((True, "i"), (False, "o"))})


def _texts(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  weights: dict[str, float] | None = None) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    weights: given, or learned from the pages themselves. NULL and empty html give an empty text, as do pages without
    words outside menus, scripts and the like. Ids and urls are passed through, NULL and repeated ones too. An empty
    table gives no rows; other columns are left out.
    """
    weights = learn_weights(pages, html_col) if weights is None else weights
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_texts(weights), f"page_id {id_type}, url string, text string, n_chars long")

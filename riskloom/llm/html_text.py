"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, in page order, each with its open ancestors. Scripts,
styles, comments and markup are no text; character references are decoded. A block's features are its ancestors' tags, words in
their class, id and role that name a part of a page, and of its text the length, link share, and ending. Viterbi decoding over
the page's blocks marks article or other, and the article's blocks are the page's text.

Training takes labelled pages: those of PAGES here, whose blocks are labelled by a data-part attribute that is no feature, and
at most max_rows pages of the table (a bound on the fit alone) that carry the semantic tags by which a block is surely an
article's (under article or main alone) or surely not (under nav, header, footer, aside or form). Long pages are trained on in
runs of RUN blocks, none of which is left out.

Time is linear in the page's length, whatever its nesting and quotes.

Defined cases: null and empty html have no text; a page without blocks has the text ""; repeated rows get a row each; unclosed
and stray tags, and html cut off inside a tag, are read as far as they go; an empty table gives an empty result; extra columns
are not read. Pages of any length are read whole.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import read_table
from riskloom.llm.crf import LinearChain, train, viterbi

# Tags by their part in HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript object ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset("head title script style noscript template iframe object svg canvas audio video textarea select option button map datalist".split())
RAW_TAGS = "script|style|textarea|title|iframe|noembed|noframes|xmp"
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - frozenset("body html head option button caption legend td th tr tbody thead tfoot".split())
SPACE_TAGS = frozenset(("br", "img", "input", "wbr"))
#: Tags that end an open one of the same set, up to the nearest tag that bounds them.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
GOOD_TAGS = ("article", "main", "p", "h1", "blockquote", "pre")
BAD_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "search", "li", "table", "label", "figure")
GOOD_NAMES = re.compile(r"article|content|post|story|entry|main|body|text|prose", re.A)
BAD_NAMES = {
    "advert": re.compile(r"(?<![a-z])ads?(?![a-z])|advert|sponsor|promo|banner|affiliate", re.A),
    "menu": re.compile(r"nav|menu|breadcrumb|pagination|pager|tabs|toc(?![a-z])|skip", re.A),
    "edge": re.compile(r"footer|header|masthead|copyright|legal|topbar|bottom", re.A),
    "side": re.compile(r"side|related|recommend|widget|trending|popular|share|social|tags(?![a-z])|newsletter|subscribe|signup|login|search", re.A),
    "notice": re.compile(r"cookie|consent|notice|popup|modal|overlay|paywall|alert|gdpr|disclaimer", re.A),
    "comment": re.compile(r"comment|respond|replies|disqus|discussion|feedback|review", re.A),
}

# A start or end tag whose values are all closed and hold no angle bracket; a try that fails reads no further than the next of them.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^<>"'=]++|=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]++))*+)>""")
OPENING = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|[^<]++|<", re.S)
GAP, NAME, EQUALS, BARE = re.compile(r"[\s/]*+"), re.compile(r"[^\s/>][^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
NAMED = re.compile(r"""\b(?:class|id|role|data-part)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r'data-part="(\w+)"')
HIDING = re.compile("hidden|style", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!|;|$)", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW_TAGS.split("|")}
MAX_ROWS, RUN, REPEATS = 400, 100, 30
RESULT = "page_id long, url string, text string, n_chars long"


TOLD_TAGS = frozenset((*GOOD_TAGS, *BAD_TAGS))  # that features or labels ask for


@dataclass
class Block:
    text: str
    tags: frozenset  # of TOLD_TAGS, around it
    names: frozenset  # of the kinds of names around it: good, and keys of BAD_NAMES
    link_share: float
    part: str | None  # of labelled pages


@dataclass(slots=True)
class Open:
    """An open element, with what it and those around it tell of a block."""

    tag: str
    mute: bool
    tags: frozenset
    names: frozenset
    part: str | None


OUTSIDE = Open("", False, frozenset(), frozenset(), None)


def name_kinds(names: str) -> frozenset:
    return frozenset([*(["good"] if GOOD_NAMES.search(names) else []), *(k for k, p in BAD_NAMES.items() if p.search(names))])


def tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag ends whose name ends at at. Quotes open a value only after an equals sign; a value whose quote is never closed
    ends at the next angle bracket. unclosed gathers the quotes that occur no more, so that each is looked for in vain once."""
    while True:
        at = GAP.match(page, at).end()
        if at >= len(page):
            return at
        if page[at] == ">":
            return at + 1
        at = NAME.match(page, at).end()
        if m := EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                stop = -1 if quote in unclosed else page.find(quote, at + 1)
                if stop < 0:
                    unclosed.add(quote)
                    stop = page.find(">", at)
                    return stop + 1 if stop >= 0 else len(page)
                at = stop + 1
            else:
                at = BARE.match(page, at).end()


def is_hidden(attributes: str) -> bool:
    """Whether a start tag's attributes hide its element: hidden of any value, aria-hidden of true, or a style with display: none."""
    if not HIDING.search(attributes):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NO_DISPLAY.search(value):
            return True
    return False


def leaf_blocks(page: str) -> list[Block]:
    """Runs of text between block-level tags, with the tags and names open around them. Every step looks at the innermost open
    elements alone, found by tag, so time grows with the page and not with its depth."""
    blocks: list[Block] = []
    stack = [OUTSIDE]
    places: dict[str, list[int]] = {}  # of the open elements, by tag
    open_blocks: list[int] = []
    kinds: dict[str, frozenset] = {}
    silent = links = linked = total = 0
    buffer: list[str] = []
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked, total
        if buffer:
            text = " ".join(html_module.unescape("".join(buffer)).split())
            if text:
                top = stack[-1]
                blocks.append(Block(text, top.tags, top.names, linked / max(total, 1), top.part))
            buffer.clear()
        linked = total = 0

    def pop_to(at: int) -> None:
        nonlocal silent, links
        while len(stack) > at:
            last = stack.pop()
            places[last.tag].pop()
            if last.tag in BLOCK_TAGS:
                open_blocks.pop()
            silent -= last.mute
            links -= last.tag == "a"

    innermost = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
    at, end = 0, len(page)
    while at < end:
        m = TAG.match(page, at) or OPENING.match(page, at)
        if m is None:
            m = OTHER.match(page, at)
            at = m.end()
            piece = m.group()
            if (piece[0] != "<" or piece == "<") and not silent:
                buffer.append(piece)
                total += len(piece)
                linked += len(piece) if links else 0
            continue
        at = m.end() if m.re is TAG else tag_end(page, m.end(), unclosed)
        tag = m.group(2).lower()
        if tag in BLOCK_TAGS:
            flush()
        elif tag in SPACE_TAGS:
            buffer.append(" ")
        if m.group(1):
            k = innermost((tag,))
            inside = k > (open_blocks[-1] if open_blocks else 0)
            if k and (inside or tag in BLOCK_TAGS or tag == "a"):  # no other inline end tag closes the block around it
                if not inside:
                    flush()
                pop_to(k)
            continue
        if tag in CLOSES_P and open_blocks and stack[open_blocks[-1]].tag == "p":
            pop_to(open_blocks[-1])
        if tag in SIBLINGS:
            same, bound = map(innermost, SIBLINGS[tag])
            if same > bound:
                pop_to(same)
        if tag in VOID_TAGS:
            continue
        if tag == "body" and silent:
            pop_to(1)
        attributes = m.group(3) if m.re is TAG else page[m.end() : at].removesuffix(">")
        if tag in RAW_END:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else end
            continue
        top, names, part = stack[-1], "", None
        if attributes:
            names = " ".join(a or b or c for a, b, c in NAMED.findall(PART.sub("", attributes))).lower()
            part = PART.search(attributes)
        if names and names not in kinds:
            kinds[names] = name_kinds(names)
        mute = tag in SILENT_TAGS or is_hidden(attributes)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            open_blocks.append(len(stack))
        stack.append(Open(tag, mute, top.tags | {tag} if tag in TOLD_TAGS and tag not in top.tags else top.tags, top.names | kinds[names] if names and not kinds[names] <= top.names else top.names, part.group(1) if part else top.part))
        silent += mute
        links += tag == "a"
    flush()
    return blocks


def features(blocks: list[Block]) -> np.ndarray:
    good, bad = len(GOOD_TAGS), len(BAD_TAGS)
    rows = np.zeros((len(blocks), 8 + good + bad + 1 + len(BAD_NAMES)), np.float32)
    seen: dict[tuple, np.ndarray] = {}
    for i, b in enumerate(blocks):
        place = seen.get((b.tags, b.names))
        if place is None:
            place = seen[b.tags, b.names] = np.array([*(t in b.tags for t in GOOD_TAGS), *(t in b.tags for t in BAD_TAGS), "good" in b.names, *(kind in b.names for kind in BAD_NAMES)], np.float32)
        n = b.text.count(" ") + 1
        rows[i, :8] = (1, n < 4, 4 <= n < 12, n >= 12, b.link_share > 0.5, b.text[-1] in ".!?\"»”…", i == 0, "©" in b.text)
        rows[i, 8:] = place
    return rows


# Labelled pages (fixed values): c content, o other. They hold the parts of a page that few pages of a crawl have all at once.
_C, _O = ' data-part="c"', ' data-part="o"'
_SENTENCES = ("The committee met on Tuesday and agreed on a new plan for the harbour, which had been closed since the spring.", "Nobody expected the report to be so short.", "Prices rose again last week, and suppliers warned that deliveries would be late for the rest of the year.", "Rain.", "She said that the work would take two more years, and that the town had no choice but to wait.", "Three of the five bridges are open now.")


def labelled_pages() -> list[str]:
    s = _SENTENCES
    paragraphs = [f"<p{_C}>{a} {b}</p>" for a, b in zip(s, s[2:] + s[:2], strict=True)]
    body = "".join(paragraphs)
    comments = "".join(f'<div class="comment"{_O}><b>reader{k}</b><p>{t}</p></div>' for k, t in enumerate(s[:3]))
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", "Sport", "About us"))
    chrome = f"<header{_O}><p>The Daily Example</p></header><nav{_O}><ul>{menu}</ul></nav>"
    foot = f"<footer{_O}><p>&copy; Example Media. All rights reserved.</p></footer>"
    side = f'<aside class="sidebar"{_O}><h3>Related stories</h3><ul>{menu}</ul><p>{s[2]}</p></aside>'
    form = f'<form class="newsletter"{_O}><label>Your address</label><p>Subscribe to our letter.</p></form>'
    notice = f'<div class="cookie-notice" id="consent"{_O}><p>We use cookies. {s[1]}</p></div>'
    advert = f'<div class="ad"{_O}>{s[0]}</div><div class="ad-banner sponsored"{_O}><p>{s[2]}</p></div>'
    share = f'<div class="share"{_O}><p>Share this story</p></div>'
    quoted = f"<blockquote{_C}><p>{s[4]}</p></blockquote><ul{_C}><li>{s[5]}</li><li>{s[1]}</li></ul><table{_C}><tr><td>{s[0]}</td></tr></table><pre{_C}>{s[3]}</pre>"
    pages = []
    for wrap, close in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="story-body" class="post">', "</div>"), ("<main><article>", "</article></main>"), ("<section>", "</section>"), ("<div>", "</div>")):
        head = f"<h1{_C}>{s[1]}</h1>"
        pages += [
            f"<body>{chrome}{wrap}{head}{body}{close}{foot}</body>",
            f"<body>{notice}{chrome}{advert}{wrap}{head}{body}{advert}{body}{form}{close}{side}{foot}</body>",
            f"<body>{chrome}{wrap}{head}{body}{quoted}{share}{body}{side}{close}<section id='comments'{_O}><h2>Comments</h2>{comments}</section>{foot}</body>",
            f"<body>{wrap}{head}{paragraphs[3]}<h2{_C}>{s[5]}</h2>{body}<div class='comments'{_O}>{comments}</div>{close}{form}{foot}{notice}</body>",
            f"<body>{chrome}{advert}{wrap}<h1{_C}>{s[3]}</h1><p{_C}>Two words &amp;&amp;</p>{close}{foot}</body>",
            f"<body>{chrome}{advert}{wrap}{head}{body}<p{_C}>Later today</p><p{_C}>More will follow soon ***</p><p{_C}>{s[3]}</p>{close}{foot}</body>",
            f"<body>{chrome}{wrap}<header{_C}><h1{_C}>{s[3]}</h1></header>{body}<footer{_O}><p>{s[1]}</p></footer>{close}{foot}</body>",
        ]
    return pages


PAGES = labelled_pages()
BOILERPLATE_TAGS, ARTICLE_TAGS = frozenset(("nav", "aside", "form")), frozenset(("article", "main"))
EDGE_TAGS = frozenset(("header", "footer"))  # of a page, or of an article, where they may be content


def sure_label(block: Block) -> int | None:
    """0 for an article's block, 1 for another, None where the tags alone don't tell."""
    if block.part:
        return int(block.part == "o")
    if block.tags & BOILERPLATE_TAGS:
        return 1
    if block.tags & EDGE_TAGS:
        return None if block.tags & ARTICLE_TAGS else 1
    if block.tags & ARTICLE_TAGS:
        return None if block.names - {"good"} else 0
    return 1 if block.names - {"good"} else None


def fit(pages: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "page_id", html_col: str = "html") -> LinearChain:
    """Trains on PAGES and on at most max_rows pages all of whose blocks are sure; only features and labels come to the driver."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(0).to_pylist():
                blocks = leaf_blocks(page or "")
                labels = [sure_label(b) for b in blocks]
                if blocks and None not in labels:
                    rows.append({"rows": features(blocks).astype("<f4").tobytes(), "labels": bytes(labels)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("rows", pa.binary()), ("labels", pa.binary())]))

    chosen = pages.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    one = pages.join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min(F.col(html_col).cast("string")).alias("_html"))  # of several pages of an id the least
    found = one.select("_html").mapInArrow(sample, "rows binary, labels binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["rows"], r["labels"]))
    own = [leaf_blocks(page) for page in PAGES]
    sequences = [features(blocks) for blocks in own]
    width = sequences[0].shape[1]
    labels = [np.array([sure_label(b) for b in blocks]) for blocks in own]
    sequences += [np.frombuffer(r["rows"], "<f4").reshape(-1, width) for r in found]
    labels += [np.frombuffer(r["labels"], np.uint8) for r in found]
    runs = [(s[at : at + RUN].astype(float), l[at : at + RUN], REPEATS if k < len(own) else 1) for k, (s, l) in enumerate(zip(sequences, labels, strict=True)) for at in range(0, len(s), RUN)]
    sequences, labels, times = map(list, zip(*runs, strict=True))
    return train(sequences, labels, rounds=200, decay=3e-4, times=times)


def main_text(model: LinearChain, page: str) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, label in zip(blocks, viterbi(model, features(blocks)), strict=True) if label == 0)


def _extract(model: LinearChain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(model, page or "") for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, model: LinearChain, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(_extract(model), RESULT)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract_main_text(pages, fit(pages))

"""Main text of web pages by two-pass block rules.

The page is read once into blocks: runs of inline text between block tags, with
the path of enclosing elements.  Pass one labels a block by what it holds:

* link density above ``MAX_LINKS``: out;
* long and rich in stop words: in; short: ambiguous; the rest by length.  A page
  with hardly any stop word is in a language the list does not know, and length
  alone decides there;
* inside a menu, page header or footer, sidebar, dialog, script or style element,
  or hidden: out.

Names in class, id and role that speak of such a part (the last telling word of a
name counts, as in ``post-comments`` but not ``comments-open``) put a block out
too, as a prior: if nearly all long, link-poor text of the page stands inside such
an element, and the element holds the article, the main heading or a name for
content, the name is overruled.

Pass two gives each ambiguous block the label of its nearest decided neighbours.
It looks within the same section (``article``, ``main`` or the rest of the page)
first, so a one-word paragraph at the end of an article is not drawn out by the
footer after it.  Neighbours that disagree are settled by the nearer one, ties by
the one before; a heading goes with what follows it.  If a page has an ``article``
or ``main``, blocks beside it are out; inside it a short block is out only between
blocks of links.

Runs over Arrow batches, a page at a time, with no limit on its length.  Defined
results: null or empty html, or a page without main text, gives ''; broken and
unclosed markup is read as browsers do for the usual cases (a block tag ends an
open paragraph, a closing tag ends what is open inside it); a tag with a quote that
does not close before its value ends is cut at its first ``>``; repeated rows give
equal rows; input columns named like a result are replaced by it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags by the part they play.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe object svg math canvas textarea title noembed noframes xmp".split())
OUT_TAGS = frozenset(
    "nav footer aside dialog menu head button select fieldset label input search audio video".split()
)
INLINE_SPACE_TAGS = frozenset("br wbr img td th".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK_TAGS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
#: Words in class, id and role that name parts outside the article.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adsense adslot banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo "
    "promotion respond reply replies search share sharing sidebar skip social sponsor subscribe subscription tags toolbar "
    "topbar widget widgets complementary contentinfo alert alertdialog outbrain taboola teaser login signup signin "
    "feedback disclaimer".split()
)
#: Words that put a part out whatever it is called.
OUT_MARKS = frozenset("related sponsored promoted recommended trending similar".split())
#: Last words of a name that say nothing: the word before them counts.
PLAIN_WORDS = frozenset(
    "area author bar block body bottom box button buttons center column content container count date entry form group icon "
    "icons inner item items left line link links list meta node outer panel primary right row secondary section slot text "
    "thread title top unit wrap wrapper".split()
)
#: Names of readers' parts: an article inside is a reader's too.
READER_WORDS = frozenset("comment comments commentlist disqus reply replies respond feedback".split())
#: Words that say that a name is about the layout of the page.
LAYOUT_WORDS = frozenset("has with no without is not show hide".split())
#: Names that inside an article mark parts of it.
ARTICLE_PARTS = frozenset("header masthead".split())
#: Names of the part that holds the article.
CONTENT_WORDS = frozenset("article body content entry main page post story".split())
#: Common words of the four languages of the corpora.
STOP_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux avec dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu "
    "al como con del el es esta la las los no para por que se su una y".split()
)

LONG_CHARS, SHORT_CHARS = 140, 60
MIN_STOPS, MAX_LINKS = 0.08, 0.4
#: Below this share of stop words in its longer blocks, a page's language is not one of the list's.
FOREIGN = 0.02
#: A name is overruled if its element has more than so many times the text that stands free.
BESIDE = 4
IN, OUT, AMBIGUOUS = 1, -1, 0

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|"
    r"<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"(?=[\s/>]|$)|'[^']*+'(?=[\s/>]|$))*+)(?:>|$)|(?P<open>[^>]*+)(?:>|$))",
    re.DOTALL,
)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Scripts that say with one letter what others say with about three.
DENSE = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    links: int  # characters inside links
    tag: str
    hard: bool  # hidden, or inside a tag that never is of the article
    names: frozenset[int]  # numbers of the enclosing elements that are named for other parts
    section: int  # number of the enclosing article or main, 0 for none


class Part:
    """An element named for a part outside the article, and what speaks against that."""

    def __init__(self, reader: bool, content: bool):
        self.reader, self.content = reader, content


def _name_words(name: str) -> list[str]:
    """A class or id cut into lower-case words at hyphens, digits and capitals."""
    return [w.lower() for w in PARTS.findall(name)]


def _telling(words: list[str]) -> str:
    """The last word that says something."""
    return next((w for w in reversed(words) if w not in PLAIN_WORDS), "")


def _read_names(attrs: str, inside: bool) -> tuple[bool, bool, bool, bool]:
    """(hidden, names another part, a readers' part, also named for content) by an element's attributes."""
    out = reader = content = False
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, out, reader, content
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True, out, reader, content
        if name not in ("class", "id", "role", "aria-label", "data-role"):
            continue
        names = WORDS.findall(value.replace("_", "-"))
        if name == "aria-label" and len(names) > 2:
            continue  # a sentence, not a name
        for one in names:
            words = _name_words(one)
            if not LAYOUT_WORDS.isdisjoint(words[:-1]):
                continue
            told = {_telling(words), one.lower()}
            if inside:
                told -= ARTICLE_PARTS
            reader |= not READER_WORDS.isdisjoint(told)
            out |= not OUT_WORDS.isdisjoint(told) or not OUT_MARKS.isdisjoint(words)
            content |= len(words) == 1 and words[0] in CONTENT_WORDS
    return False, out, reader, content


def read_blocks(page: str) -> tuple[list[Block], list[Part]]:
    """Blocks of text in page order, and the elements that names put out."""
    blocks: list[Block] = []
    parts: list[Part] = []
    # an open element: tag, hard, names, section, link
    stack: list[tuple[str, bool, frozenset[int], int, bool]] = []
    text: list[str] = []
    links = sections = 0
    nowhere = ("", False, frozenset(), 0, False)
    where = ("", False, frozenset(), 0)

    def flush() -> None:
        nonlocal links
        if text:
            body = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if body:
                blocks.append(Block(body, links, *where))
            text.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links, where
        if not text:
            if raw.isspace():
                return
            _, hard, names, section, _ = stack[-1] if stack else nowhere
            tag = next((t for t, *_ in reversed(stack) if t in BLOCK_TAGS), "")
            where = (tag, hard, names, section)
        text.append(raw)
        if stack and stack[-1][4]:
            links += len(raw.strip())

    def close(to: int) -> None:
        if any(t in BLOCK_TAGS for t, *_ in stack[to:]):
            flush()
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        m = TOKEN.match(page, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = max(m.end(), lt + 1)
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("close"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in CONTENT_TAGS and tag not in ("body", "html", "article", "main"):
                    break  # a stray closing tag does not end the article
            continue
        if tag in INLINE_SPACE_TAGS and text:
            text.append(" ")
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            continue
        attrs = m.group("attrs") or m.group("open") or ""
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        if tag in BLOCK_TAGS:
            flush()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                ends = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, (tag,))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
        if attrs.rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        _, hard, names, section, link = stack[-1] if stack else nowhere
        hidden, named, reader, content = _read_names(attrs, section > 0)
        hard |= hidden
        if tag in CONTENT_TAGS and not hard:
            # an article counts even in a wrapper that is named for what stands beside it
            names = frozenset(i for i in names if parts[i].reader)
            if not section:
                sections += 1
                section = sections
            named = reader or named and section < sections
        elif tag in OUT_TAGS or tag == "header" and not section:
            hard = True
        elif tag == "form":
            named = True
        if named and tag not in ("html", "body") and not hard:
            names |= {len(parts)}
            parts.append(Part(reader, content))
        if tag in CONTENT_TAGS or tag == "h1":
            for i in names:
                # readers' comments may be articles of their own
                parts[i].content |= tag != "article" or not parts[i].reader
        stack.append((tag, hard, names, section, link or tag == "a"))
    flush()
    return blocks, parts


def _density(blocks: list[Block]) -> list[int]:
    """Pass one by what the blocks hold: IN, OUT or AMBIGUOUS."""
    sizes, stops, words = [], [], []
    for b in blocks:
        sizes.append(len(b.text) + 2 * len(DENSE.findall(b.text)))
        w = b.text.lower().split()
        words.append(len(w))
        stops.append(sum(x.strip(".,;:!?\"'()") in STOP_WORDS for x in w))
    long = [i for i, n in enumerate(sizes) if n >= SHORT_CHARS and not blocks[i].hard]
    foreign = sum(stops[i] for i in long) < FOREIGN * sum(words[i] for i in long)
    out = []
    for i, b in enumerate(blocks):
        if b.links > MAX_LINKS * len(b.text):
            out.append(OUT)
        elif b.tag in HEADINGS or sizes[i] < SHORT_CHARS:
            out.append(AMBIGUOUS)
        elif stops[i] >= MIN_STOPS * words[i] or sizes[i] >= LONG_CHARS and (foreign or b.section):
            out.append(IN)
        else:
            out.append(AMBIGUOUS)
    return out


def _overruled(blocks: list[Block], dense: list[int], parts: list[Part]) -> set[int]:
    """Numbers of the named elements that hold the main text all the same."""
    rich = [(b.names, len(b.text)) for b, label in zip(blocks, dense, strict=True) if label == IN and not b.hard]
    free: set[int] = set()
    for i, part in enumerate(parts):  # outer elements come before inner ones
        inside = sum(n for names, n in rich if i in names and names <= free | {i})
        if part.content and inside > BESIDE * sum(n for names, n in rich if names <= free and i not in names):
            free.add(i)
    return free


def label_blocks(blocks: list[Block], parts: list[Part]) -> list[int]:
    """IN or OUT for every block."""
    dense = _density(blocks)
    free = _overruled(blocks, dense, parts)
    away = [b.hard or not b.names <= free for b in blocks]
    has_content = any(b.section and not x for b, x in zip(blocks, away, strict=True))
    first = [OUT if x or has_content and not b.section else label for b, x, label in zip(blocks, away, dense, strict=True)]
    if AMBIGUOUS not in first:
        return first
    out = list(first)
    before = _nearest(blocks, first, away, 1)
    after = _nearest(blocks, first, away, -1)
    for i, b in enumerate(blocks):
        if first[i] != AMBIGUOUS:
            continue
        sides = [x for x in (before[i], after[i]) if x]
        if b.tag in HEADINGS and after[i]:
            sides = [after[i]]
        if b.section:
            out[i] = OUT if before[i] and after[i] and before[i][1] == after[i][1] == OUT else IN
        elif sides:
            out[i] = min(sides, key=lambda x: x[0])[1]
        else:
            out[i] = IN if len(blocks) == 1 else OUT
    return out


def _nearest(blocks: list[Block], labels: list[int], away: list[bool], step: int) -> list[tuple[int, int] | None]:
    """For each block the (distance, label) of the nearest decided one on one side in its section.

    Blocks that an enclosing element puts out say nothing about the text of an
    article around them.
    """
    n = len(blocks)
    found: list[tuple[int, int] | None] = [None] * n
    last: dict[int, tuple[int, int]] = {}
    for i in range(n) if step > 0 else range(n - 1, -1, -1):
        section = blocks[i].section
        if labels[i] == AMBIGUOUS:
            if section in last:
                found[i] = (abs(i - last[section][0]), last[section][1])
        elif not (section and away[i]):
            last[section] = (i, labels[i])
    return found


def main_text(page: str | None) -> str:
    """Main blocks in page order, joined by an empty line."""
    if not page:
        return ""
    blocks, parts = read_blocks(page)
    return "\n\n".join(b.text for b, label in zip(blocks, label_blocks(blocks, parts), strict=True) if label == IN)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Input columns without the html, plus ``text`` and ``n_chars``."""
    carried = [c for c in pages.columns if c.lower() not in ("text", "n_chars") and c != html_col]
    chosen = pages.select(*carried, pages[html_col].alias("__he_html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(x.as_py()) for x in part.column(part.num_columns - 1)]
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], "text", "n_chars"])

    return chosen.mapInArrow(run, schema)

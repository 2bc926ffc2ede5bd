"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  Elements that never hold an article (menus,
footers, scripts, and containers that a class, id or role names as nothing else) give no blocks.
Pass one decides by stop-word density, length and link density which blocks are text and which
are boilerplate, and leaves short ones open.  Pass two gives an open block the label of its
nearest decided neighbours.  Marks of structure are evidence within these rules: where most of
the text stands inside ``article`` or ``main``, what is outside is boilerplate and sparse blocks
inside are open; forms are boilerplate unless they hold most of the page; on a page in a language
without known stop words only length and link density decide.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words of the languages the pages come in.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i if in into is it its me my no not of on
    or our she so that the their them there they this to was we were what when which who will with would you your
    aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für haben
    hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle elles en est et être il ils je la le les leur mais ne nous on ont ou
    par pas plus pour qu que qui sa sans se ses son sont sur un une vous
    al como con de del desde donde el ella ellos en era es esta este fue ha hay la las lo los más me mi muy no nos o para
    pero por que se ser si sin sobre son su sus también un una y ya""".split()
)

#: Elements whose content is never article text.
DROPPED = frozenset("head script style noscript template nav footer aside button select option textarea iframe object svg canvas audio video menu dialog datalist map math title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class or id, or a role, that mark what surrounds an article.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription
    signup login sidebar widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager
    footer header masthead topbar toolbar copyright legal disclaimer social share sharing related recommended
    recommendations comment comments reply replies disqus respond search skip toc""".split()
)
#: Words that may stand beside a mark without making it something else: "comment-list" is one, "related-work" is none.
PLAIN = frozenset("area bar block body bottom box btn button buttons col column container content cta feed floating footer global group head holder inline inner item items left link links list main middle mobile outer page panel post right row section site slot small sticky strip text title top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\u0e00-\u0eff]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    words: int
    stops: int
    linked: int
    heading: bool
    inside: bool  # of an article or main element
    form: bool  # inside a form


def _size(text: str) -> int:
    """Words; where a script has no blanks, two characters count as one."""
    return len(text.split()) + len(_CJK.findall(text)) // 2


def _marked(value: str) -> bool:
    """Whether one of the names in a class or id is made of marks, and of words that add nothing."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in PLAIN or len(w) == 1 for w in words):
            return True
    return False


def _dropped(name: str, attrs: str, inside: bool) -> bool:
    if name in DROPPED or name == "header" and not inside:
        return True
    if not attrs or name in ("html", "body", "article", "main", "form") or name in HEADINGS:
        return False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id") and _marked(value):
            return True
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
    return bool(re.search(r"\shidden(?=[\s/=]|$)", _QUOTED.sub(" ", attrs)))


def blocks(page: str) -> list[Block]:
    """Blocks in page order.  Character references are decoded and white space made single spaces."""
    out: list[Block] = []
    parts: list[tuple[bool, str]] = []
    heading, article, links, form = False, 0, 0, 0
    level = linked_at = 0  # blocks open now, and when the link was opened
    skip, depth, since = "", 0, 0  # element that is being dropped, how deep it is nested in itself, and where it began
    never_closed: set[str] = set()
    raw_end: re.Pattern | None = None

    def flush() -> None:
        if parts:
            words = html.unescape("".join(t for _, t in parts)).split()
            if words:
                linked = sum(_size(html.unescape(t)) for a, t in parts if a)
                stops = sum(w.strip(".,;:!?\"'()[]*#$%&|<>«»„“”…-").lower() in STOP_WORDS for w in words)
                text = " ".join(words)
                out.append(Block(text, _size(text), stops, linked, heading, article > 0, form > 0))
            parts.clear()

    at = 0
    while at < len(page):
        if raw_end is not None:
            m = raw_end.search(page, at)
            if not m:
                break
            at, raw_end = m.start(), None
        m = _TOKEN.match(page, at)
        if not m:  # cannot be matched as a tag: the character is text
            if not skip:
                parts.append((links > 0, page[at]))
            at += 1
            continue
        at = m.end()
        if (text := m["text"]) is not None:
            if not skip:
                parts.append((links > 0, text))
            continue
        if not m["name"]:
            continue
        name, closing = m["name"].lower(), bool(m["close"])
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if m["attrs"].endswith("/") else 1
                if not depth:
                    skip = ""
            elif closing and name in ("body", "html"):
                never_closed.add(skip)  # so it says nothing: read on from its beginning
                at, skip, depth = since, "", 0
                continue
            elif not closing and name in ("article", "main") and skip not in ("nav", "aside"):
                skip, depth = "", 0  # it was never closed
            else:
                if not closing and name in RAW:
                    raw_end = re.compile(rf"</{re.escape(name)}", re.I)
                continue
            if skip or closing:
                continue
        if not closing and name not in VOID and name not in never_closed and _dropped(name, m["attrs"], article > 0):
            if name not in INLINE:
                flush()
            if not m["attrs"].endswith("/"):
                skip, depth, since = name, 1, at
                if name in RAW:
                    raw_end = re.compile(rf"</{re.escape(name)}", re.I)
            continue
        if name == "br":
            parts.append((False, " "))
        if name == "a":
            links, linked_at = 0 if closing else 1, level
        if name in INLINE:
            continue
        flush()
        if name not in VOID:
            level = max(0, level + (-1 if closing else 1))
            if level < linked_at:
                links = 0  # the block in which the link was opened is over
        heading = name in HEADINGS and not closing
        if name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
        if name == "form":
            form = max(0, form + (-1 if closing else 1))
    flush()
    return out


def decide(found: list[Block], stop_low: float = 0.05, stop_high: float = 0.12, short: int = 10, link_high: float = 0.5) -> list[bool]:
    """Pass one and two; True is article text."""
    whole = sum(b.words for b in found)
    in_form = 2 * sum(b.words for b in found if b.form) > whole
    usable = [b for b in found if (in_form or not b.form) and b.linked <= link_high * b.words]
    # Most text in the marked article: the mark is to be believed.
    marked = 2 * sum(b.words for b in usable if b.inside) >= sum(b.words for b in usable) and any(b.inside for b in usable)
    known = sum(b.stops for b in usable) >= stop_low * sum(b.words for b in usable)

    def first(b: Block) -> bool | None:
        if marked and not b.inside or b.form and not in_form or b.linked > link_high * b.words:
            return False
        if b.words < short:
            return None
        if not known or b.stops >= stop_high * b.words:
            return True
        return False if b.stops < stop_low * b.words and not b.inside else None

    labels = [first(b) for b in found]
    near = [k for k, x in enumerate(labels) if x is not None and (not marked or found[k].inside) and (in_form or not found[k].form)]
    out, j = [], 0
    for k, x in enumerate(labels):
        if x is not None:
            out.append(x)
            continue
        while j < len(near) and near[j] < k:
            j += 1
        before, after = near[j - 1] if j else None, near[j] if j < len(near) else None
        if before is None and after is None:
            out.append(found[k].inside or found[k].heading or not marked and (found[k].stops > 0 or not known))
        elif before is None or after is None:
            out.append(bool(labels[after if before is None else before]))
        elif labels[before] == labels[after]:
            out.append(bool(labels[before]))
        elif found[k].heading or after - k < k - before:
            out.append(bool(labels[after]))
        else:
            out.append(bool(labels[before]) if k - before < after - k else True)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, kept in zip(found, decide(found), strict=True) if kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` for every row.

    A null, empty or text-free page gives the empty text.  Pages cut off anywhere are read as far
    as they go.  Repeated rows stay; empty input gives no rows; other columns are ignored.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, f"{kinds}, text string, n_chars bigint")

"""Problem 8: keyword-stuffed and link-list pages.

Every line of a page is reduced to a shape: classes of how many words and
separated parts it has, how it is capitalised, which sign separates its parts
and how many links it holds, and whether it is sentences, data (code, logs,
configuration), or neither. The lines of a page are grouped by shape. Of the
shapes that are neither sentences nor data those count whose words come again
and again, as no table of contents or list of names does, or that are links,
tags or goods. A page is flagged if few of these shapes hold the greater part
of it.

No word list decides: the same shapes arise in any language. One pass over
each text, no shuffle, whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of a page's characters in non-sentence shapes from which it is flagged.
SHARE = 0.5
#: A page must have this many listed parts or words of stuffed text in all.
PARTS = 12
#: Of a shape's words, so many may be new on the page unless it is links, tags or goods.
DISTINCT = 0.6
#: k shapes are few if they have at least this times k * k items: each comes about as often as there are shapes.
SPREAD = 1.0

_LINK = re.compile(r"(?:https?://|www\.)[^\s)\]>\"',|]+", re.I)
#: A host without scheme; its last part is in one case, as that of a qualified name seldom is.
_HOST = re.compile(r"(?<![\w./@:-])[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*(?:\.[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)*\.(?:[a-z]{2,10}|[A-Z]{2,10})(?:/[^\s)\]>\"',|]*)?(?![\w:(/.])")
_ANCHOR = re.compile(r"!?\[([^\[\]\n]*)\]\((?:https?://|www\.)?[^()\s]*\)|<a\s[^<>]*>([^<]*)</a>", re.I)
_LEAD = re.compile(r"^(?:\s|[*\-+>»•·/–—]|#+\s|\(?\d{1,4}[.)]\s)+")
# HTML elements that carry text; other element names are data.
_HTML = re.compile(r"</?(?:title|h[1-6]|p|div|span|li|ul|ol|b|i|u|em|strong|font|center|small|td|tr|th|table|br|hr|a|nav|footer|header|body|head|html|noscript|marquee|label|img|meta)\b[^<>]*>", re.I)
_META = re.compile(r"<meta\b[^<>]*?content\s*=\s*[\"']([^\"'<>]*)[\"']?[^<>]*>", re.I)
_CODE = re.compile(r"[{}=<>\\`]|;\s*$|\w\(|\)\.|::|->|\"\s*:|:\d+:|^\s*@\w+|\[[\w-]+\]\s*$|\d:\d\d|^\s*[\w.-]+:\s?\S+$|^\s*-\s*[\w-]+:")
#: A word that people don't write: with signs inside it, or brackets around it.
_MARKED = re.compile(r"^[^#]*[\w$)][.:/\\@=$][\w$]|^[\[({<]|^\d{4,}\w|^\d{5,}$|^\S+:$")
_STOP = re.compile(r"[.!?:](?=[\s\"')\]]|$)|[。！？।॥؟۔։።]|[.!?][\"')]")
_SEPARATOR = re.compile(r"\s*(?:[,;|•·~★☆✅✓✔»›¦、，；｜／]+|!{2,}|\.{3,}|…|\s[/*+–—-]\s|​|\t| {2,})\s*")
_WORD = re.compile(r"\w+(?:['’]\w+)?")
#: Kinds that are no sentences and no data: those whose items are written words, and those that are lists by their make.
_WORDED, _LISTED = {"list", "stuff", "short", "goods"}, {"links", "tags", "goods"}
_SPAM = _WORDED | _LISTED
#: Signs around a word that aren't part of it.
_EDGES = ".,;:!?()[]\"'“”‘’。！？、，।॥"
_TAGGED = re.compile(r"(?:^|\s)#\w")
_MONEY = re.compile(r"[$€£¥₹]\s?\d|\d\s?[$€£¥₹]|\b(?:USD|EUR|GBP|JPY|CHF)\s?\d|[-−]\d{1,2}\s?%|★{2,}|\b(?:SKU|EAN|ASIN|ISBN)\W{0,2}\d", re.I)


def _wordlike(part: str) -> int:
    """Words of a phrase; scripts without spaces count two characters a word."""
    n = 0
    for word in part.split():
        wide = sum(1 for c in word if "぀" <= c <= "鿿" or "가" <= c <= "힯") if not word.isascii() else 0
        n += max(1, (wide + 1) // 2)
    return n


def _caps(text: str) -> str:
    return "U" if text.isupper() else "l" if text.islower() else "C"


def _bucket(n: int) -> int:
    return n if n < 4 else n.bit_length() + 1


def _stuffed(words: list[str], n: int) -> bool:
    """Whether a run of ``n`` words is one or two phrases said over and over.

    ``n`` may exceed the spaced words where a script has no spaces.
    """
    if len(words) < 8:
        return False
    count = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    long = max((c for w, c in count.items() if len(w) > 3 or not w.isascii()), default=0)
    again = sum(c for c in pairs.values() if c > 1)
    return long >= 3 and (long >= 0.17 * n or again >= 0.34 * n)


def _marked(line: str) -> bool:
    """Whether more than a fourth of a line's words are names, paths, numbers in brackets and the like, and no hosts or prices."""
    words = line.split()
    marked = sum(1 for w in words if _MARKED.search(w) and not _HOST.fullmatch(w) and not _MONEY.search(w))
    return 4 * marked > len(words)


def line_shape(line: str) -> tuple[str, tuple, list[str]]:
    """(kind, shape, phrases) of a line that isn't blank.

    A shape is made of classes of the numbers of words, parts and links, of
    capitals and of the separating sign. Links without text and further parts
    of product lines are empty phrases.

    Kinds: ``text`` (sentences), ``data`` (code, logs, configuration, tables),
    ``short`` (a lone phrase: a title, or one entry of a list), ``list``
    (several phrases between separators), ``tags``, ``links``, ``goods``
    (product lines with numbers and prices) and ``stuff`` (a run of words
    without sentences, or sentences of one phrase).
    """
    found = _shape(line)
    if found[0] in _WORDED and "://" not in line and _marked(line):
        return "data", ("data",), []
    return found


def _shape(line: str) -> tuple[str, tuple, list[str]]:
    linked = "](" in line or "://" in line or "www." in line or "WWW." in line
    if "<" in line and _HTML.search(line):
        body = _META.sub(r" \1 ", line)
        linked = linked or "<a" in body
        body = _HTML.sub(" ", body) if not linked else body
    elif not linked and _CODE.search(line):
        return "data", ("data",), []
    else:
        body = _LEAD.sub("", line)
    body = body.strip()
    if not body:
        return "data", ("data",), []
    if "#" in body and _TAGGED.search(body):
        tokens = body.split()
        tags = [t for t in tokens if t[0] == "#" and len(t) > 1]
        if len(tags) >= 0.6 * len(tokens):
            return "tags", ("tags", _bucket(len(tags))), [t.lower() for t in tags]
    rest, anchors, links = body, [], 0
    if linked:
        anchors = [a or b for a, b in _ANCHOR.findall(body)]
        rest, links = _ANCHOR.subn(" ", body)
        rest = _HTML.sub(" ", rest)
        rest, more = _LINK.subn(" ", rest)
        links += more
    elif "." in rest:
        rest, links = _HOST.subn(" ", rest)
    if not links and not _WORD.search(rest):
        return "data", ("data",), []
    if links:
        outside = _wordlike(" ".join(_WORD.findall(rest)))
        if outside <= 5 * links:
            said = [a.lower() for a in anchors] or [" ".join(rest.split()).lower()]
            return "links", ("links", _bucket(links), min(outside // links, 5)), said + [""] * (links - len(said))
        if outside < 8 or _CODE.search(rest):
            return "data", ("data",), []
    if _MONEY.search(rest) and ("|" in rest or len(_MONEY.findall(rest)) >= 2):
        parts = [p for p in re.split(r"\s*[|,;•·]\s*|\s{2,}|\t", rest) if p]
        if len(parts) >= 2 and all(_wordlike(p) <= 8 for p in parts):
            return "goods", ("goods", len(parts), _caps(parts[0])), [parts[0].lower()] + [""] * (len(parts) - 1)
    parts = [p for p in _SEPARATOR.split(rest) if p and not p.isspace()]
    sizes = [_wordlike(p) for p in parts]
    total = sum(sizes)
    if len(parts) >= 4 and total <= 4.5 * len(parts) and max(sizes) <= 9:
        stops = len(_STOP.findall(rest)) if "!!" not in rest and "..." not in rest else 0
        if stops <= 0.15 * len(parts):
            sign = Counter(_SEPARATOR.findall(rest)).most_common(1)
            return "list", ("list", sign[0][0].strip() if sign else "", _bucket(total // len(parts)), _caps(rest)), [p.lower().strip(" .!") for p in parts]
    if total <= 7 and not _STOP.search(rest):
        return ("short", ("short", total, _caps(rest)), [rest.lower().strip()])
    plain = [w for x in rest.lower().split() if (w := x.strip(_EDGES))]
    stops = len(_STOP.findall(rest))
    if total > 20 and total > 60 * max(stops, 0.34):
        return "stuff", ("stuff", "run", _caps(rest)), [" ".join(p) for p in zip(plain, plain[1:])]
    if _stuffed(plain, max(total, len(plain))):
        return "stuff", ("stuff", "said", _bucket(total)), [" ".join(p) for p in zip(plain, plain[1:])]
    return "text", ("text",), []


_BREAK = re.compile(r"\r\n|[\n\r  \x0b\x0c\x85]")
_PAINT = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_SENTENCE = re.compile(r"(?<=[.!?。！？।॥؟۔։።])\s+")


def _units(text: str) -> Iterator[str]:
    """Lines without terminal colours, with long ones of sentences cut into these."""
    if "\x1b" in text:
        text = _PAINT.sub("", text)
    for line in _BREAK.split(text):
        if len(line) > 200 and len(cut := _SENTENCE.split(line)) > 1 and "!!" not in line and "..." not in line:
            yield from cut
        elif line and not line.isspace():
            yield line


@dataclass
class Group:
    """The lines of one shape on a page."""

    kind: str
    chars: int = 0
    items: int = 0
    words: Counter = field(default_factory=Counter)


def shape_groups(text: str | None, share: float = 0.0) -> dict[tuple, Group]:
    """The page's lines grouped by shape; empty for no text.

    Empty too once sentences and data hold so much of the page that no more
    than ``share`` is left for the others: then the rest needn't be looked at.
    """
    units = [(line, n) for line in _units(text or "") if (n := len(line.strip()))]
    left = (1 - share) * sum(n for _, n in units)
    groups: dict[tuple, Group] = {}
    for line, n in units:
        kind, shape, said = line_shape(line)
        group = groups.get(shape)
        if group is None:
            group = groups[shape] = Group(kind)
        group.chars += n
        if kind in _SPAM:
            group.items += len(said)
            for phrase in said:
                group.words.update(phrase.split())
        else:
            left -= n
            if left <= 0 < share:
                return {}
    return groups


def is_spam(text: str | None, share: float = SHARE, parts: int = PARTS, distinct: float = DISTINCT, spread: float = SPREAD) -> bool:
    """Whether few shapes without sentences or data hold more than ``share`` of a page.

    Only shapes count that are links, tags or goods, or whose words come again
    on the page: each occurrence of a word counts as its share of all of them,
    and these must not add up to more than ``distinct`` of the shape's words.
    The largest k of these shapes that hold the share are few if they have
    ``spread`` * k * k items. All of them together must have ``parts`` items.
    """
    groups = shape_groups(text, share)
    share *= sum(g.chars for g in groups.values())
    said = [g for g in groups.values() if g.kind in _SPAM]
    if sum(g.chars for g in said) <= share:
        return False
    page: Counter = Counter()
    for g in said:
        page.update(g.words)
    empty = [g for g in said if g.kind in _LISTED or sum(n / page[w] for w, n in g.words.items()) <= distinct * sum(g.words.values())]
    if sum(g.items for g in empty) < parts:
        return False
    held = items = 0
    for k, g in enumerate(sorted(empty, key=lambda g: -g.chars), 1):
        held += g.chars
        items += g.items
        if held > share:
            return items >= spread * k * k
    return False


def spam_pages(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE, parts: int = PARTS) -> DataFrame:
    """Keys of the pages that are keyword lists, link lists or product tags.

    Null, empty and blank texts are no cases. Every row is judged alone, so
    equal texts are all cases, repeated keys come out repeated, and an empty
    table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([is_spam(t.as_py(), share, parts) for t in batch.column(1)], pa.bool_()))], names=[key])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}")

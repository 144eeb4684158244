"""Text functions as Columns; only what needs a parser or a Unicode table is Python, over Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow

def words(text: Column) -> Column:
    """Words between blanks in lower case: letters and marks with hyphens and apostrophes, after an opening bracket or
    quote and before punctuation; what is not of that shape is no word."""
    parts = F.split(F.lower(text), r"[\s\p{Z}]+")
    return F.filter(F.transform(parts, lambda w: F.regexp_extract(w, r"^[\p{Ps}\p{Pi}\"]?([\p{L}\p{M}'’-]+)[\p{P}]*$", 1)), lambda w: w != "")


def trigrams(word: Column) -> Column:
    """Three-letter windows of the word between spaces; hyphens and apostrophes count as spaces."""
    padded = F.concat(F.lit(" "), F.translate(word, "-'’", "   "), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), lambda p: F.trim(p)), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Words up to and with one that ends in ``. ! ?`` or an ellipsis."""
    return F.regexp_extract_all(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(r"\S(?:.*?[.!?…](?= |$)|.*$)"), 0)


def first_words(text: Column, most: int, longest: int = 50) -> Column:
    """Words while they fit, and the one that does not, with an ellipsis if more follow; one of more than ``longest``
    letters is cut. Soft hyphens and marks have no width, but a word counts for half its length at least."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("said"), F.lit(most).alias("left"), F.lit(0).alias("seen"), F.lit(False).alias("full"))
    total = F.size(parts)

    def add(a: Column, w: Column) -> Column:
        width = F.greatest(F.floor(F.length(w) / 2).cast("int") + 1, F.length(F.regexp_replace(w, r"[\u00AD\p{Mn}]", "")))
        fits = width < a["left"]
        cut = F.concat(F.substring(w, F.lit(1), F.greatest(F.lit(longest), a["left"])), F.lit("…"))
        last = F.when(a["seen"] + 1 < total, F.concat(w, F.lit(" …"))).otherwise(w)
        more = F.when(fits, w).when(width > longest, cut).otherwise(last)
        said = F.when(a["full"], a["said"]).when(a["said"] == "", more).otherwise(F.concat(a["said"], F.lit(" "), more))
        left = F.when(a["full"] | ~fits, a["left"]).otherwise(a["left"] - width - 1)
        return F.struct(said.alias("said"), left.alias("left"), (a["seen"] + 1).alias("seen"), (a["full"] | ~fits).alias("full"))

    return F.aggregate(parts, start, add, lambda a: a["said"])


_END = tuple(".!?…")


def _width(word: str) -> int:
    return max(len(word) // 2 + 1, sum(1 for c in word if c != "\u00ad" and unicodedata.category(c) != "Mn"))


def opening(text: str | None, most: int, longest: int = 50) -> str:
    """The first paragraph by whole sentences up to ``most`` letters, and the next ones while less than a third is used.

    A sentence that does not fit is cut as in ``first_words``, or is an ellipsis only if little room was left."""
    room, said = most, []
    for paragraph in (p.split() for p in (text or "").split("\n") if p.strip()):
        if said and (room <= 0 or most - room >= most // 3):
            break
        ends = [i + 1 for i, w in enumerate(paragraph) if w.endswith(_END) or i + 1 == len(paragraph)]
        for begin, end in zip([0, *ends], ends, strict=False):
            left, words_ = room, []
            for i in range(begin, end):
                w, n = paragraph[i], _width(paragraph[i])
                if n < left:
                    words_.append(w)
                    left -= n + 1
                    continue
                if room < most // 3:
                    words_ = ["…"]
                elif n > longest:
                    words_.append(w[: max(longest, left)].rstrip("\u00ad") + "…")
                else:
                    words_ += [w, "…"] if i + 1 < len(paragraph) else [w]
                return " ".join([*said, *words_])
            said += words_
            room = left
    return " ".join(said)


def first_paragraph(text: Column, most: int) -> Column:
    @arrow("string")
    def cut(c: pa.Array) -> pa.Array:
        return pa.array([None if x is None else opening(x, most) for x in c.to_pylist()], pa.string())

    return cut(text)


def short_text(text: Column, view: Column) -> Column:
    """How much a view shows of a text."""
    return F.when(view == "compact", first_words(text, 375)).when(view == "magazine", first_words(text, 300)).when(view == "mosaic", first_words(text, 100)).otherwise(first_words(text, 66))


def subject_repeats(subject: Column, text: Column) -> Column:
    """Whether the text begins with the subject, an ellipsis at the end aside."""
    bare = F.regexp_replace(F.trim(F.lower(subject)), r"(\.\.\.|…)$", "")
    return (F.length(bare) > 0) & F.lower(F.trim(text)).startswith(bare)


def short_number(n: Column) -> Column:
    """Below 950 as it is, else in thousands with one place: 1.2K, 3K."""
    return F.when(n < 950, n.cast("string")).otherwise(F.replace(F.concat(F.format_string("%.1f", n / 1000.0), F.lit("K")), F.lit(".0K"), F.lit("K")))


def duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def file_size(size: Column) -> Column:
    k, m, g = 1024, 1024 * 1024, 1024 * 1024 * 1024
    whole = lambda x: F.bround(x).cast("long").cast("string")
    place = lambda x: F.format_string("%.1f", x)
    return (
        F.when(size > g, F.concat(place(size / g), F.lit("GB"))).when(size > 10 * m, F.concat(whole(size / m), F.lit("MB"))).when(size > m, F.concat(place(size / m), F.lit("MB")))
        .when(size > k, F.concat(whole(size / k), F.lit("kB"))).when(size == 1, "1 byte").otherwise(F.concat(size.cast("string"), F.lit(" bytes")))
    )


def integer(text: Column, signed: bool = False) -> Column:
    """A whole number among blanks, or null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d+$" if signed else r"^\d+$"), t.try_cast("long"))


def lucene_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def hashtags(text: Column, base: str) -> Column:
    return F.regexp_replace(text, r"(^|\s)#([\p{L}\p{N}_]+)", rf'$1<a href="{base}$2">#$2</a>')


def usernames(text: Column, base: str) -> Column:
    return F.regexp_replace(text, r"(^|\s)@([A-Za-z0-9_]+)", rf'$1<a href="{base}$2">@$2</a>')


def tag(text: Column, synonyms: dict[str, str] | None = None) -> Column:
    """A folder's name as a tag: lower case, leading numbers and punctuation dropped, synonyms mapped; null if nothing is left."""
    t = F.trim(F.regexp_replace(F.lower(text), r"^[\p{N}\p{P}\p{S}\s]+", ""))
    t = F.regexp_replace(t, r"\s+", " ")
    if synonyms:
        t = F.coalesce(F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])[t], t)
    return F.nullif(t, F.lit(""))


def _begins(parts: Column, prefix: str) -> Column:
    return F.exists(parts, lambda p: p.startswith(prefix))


def blacklisted(title: Column, stop: list[list[str]]) -> Column:
    """Whether for one of the lists every word begins some word of the title."""
    parts = words(title)
    out = F.lit(False)
    for ws in stop:
        each = F.lit(True)
        for w in ws:
            each = each & _begins(parts, w)
        out = out | each
    return out


#: Substrings of lower-cased user agents in order; the first that fits names the browser.
BROWSERS = (
    ("ipad", "iPad"), ("ipod", "iPod"), ("iphone", "iPhone"), ("opera mini", "OperaMini"), ("opera", "Opera"), ("edge", "Edge"), ("iemobile", "IEMobile"), ("msie", "IE"), ("trident", "IE"),
    ("firefox", "Firefox"), ("conkeror", "Firefox"), ("iceweasel", "Firefox"), ("seamonkey", "Firefox"), ("vivaldi", "Vivaldi"), ("chrome", "Chrome"), ("safari", "Safari"), ("android", "Android"),
)
#: The same for the system.
SYSTEMS = (
    ("ios", "iOS"), ("ipad", "iOS"), ("iphone", "iOS"), ("ipod", "iOS"), ("cfnetwork", "iOS"), ("darwin/", "iOS"), ("mac", "Mac"), ("windows", "Windows"), ("android", "Android"), ("dalvik", "Android"),
    ("cros", "ChromeOS"), ("linux", "Linux"), ("x11", "Linux"),
)
#: Substrings of client name and user agent in order, the app that the first fitting one names, and the
#: system that the app implies (None: the user agent's).
APPS = (
    ("feeddler", "Feeddler", "iOS"),
    ("reeder", "Reeder", None),
    ("feedme", "FeedMe", "Android"),
    ("fiery", "FieryFeeds", "iOS"),
    ("netnewswire", "NetNewsWire", "Unknown"),
    ("mr. reader", "MrReader", "iOS"),
    ("unread", "Unread", "iOS"),
    ("lire", "Lire", "iOS"),
    ("focusreader", "FocusReader", "Android"),
    ("justreader", "JustReader", "Android"),
    ("newsplus", "NewsPlus", "Android"),
    ("vienna", "Vienna", "Mac"),
    ("readkit", "ReadKit", None),
    ("slowfeeds", "SlowFeeds", "iOS"),
    ("slow feeds", "SlowFeeds", "iOS"),
    ("slow%20feeds", "SlowFeeds", "iOS"),
    ("web subscriber", "WebSubscriber", "iOS"),
    ("newsjet", "NewsJet", "Android"),
    ("amber", "Amber", "Android"),
    ("readably", "Readably", "Android"),
    ("fluent-reader", "FluentReader", None),
    ("ravenreader", "RavenReader", None),
    ("okhttp", "okhttp", "Unknown"),
    ("gzip", "gzip", "Unknown"),
)


def browser(agent: Column) -> Column:
    return first_fit(F.lower(agent), BROWSERS)


def system(agent: Column) -> Column:
    a = F.lower(agent)
    return F.when(F.contains(a, F.lit("darwin/")) & F.contains(a, F.lit("x86_64")), "Mac").otherwise(first_fit(a, SYSTEMS))


def app(client: Column, agent: Column) -> Column:
    """struct(app, system): the system that the app implies, else the user agent's."""
    said, of = F.lower(F.concat_ws(" ", client, agent)), system(agent)
    row = lambda name, os: F.struct(F.lit(name).alias("app"), os.alias("system"))
    return F.coalesce(*(F.when(F.contains(said, F.lit(k)), row(name, of if os is None else F.lit(os))) for k, name, os in APPS), row("Unknown", of))


def first_fit(text: Column, table: tuple[tuple[str, str], ...], other: str = "Unknown") -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), v) for k, v in table), F.lit(other))


_BREAKS = re.compile(r"(?i)<(?:br|/?(?:p|div|li|ul|ol|h[1-6]|tr|table|blockquote|section|article|header|footer|pre|hr))\b[^>]*>")
_DROPPED = re.compile(r"(?is)<(script|style|head|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_TAGS = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
_ATTR = re.compile(r"""(?is)<(a|img|iframe|video|source|embed)\b[^>]*?\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def plain(source: str | None) -> str:
    """Text of a piece of HTML, block elements on lines of their own."""
    t = _TAGS.sub("", _BREAKS.sub("\n", _DROPPED.sub(" ", source or "")))
    lines = (" ".join(x.split()) for x in html.unescape(t).split("\n"))
    return "\n".join(x for x in lines if x)


@arrow("string")
def html_text(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else plain(x) for x in c.to_pylist()], pa.string())


@arrow("links array<string>, images array<string>, videos array<string>, text string")
def html_parts(c: pa.Array) -> pa.Array:
    """Links, images, videos and text of HTML."""
    rows = []
    for x in c.to_pylist():
        links, images, videos = [], [], []
        for name, _, *value in _ATTR.findall(_DROPPED.sub(" ", x or "")):
            {"a": links, "img": images}.get(name.lower(), videos).append(html.unescape("".join(value)))
        rows.append({"links": links, "images": images, "videos": videos, "text": plain(x)})
    kind = pa.struct([("links", pa.list_(pa.string())), ("images", pa.list_(pa.string())), ("videos", pa.list_(pa.string())), ("text", pa.string())])
    return pa.array(rows, kind)


_EVENTS = re.compile(r"""(?is)\s+on[a-z]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""")
_SCRIPTS = re.compile(r"""(?is)\b(href|src)\s*=\s*(["']?)\s*javascript:[^"'>\s]*\2""")
_TINY = re.compile(r"""(?is)<img\b(?=[^>]*\bwidth\s*=\s*["']?[01]\b)[^>]*>|<img\b(?=[^>]*\bheight\s*=\s*["']?[01]\b)[^>]*>""")


def sanitised(source: str | None) -> str:
    """HTML without scripts, styles, head, event attributes, script links and one-pixel images."""
    return _TINY.sub("", _SCRIPTS.sub(r"\1=\2#\2", _EVENTS.sub("", _DROPPED.sub("", source or "")))).strip()


@arrow("string")
def sanitise(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else sanitised(x) for x in c.to_pylist()], pa.string())


@arrow("string")
def nfc(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in c.to_pylist()], pa.string())


@arrow("string")
def sha3_512(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else hashlib.sha3_512(x.encode()).hexdigest() for x in c.to_pylist()], pa.string())


def hmac_sha256(text: Column, key: str) -> Column:
    @arrow("string")
    def sign(c: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hmac.new(key.encode(), x.encode(), "sha256").hexdigest() for x in c.to_pylist()], pa.string())

    return sign(text)


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _base58(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


@arrow("string")
def base58(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _base58(bytes(x)) for x in c.to_pylist()], pa.string())


_LINK = re.compile(r"""(?i)\b((?:https?://|www\.)[^\s<>"']*[^\s<>"'.,;:!?)\]]|[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}|(?:[a-z0-9-]+\.)+(?:com|net|org|info|io|dev|eu|de|fr|es|ru|uk)\b(?:/[^\s<>"']*[^\s<>"'.,;:!?)\]])?)""")


def linkified(text: str | None) -> str:
    """Addresses, mail addresses and bare domains made links; text is escaped."""
    out, at, text = [], 0, text or ""
    for m in _LINK.finditer(text):
        link = m[0]
        to = link if "://" in link else f"mailto:{link}" if "@" in link else f"http://{link}"
        out += [html.escape(text[at : m.start()]), f'<a href="{html.escape(to)}">{html.escape(link)}</a>']
        at = m.end()
    return "".join(out) + html.escape(text[at:])


@arrow("string")
def linkify(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else linkified(x) for x in c.to_pylist()], pa.string())


def css(style: Column) -> Column:
    """A style attribute as a map of lower-cased names to values."""
    pairs = F.filter(F.split(style, ";"), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["k"] == n), -1)["v"]))


def srcset(text: Column) -> Column:
    """A srcset as array of struct(url, descriptor)."""
    parts = F.filter(F.transform(F.split(text, r",\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.split(p, r"\s+")[0].alias("url"), F.coalesce(F.get(F.split(p, r"\s+"), F.lit(1)), F.lit("1x")).alias("descriptor")))

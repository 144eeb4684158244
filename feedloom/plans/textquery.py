"""Saved-query text compiled to a Column.

Words are lower-cased runs of letters, digits and underscores. Terms are joined by AND unless OR or ``||`` stands
between them (AND binds tighter); ``NOT``, ``!`` and ``-`` negate; parentheses group; quotes make a phrase; a trailing
``*`` is a prefix, and ``*`` and ``?`` inside a word are wildcards; a leading wildcard is an error after cleaning has
dropped those that stand at a word's start. ``field:term`` looks in another field, ``tag:`` means ``tags:``; ``link:``
ignores scheme and www. ``[a TO b]`` and ``{a TO b}`` are ranges. Morphology is not applied.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W]+", re.UNICODE)
TOKEN = re.compile(r'\s*(?:(?P<quote>"(?:\\.|[^"\\])*")|(?P<range>[\[{][^\]}]*\sTO\s[^\]}]*[\]}])|(?P<op>\(|\)|&&|\|\||!|[-+](?=\S))|(?P<word>(?:\\.|[^\s()"\[\]{}])+))')
RELATIVE_TIME = re.compile(r"time:\s*[\[{][^\]}]*now[^\]}]*[\]}]", re.I)


class QuerySyntaxError(ValueError):
    pass


#: Quotation marks of many scripts, all of which quote.
QUOTES = "“”„«»‹›〈〉《》「」『』【】〔〕〖〗〘〙〚〛〝〞〟"
#: Characters after which a new word begins.
RESERVED = "+-=&|><!(){}[]^\"~:\\/"
_UNITS = re.compile(r"\\.|[*?]|.", re.S)


def clean(query: str) -> str:
    """Quotes straightened, slashes escaped, soft hyphens dropped, ``tag:`` and ``link:`` made uniform. A wildcard that
    stands alone matches all; one at a word's start is dropped; repeated stars inside are one."""
    q = re.sub(r"link:(?:https?(?:\\)?://)?(?:www\.)?", "link:", query.replace("tag:", "tags:")).replace("\u00ad", "")
    q = re.sub(r"(\\.)|/", lambda m: m[1] or "\\/", re.sub(f"[{QUOTES}]", '"', q))
    out: list[str] = []
    inside, units = False, _UNITS.findall(q)
    for n, u in enumerate(units):
        if u in "*?":
            following = units[n + 1] if n + 1 < len(units) else " "
            if inside:
                out += [] if u == "*" and out[-1] == "*" else [u]
            elif following in RESERVED or following.isspace():
                out.append("* ")
        else:
            inside = len(u) == 2 or not (u in RESERVED or u.isspace())
            out.append(u)
    return re.sub(r"\s+", " ", "".join(out)).strip()


def is_time_based(query: str) -> bool:
    """Whether the matches of ``query`` change as time goes by."""
    return bool(RELATIVE_TIME.search(query))


@dataclass(frozen=True)
class Fields:
    """Columns to search: word arrays, exact values, flags and times, by field name."""

    default: Column
    words: dict[str, Column]
    exact: dict[str, Column]
    flags: dict[str, Column]
    ordered: dict[str, Column]


def _tokens(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = TOKEN.match(query, at)
        if not m or m.end() == at:
            raise QuerySyntaxError(f"cannot read {query[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _like(word: str) -> str:
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in word) + "$"


def _term(words: Column, text: str) -> Column:
    if text.strip("*?") == "" and text:
        return F.lit(True)
    if text[0] in "*?":
        raise QuerySyntaxError("a word cannot begin with a wildcard")
    if "*" in text or "?" in text:
        pattern = _like(text.lower())
        return F.exists(words, lambda w: w.rlike(pattern))
    parts = WORD.findall(text.lower())
    if not parts:
        return F.lit(True)
    return F.array_contains(words, parts[0]) if len(parts) == 1 else _phrase(words, parts)


def _phrase(words: Column, parts: list[str]) -> Column:
    if not parts:
        return F.lit(True)
    starts = F.sequence(F.lit(1), F.size(words) - len(parts) + 1)
    found = F.exists(starts, lambda i: F.slice(words, i, len(parts)) == F.array(*map(F.lit, parts)))
    return F.when(F.size(words) >= len(parts), found).otherwise(F.lit(False))


class _Parser:
    def __init__(self, query: str, fields: Fields) -> None:
        self.tokens, self.at, self.fields = _tokens(query), 0, fields

    def peek(self) -> tuple[str, str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str]:
        if self.peek() is None:
            raise QuerySyntaxError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def any_of(self, inside: str | None = None) -> Column:
        parts = [self.all_of(inside)]
        while (t := self.peek()) and t in (("word", "OR"), ("op", "||")):
            self.take()
            parts.append(self.all_of(inside))
        return reduce(lambda a, b: a | b, parts)

    def all_of(self, inside: str | None) -> Column:
        parts = [self.one(inside)]
        while (t := self.peek()) and t not in (("word", "OR"), ("op", "||"), ("op", ")")):
            if t in (("word", "AND"), ("op", "&&")):
                self.take()
            parts.append(self.one(inside))
        return reduce(lambda a, b: a & b, parts)

    def one(self, inside: str | None) -> Column:
        kind, text = self.take()
        if (kind, text) in (("word", "NOT"), ("op", "!"), ("op", "-")):
            return ~self.one(inside)
        if (kind, text) == ("op", "+"):
            return self.one(inside)
        if (kind, text) == ("op", "("):
            found = self.any_of(inside)
            if self.peek() != ("op", ")"):
                raise QuerySyntaxError("a parenthesis is not closed")
            self.take()
            return found
        if kind == "op" or text in ("AND", "OR"):
            raise QuerySyntaxError(f"{text} is out of place")
        if kind == "word" and (m := re.match(r"([A-Za-z_]+):(.*)$", text, re.S)) and not text.endswith("\\:"):
            if inside:
                raise QuerySyntaxError("a field inside a field")
            name = {"tag": "tags"}.get(m[1].lower(), m[1].lower())
            if m[2]:
                self.tokens.insert(self.at, ("word", m[2]))
            return self.one(name)
        if kind == "range":
            return self.between(inside, text)
        text = re.sub(r"\\(.)", r"\1", text)
        return self.match(inside, text[1:-1] if kind == "quote" else text, kind == "quote")

    def match(self, name: str | None, text: str, quoted: bool) -> Column:
        f = self.fields
        if name in f.flags:
            return f.flags[name] == F.lit(text.lower() == "true")
        if name in f.exact:
            return f.exact[name].rlike(_like(text)) if "*" in text or "?" in text else f.exact[name] == text
        if name and name not in f.words:
            raise QuerySyntaxError(f"no field {name}")
        words = f.words[name] if name else f.default
        return _phrase(words, WORD.findall(text.lower())) if quoted else _term(words, text)

    def between(self, name: str | None, text: str) -> Column:
        if name not in self.fields.ordered:
            raise QuerySyntaxError("a range needs a field with an order")
        col = self.fields.ordered[name]
        low, high = (x.strip() for x in text[1:-1].split(" TO "))
        out = F.lit(True)
        if low != "*":
            out = out & (col >= F.lit(low).cast("timestamp") if text[0] == "[" else col > F.lit(low).cast("timestamp"))
        if high != "*":
            out = out & (col <= F.lit(high).cast("timestamp") if text[-1] == "]" else col < F.lit(high).cast("timestamp"))
        return out


def compiled(query: str, fields: Fields) -> Column:
    """The predicate of ``query``; an empty one matches all."""
    q = clean(query)
    if not q:
        return F.lit(True)
    p = _Parser(q, fields)
    found = p.any_of()
    if p.peek():
        raise QuerySyntaxError(f"{p.peek()[1]} is out of place")
    return F.coalesce(found, F.lit(False))


def check(query: str) -> str | None:
    """What is wrong with ``query``, if anything."""
    names = ("subject", "author", "text", "tags", "lang")
    try:
        compiled(query, Fields(F.col("words"), dict.fromkeys(names, F.col("words")), {"link": F.col("link")}, {k: F.col(k) for k in ("comment", "img", "gif", "audio", "video", "attachment")}, {"time": F.col("time")}))
    except QuerySyntaxError as e:
        return str(e)
    return None

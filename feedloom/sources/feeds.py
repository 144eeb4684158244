"""Feed formats as sources: RSS, RDF, Atom, OPML, JSON subscriptions, zipped exports and HTML pages.

Markup found in the wild is often broken, so documents are parsed in Python over Arrow batches, one row for each
document; what follows is plain columns.
"""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Callable
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow

ITEM = "struct<guid:string,link:string,subject:string,author:string,published:timestamp,updated:timestamp,summary:string,body:string,tags:array<string>,enclosures:array<struct<url:string,mime:string,size:bigint>>,comments_feed:string>"
FEED = f"kind string, title string, link string, subtitle string, hub string, items array<{ITEM}>, error string"
_KIND = pa.struct(
    [
        ("kind", pa.string()), ("title", pa.string()), ("link", pa.string()), ("subtitle", pa.string()), ("hub", pa.string()),
        ("items", pa.list_(pa.struct([(k, pa.string()) for k in ("guid", "link", "subject", "author")] + [(k, pa.timestamp("us", "UTC")) for k in ("published", "updated")] + [("summary", pa.string()), ("body", pa.string()), ("tags", pa.list_(pa.string())), ("enclosures", pa.list_(pa.struct([("url", pa.string()), ("mime", pa.string()), ("size", pa.int64())]))), ("comments_feed", pa.string())]))),
        ("error", pa.string()),
    ]
)


def sniffed(text: str) -> str:
    """rss, rdf, atom, opml, json, html or empty, by what a document begins with."""
    head = re.sub(r"(?s)^﻿?\s*(<\?xml.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*", "", text[:20_000], flags=re.I)
    if head[:1] in "{[" and head:
        return "json"
    m = re.match(r"<(?:\w+:)?(\w+)", head)
    name = m[1].lower() if m else ""
    return {"rss": "rss", "rdf": "rdf", "feed": "atom", "opml": "opml", "html": "html", "head": "html", "body": "html"}.get(name, "html" if re.search(r"(?i)<(html|body|head|p|div)\b", text[:5000]) else "")


def _local(tag: object) -> str:
    return str(tag).rpartition("}")[2].lower()


def _time(text: str | None) -> datetime | None:
    if not text or not text.strip():
        return None
    text = text.strip()
    for parse in (parsedate_to_datetime, lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))):
        try:
            t = parse(text)
            return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
        except (ValueError, TypeError, IndexError):
            continue
    return None


def _inner(e: ElementTree.Element) -> str:
    """Text, or markup where the content is XHTML."""
    if len(e):
        return (e.text or "") + "".join(ElementTree.tostring(x, "unicode") for x in e)
    return e.text or ""


def _number(text: str | None) -> int | None:
    return int(text) if text and text.strip().isdigit() else None


def _item(e: ElementTree.Element, base: str) -> dict:
    out: dict = dict.fromkeys(("guid", "link", "subject", "author", "published", "updated", "summary", "body", "comments_feed"))
    out |= {"tags": [], "enclosures": []}
    for c in e:
        name, text = _local(c.tag), (c.text or "").strip()
        if name in ("guid", "id"):
            out["guid"] = text
        elif name == "link":
            rel, href = c.get("rel", "alternate"), c.get("href")
            if href and rel == "enclosure":
                out["enclosures"].append({"url": urljoin(base, href), "mime": c.get("type"), "size": _number(c.get("length"))})
            elif href and rel == "replies":
                out["comments_feed"] = urljoin(base, href)
            elif rel == "alternate" and not out["link"]:
                out["link"] = urljoin(base, href or text) or None
        elif name == "title" and out["subject"] is None:
            out["subject"] = " ".join(html.unescape(_inner(c)).split())
        elif name in ("author", "creator"):
            own = next((x.text for x in c if _local(x.tag) == "name"), None)
            out["author"] = (own or text) or out["author"]
        elif name in ("pubdate", "published", "date", "issued", "created"):
            out["published"] = _time(text) or out["published"]
        elif name in ("updated", "modified"):
            out["updated"] = _time(text) or out["updated"]
        elif name in ("description", "summary", "subtitle"):
            out["summary"] = out["summary"] or _inner(c)
        elif name in ("encoded", "content") and not c.get("url"):
            out["body"] = _inner(c) or out["body"]
        elif name in ("category", "subject"):
            out["tags"] += [t for t in [(c.get("term") or text).strip()] if t]
        elif name == "enclosure" or (name == "content" and c.get("url")):
            out["enclosures"].append({"url": urljoin(base, c.get("url", "")), "mime": c.get("type"), "size": _number(c.get("length") or c.get("fileSize"))})
        elif name in ("commentrss", "commentsrss"):
            out["comments_feed"] = text or None
        elif name == "group":
            out["enclosures"] += _item(c, base)["enclosures"]
    out["body"] = out["body"] or out["summary"]
    seen: dict = {}
    for x in out["enclosures"]:  # one of each address, in the first's place
        seen.setdefault(x["url"], x)
    out["enclosures"] = list(seen.values())
    out["tags"] = list(dict.fromkeys(out["tags"]))
    return out


def feed(text: str | None, base: str | None) -> dict:
    """An RSS, RDF or Atom document."""
    out: dict = {"kind": sniffed(text or ""), "title": None, "link": None, "subtitle": None, "hub": None, "items": [], "error": None}
    if out["kind"] not in ("rss", "rdf", "atom"):
        return out
    try:
        root = ElementTree.fromstring((text or "").strip().lstrip("﻿"))
    except ElementTree.ParseError as e:
        return out | {"error": f"not well formed: {e}"}
    base = base or ""
    top = root if out["kind"] == "atom" else next((c for c in root if _local(c.tag) == "channel"), root)
    for c in top:
        name = _local(c.tag)
        if name == "title" and out["title"] is None:
            out["title"] = " ".join(html.unescape(_inner(c)).split())
        elif name in ("description", "subtitle", "tagline") and out["subtitle"] is None:
            out["subtitle"] = _inner(c).strip()
        elif name == "link":
            if c.get("rel") == "hub":
                out["hub"] = c.get("href")
            elif c.get("rel", "alternate") == "alternate" and out["link"] is None:
                out["link"] = urljoin(base, c.get("href") or (c.text or "").strip()) or None
    out["items"] = [_item(e, base) for e in root.iter() if _local(e.tag) in ("item", "entry")]
    return out


@arrow(FEED)
def parse_feed(text: pa.Array, base: pa.Array) -> pa.Array:
    return pa.array([feed(t, b) for t, b in zip(text.to_pylist(), base.to_pylist(), strict=True)], _KIND)


def parsed(docs: DataFrame, text: str = "body", base: str = "feed") -> DataFrame:
    """Documents with what their feed says: kind, title, link, subtitle, hub, items, error."""
    return docs.withColumn("_f", parse_feed(text, base)).select(*[c for c in docs.columns if c != text], "_f.*")


_SUBS = pa.list_(pa.struct([("url", pa.string()), ("title", pa.string()), ("folders", pa.list_(pa.string()))]))


def subscriptions(text: str | None) -> list[dict]:
    """An OPML document's feeds, folders of a repeated url united."""
    try:
        root = ElementTree.fromstring((text or "").strip().lstrip("﻿"))
    except ElementTree.ParseError:
        return []
    found: dict[str, dict] = {}

    def walk(e: ElementTree.Element, folders: list[str]) -> None:
        for c in e:
            if _local(c.tag) != "outline":
                walk(c, folders)
                continue
            url = c.get("xmlUrl") or c.get("xmlurl")
            title = c.get("title") or c.get("text") or ""
            if url:
                own = found.setdefault(url, {"url": url, "title": title, "folders": []})
                own["folders"] += [f for f in folders[-1:] if f not in own["folders"]]
            else:
                walk(c, [*folders, title])

    walk(root, [])
    return list(found.values())


@arrow("array<struct<url:string,title:string,folders:array<string>>>")
def parse_opml(text: pa.Array) -> pa.Array:
    return pa.array([subscriptions(t) for t in text.to_pylist()], _SUBS)


def opml(docs: DataFrame, text: str = "body") -> DataFrame:
    return docs.select(*[c for c in docs.columns if c != text], F.inline(parse_opml(text)))


def takeout(data: bytes | None, most: int = 10 << 20) -> str | None:
    """The subscriptions file of a zipped export."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            found = next((i for i in z.infolist() if i.filename.endswith("subscriptions.xml") and i.file_size < most), None)
            return z.read(found).decode("utf-8", "replace") if found else None
    except zipfile.BadZipFile:
        return None


@arrow("string")
def parse_takeout(data: pa.Array) -> pa.Array:
    return pa.array([takeout(x) for x in data.to_pylist()], pa.string())


def reader_subscriptions(text: Column) -> Column:
    """The subscription list of a reader API: array of struct(url, title, folders)."""
    schema = "struct<subscriptions:array<struct<id:string,title:string,categories:array<struct<label:string>>>>>"
    subs = F.filter(F.from_json(text, schema)["subscriptions"], lambda s: s["id"].startswith("feed/"))
    return F.transform(subs, lambda s: F.struct(F.substring(s["id"], F.lit(6), F.length(s["id"])).alias("url"), s["title"].alias("title"), F.coalesce(s["categories"]["label"], F.array().cast("array<string>")).alias("folders")))


_LINKS = re.compile(r"(?is)<(link|meta|title|base|img|a)\b([^>]*)>(?:([^<]*)</title)?")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/rdf+xml", "application/json+feed", "application/feed+json")


def page_info(source: str | None, url: str | None) -> dict:
    """What a page's head declares: feeds, title, description, image, icon, canonical address."""
    out: dict = {"kind": sniffed(source or ""), "feeds": [], "title": None, "description": None, "image": None, "icon": None, "canonical": None}
    base = url or ""
    icons: list[tuple[bool, str]] = []
    for m in _LINKS.finditer(re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", source or "")):
        a = {k.lower(): html.unescape("".join(v)) for k, *v in _ATTR.findall(m[2])}
        name, rel = m[1].lower(), a.get("rel", "").lower().split()
        if name == "base" and a.get("href"):
            base = urljoin(base, a["href"])
        elif name == "title" and out["title"] is None:
            out["title"] = " ".join(html.unescape(m[3] or "").split())
        elif name == "link" and a.get("href"):
            to = urljoin(base, a["href"])
            if "alternate" in rel and a.get("type", "").lower() in _FEED_TYPES:
                out["feeds"].append({"url": to, "title": a.get("title")})
            elif "icon" in rel:
                icons.append(("32x32" in a.get("sizes", "").lower().split(), to))
            elif "canonical" in rel:
                out["canonical"] = to
            elif "image_src" in rel:
                out["image"] = out["image"] or to
        elif name == "meta":
            key, value = (a.get("property") or a.get("name") or "").lower(), a.get("content", "")
            if key in ("og:title", "twitter:title") and value:
                out["title"] = value
            elif key in ("og:description", "twitter:description", "description") and value:
                out["description"] = value if key.startswith("og:") or out["description"] is None else out["description"]
            elif key in ("og:image", "twitter:image", "og:image:url") and value:
                out["image"] = urljoin(base, value)
    fit = [u for good, u in icons if good] or [u for _, u in icons]
    out["icon"] = (fit[0] if any(g for g, _ in icons) else fit[-1]) if fit else urljoin(base, "/favicon.ico") if base else None
    return out


_PAGE = pa.struct([("kind", pa.string()), ("feeds", pa.list_(pa.struct([("url", pa.string()), ("title", pa.string())]))), *((k, pa.string()) for k in ("title", "description", "image", "icon", "canonical"))])


@arrow("kind string, feeds array<struct<url:string,title:string>>, title string, description string, image string, icon string, canonical string")
def parse_page(source: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([page_info(s, u) for s, u in zip(source.to_pylist(), url.to_pylist(), strict=True)], _PAGE)


def discovered(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_p", parse_page("html", "url")).select("page_id", "url", "_p.*")


def text_of(data: bytes | None, declared: str | None = None) -> str | None:
    """Bytes as text: by mark, declaration, what the document says itself, else UTF-8, else Latin."""
    if data is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    said = re.search(rb"""(?i)(?:encoding|charset)\s*=\s*["']?\s*([\w.:-]+)""", data[:2048])
    for name in (declared, said and said[1].decode("ascii", "replace"), "utf-8", "cp1252"):
        if name:
            try:
                return data.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
    return data.decode("latin-1")


@arrow("string")
def decoded(data: pa.Array) -> pa.Array:
    return pa.array([text_of(x) for x in data.to_pylist()], pa.string())


#: Source plug-ins: (test of the url, rewriting of the url, parser of the body).
PLUGINS: list[tuple[Callable[[str], bool], Callable[[str], str], Callable[[str, str], dict]]] = []


def plugin(test: Callable[[str], bool], rewrite: Callable[[str], str] = lambda u: u) -> Callable:
    def register(f: Callable[[str, str], dict]) -> Callable[[str, str], dict]:
        PLUGINS.append((test, rewrite, f))
        return f

    return register


def route(url: str) -> tuple[str, Callable[[str, str], dict]]:
    """The address to fetch and the parser of the first plug-in that takes ``url``, else the feed parser."""
    for test, rewrite, f in PLUGINS:
        if test(url):
            return rewrite(url), f
    return url, feed


def _posts(kind: str, rows: list[dict], title: str | None = None) -> dict:
    blank = {"guid": None, "link": None, "subject": None, "author": None, "published": None, "updated": None, "summary": None, "body": None, "tags": [], "enclosures": [], "comments_feed": None}
    return {"kind": kind, "title": title, "link": None, "subtitle": None, "hub": None, "items": [blank | r for r in rows], "error": None}


def _json(text: str) -> dict:
    try:
        x = json.loads(text)
    except ValueError:
        return {}
    return x if isinstance(x, dict) else {"items": x}


@plugin(lambda u: u.endswith((".json", "/feed.json")) or "format=json" in u)
def json_feed(text: str, base: str) -> dict:
    """The JSON feed format."""
    x = _json(text)
    rows = [
        {"guid": str(i.get("id", "")), "link": i.get("url"), "subject": i.get("title"), "author": (i.get("author") or {}).get("name"), "published": _time(i.get("date_published")), "updated": _time(i.get("date_modified")), "summary": i.get("summary"), "body": i.get("content_html") or i.get("content_text"), "tags": i.get("tags") or []}
        for i in x.get("items", [])
        if isinstance(i, dict)
    ]
    return _posts("json", rows, x.get("title"))


@plugin(lambda u: bool(re.match(r"https?://(?:\w+\.)?reddit\.com/r/\w+", u)), lambda u: re.sub(r"/?(?:\.json|\.rss)?(?:\?.*)?$", "/.json", u, count=1))
def listing(text: str, base: str) -> dict:
    """A listing of links with comments."""
    rows = [
        {"guid": d.get("name"), "link": urljoin(base, d.get("url") or ""), "subject": d.get("title"), "author": d.get("author"), "published": datetime.fromtimestamp(d["created_utc"], UTC) if d.get("created_utc") else None, "body": html.unescape(d.get("selftext_html") or ""), "comments_feed": urljoin(base, d.get("permalink") or "")}
        for d in (c.get("data", {}) for c in (_json(text).get("data") or {}).get("children", []))
    ]
    return _posts("json", rows)


def clicked(url: Column) -> Column:
    """Which plug-in's kind a url would go to, for routing in a plan: json, listing or feed."""
    return F.when(url.rlike(r"\.json$|format=json"), "json").when(url.rlike(r"^https?://(\w+\.)?reddit\.com/r/\w+"), "listing").otherwise("feed")

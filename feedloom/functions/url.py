"""URL functions as Columns."""

from __future__ import annotations

import re
from urllib.parse import unquote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_cid", "utm_reader", "PHPSESSID", "SID", "ASPSESSIONID", "ncid")
#: Public suffixes of two labels under which names are registered.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "com.tr", "co.in", "com.ua")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Host name in lower case without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_and_query(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(p == "", "/").when(p.startswith("?"), F.concat(F.lit("/"), p)).otherwise(p)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def registered_domain(name: Column) -> Column:
    """The host's last two labels, three under a public suffix of two."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(two)


def is_top_level(url: Column) -> Column:
    return path_and_query(url).isin("/", "/index.html", "/index.php")


def in_domain(name: Column, domain: str) -> Column:
    """The domain itself or a name below it."""
    return (name == domain) | name.endswith("." + domain)


def parameters(url: Column) -> Column:
    """Query parameters in order, decoded: array of struct(name, value)."""
    parts = F.filter(F.split(query(url), "[&;]"), lambda p: p != "")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    return F.transform(parts, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("name"), decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value")))


def without_tracking(url: Column) -> Column:
    """Drops a query all of whose parameters only track; one that has others stays whole, as its form may matter."""
    parts = F.filter(F.split(query(url), "[&;]"), lambda p: p != "")
    only = (F.size(parts) > 0) & F.forall(parts, lambda p: F.substring_index(p, "=", 1).isin(*TRACKING))
    return F.when(only, F.concat(F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, r"(#.*)$", 1))).otherwise(url)


def with_parameter(url: Column, name: str, value: str) -> Column:
    """Adds or replaces one parameter."""
    parts = F.filter(F.split(query(url), "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != name))
    rest = F.array_join(F.array_append(parts, F.concat(F.lit(name + "="), encoded(F.lit(value)))), "&")
    return F.concat(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("?"), rest, F.regexp_extract(url, r"(#.*)$", 1))


def to_https(url: Column) -> Column:
    return F.regexp_replace(url, r"^http://", "https://")


def bare(url: Column) -> Column:
    """Without scheme and www."""
    return F.regexp_replace(F.regexp_replace(url, r"^(?i)https?://", ""), r"^(?i)www\.", "")


def masked_password(url: Column) -> Column:
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]*:)[^/?#@]*@", "$1***@")


def encoded(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def variants(url: Column) -> Column:
    """The same address with either scheme, with and without www."""
    rest = bare(url)
    return F.array(*(F.concat(F.lit(s + w), rest) for s in ("http://", "https://") for w in ("", "www.")))


def root_page(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def unwrapped(url: Column) -> Column:
    """The target of a click redirect (parameter url, u, q or to that is itself an address), else the url."""
    to = F.regexp_extract(url, r"[?&](?:url|u|q|to)=(https?(?:%3A|:)[^&#]*)", 1)
    return F.when(to != "", F.coalesce(F.try_url_decode(to), url)).otherwise(url)


def without_session(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"(?i);jsessionid=[^?#]*", ""), r"(?i)([?&])(?:phpsessid|sid|sessionid)=[^&#]*&?", "$1")


def video_id(url: Column) -> Column:
    """struct(site, id) of the known video sites."""
    tube = F.regexp_extract(url, r"(?:youtube(?:-nocookie)?\.com/(?:watch\?(?:[^#]*&)?v=|embed/|v/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    vimeo = F.regexp_extract(url, r"vimeo\.com/(?:video/)?(\d+)", 1)
    photo = F.regexp_extract(url, r"instagram\.com/p/([A-Za-z0-9_-]+)", 1)
    pick = lambda s, c: F.when(c != "", F.struct(F.lit(s).alias("site"), c.alias("id")))
    return F.coalesce(pick("youtube", tube), pick("vimeo", vimeo), pick("instagram", photo))


def meta_refresh(source: Column) -> Column:
    """The target of an immediate refresh in HTML."""
    tag = F.regexp_extract(source, r"(?is)<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh)[^>]*content\s*=\s*[\"']?\s*0\s*;\s*url\s*=\s*'?([^\"'>\s]+)", 1)
    return F.nullif(tag, F.lit(""))


def data_uri(url: Column) -> Column:
    """struct(mime, data) of a data: address."""
    m = r"(?s)^data:([^;,]*)(?:;charset=[^;,]*)?(;base64)?,(.*)$"
    body = F.regexp_extract(url, m, 3)
    data = F.when(F.regexp_extract(url, m, 2) != "", F.try_to_binary(body, F.lit("base64"))).otherwise(F.try_url_decode(body).cast("binary"))
    return F.when(url.startswith("data:"), F.struct(F.coalesce(F.nullif(F.regexp_extract(url, m, 1), F.lit("")), F.lit("text/plain")).alias("mime"), data.alias("data")))


_PORTS = {"http": 80, "https": 443}


def normalised(url: str | None) -> str | None:
    """Scheme http if none, default port and empty tracking query dropped, host in lower-case ASCII, path percent-encoded."""
    if url is None:
        return None
    url = re.sub(r"^feed:(?://)?(?=https?:)", "", url.strip())
    url = re.sub(r"^feed:", "http:", url)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", url):
        url = "http://" + url.lstrip("/")
    try:
        s = urlsplit(url)
        name = (s.hostname or "").encode("idna").decode() if s.hostname else ""
        port = "" if s.port is None or s.port == _PORTS.get(s.scheme) else f":{s.port}"
    except (UnicodeError, ValueError):
        return url
    user = s.netloc.rpartition("@")[0]
    keep = "".join(chr(c) for c in range(33, 127))
    quote_ = lambda t: "".join(c if c in keep else "".join(f"%{b:02X}" for b in c.encode()) for c in t)
    params = [p for p in s.query.split("&") if p]
    if params and all(p.partition("=")[0] in TRACKING for p in params):
        params = []
    return urlunsplit((s.scheme.lower(), (user + "@" if user else "") + name + port, quote_(s.path) or "/", quote_("&".join(params)), ""))


def readable(url: str | None) -> str | None:
    """Percent-encoding and punycode undone for reading."""
    if url is None:
        return None
    s = urlsplit(url)
    try:
        name = s.netloc.encode().decode("idna")
    except UnicodeError:
        name = s.netloc
    return urlunsplit((s.scheme, name, unquote(s.path), unquote(s.query), s.fragment))


@arrow("string")
def normalise(c: pa.Array) -> pa.Array:
    return pa.array([normalised(x) for x in c.to_pylist()], pa.string())


@arrow("string")
def human(c: pa.Array) -> pa.Array:
    return pa.array([readable(x) for x in c.to_pylist()], pa.string())


@arrow("string")
def resolve(base: pa.Array, link: pa.Array) -> pa.Array:
    return pa.array([None if b is None or r is None else urljoin(b, r.strip()) for b, r in zip(base.to_pylist(), link.to_pylist(), strict=True)], pa.string())


def email(c: Column) -> Column:
    """A mail address in lower case without what follows a plus sign; dots before gmail's at are dropped; null if it is none."""
    t = F.lower(F.trim(c))
    name, at = F.regexp_replace(F.substring_index(t, "@", 1), r"\+.*$", ""), F.substring_index(t, "@", -1)
    name = F.when(at.isin("gmail.com", "googlemail.com"), F.replace(name, F.lit("."), F.lit(""))).otherwise(name)
    return F.when(t.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"), F.concat(name, F.lit("@"), at))

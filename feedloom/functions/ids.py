"""Item ids, keys and hashes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(feed: Column, post: Column, comment: Column | None = None) -> Column:
    """feed * 2^32 + post for posts; comments have the top bit, 40, 14 and 14 bits: they are negative."""
    own = F.shiftleft(feed.cast("long"), 32) + post.cast("long")
    if comment is None:
        return own
    low = F.shiftleft(feed.cast("long"), 40) + F.shiftleft(post.cast("long"), 14) + comment.cast("long")
    return F.when(comment.isNull(), own).otherwise(F.shiftleft(F.lit(1).cast("long"), 63).bitwiseOR(low))


def unpack(item: Column) -> Column:
    """struct(feed, post, comment); what is not positive is a comment, 0 too."""
    low = item.bitwiseAND(F.lit((1 << 63) - 1))
    post = F.struct(F.shiftright(item, 32).alias("feed"), item.bitwiseAND(0xFFFFFFFF).alias("post"), F.lit(None).cast("long").alias("comment"))
    comment = F.struct(F.shiftright(low, 40).alias("feed"), F.shiftright(low, 14).bitwiseAND(0x3FFFFFF).alias("post"), low.bitwiseAND(0x3FFF).alias("comment"))
    return F.when(item > 0, post).otherwise(comment)


def external(item: Column) -> Column:
    """Sixteen lower-case hex digits after the usual prefix."""
    return F.concat(F.lit("tag:google.com,2005:reader/item/"), F.lpad(F.lower(F.hex(item)), 16, "0"))


def read_external(text: Column) -> Column:
    """A decimal number, or the hex digits after the last slash; negative ids wrap."""
    tail = F.regexp_extract(text, r"([0-9a-fA-F]+)$", 1)
    hexed = F.when(F.length(tail) == 16, tail)
    high = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(hexed, 9, 8), 16, 10).cast("long")
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("long")).otherwise(F.shiftleft(high, 32).bitwiseOR(low))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    mark = F.lit("\u0000")
    return F.replace(F.replace(F.replace(text, F.lit("\\\\"), mark), F.lit("\\n"), F.lit("\n")), mark, F.lit("\\"))


def message_key(feed: Column, post: Column, comment: Column) -> Column:
    """Parts on lines of their own, each escaped; no third line for posts."""
    return F.concat_ws("\n", *(escaped(c) for c in (feed, post, comment)))


def content_hash(*parts: Column) -> Column:
    """base64 of the SHA-1 of the escaped parts, without padding."""
    joined = F.concat_ws("\n", *(escaped(F.coalesce(p, F.lit(""))) for p in parts))
    return F.rtrim(F.base64(F.unhex(F.sha1(joined))), F.lit("="))


def url_safe(text: Column) -> Column:
    return F.translate(text, "+/", "-_")


def guid(own: Column, link: Column, link_is_unique: Column, author: Column, subject: Column, text: Column, most: int = 1000) -> Column:
    """The item's own guid (hashed if too long), else a link that no other item has, else a hash of what it says."""
    has = F.length(F.coalesce(own, F.lit(""))) > 0
    return F.when(has & (F.length(own) > most), content_hash(own)).when(has, own).when(link_is_unique & (F.length(link) > 0), link).otherwise(content_hash(author, subject, text))

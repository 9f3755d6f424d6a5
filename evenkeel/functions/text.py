"""Identifiers, hashes and short forms of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(title: Column, description: Column) -> Column:
    """MD5 of the lower-cased title and description."""
    return F.md5(F.lower(F.concat(title, F.lit(" "), description)))


def client_fingerprint(session_header: Column, connection_id: Column, ip: Column, agent: Column) -> Column:
    """The first non-empty of two ids (64 characters), else a hash of ip and agent."""

    def clipped(c: Column) -> Column:
        return F.nullif(F.substring(c, 1, 64), F.lit(""))

    seed = F.concat(F.coalesce(ip, F.lit("unknown")), F.lit(":"), F.coalesce(agent, F.lit("")))
    hashed = F.concat(F.lit("fp_"), F.substring(F.sha2(seed, 256), 1, 32))
    return F.coalesce(clipped(session_header), clipped(connection_id), hashed)


def composite_id(client: Column, session: Column) -> Column:
    return F.concat_ws(":", client, session)


def client_of(identifier: Column) -> Column:
    """Client part of ``client:session``; 'unknown' when there is no colon."""
    return F.when(identifier.contains(":"), F.split(identifier, ":", 2)[0]).otherwise("unknown")


def session_of(identifier: Column) -> Column:
    """Everything after the first colon, or the whole text without one."""
    return F.when(identifier.contains(":"), F.split(identifier, ":", 2)[1]).otherwise(identifier)


def shortened(text: Column, width: int) -> Column:
    """The first ``width`` characters, with an ellipsis when that many are there."""
    head = F.substring(text, 1, width)
    return F.when(F.length(head) >= width, F.concat(head, F.lit("..."))).otherwise(head)


def preview(text: Column, width: int) -> Column:
    """The text, or its first ``width`` characters and an ellipsis when longer."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def words_found(text: Column, words) -> Column:
    """Which ``words`` occur as whole words, each once, in one pass over ``text``."""
    pattern = rf"(?U)\b({'|'.join(words)})\b"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def whole_words(text: Column, words) -> Column:
    """How many distinct ``words`` occur as whole words."""
    return F.size(words_found(text, words))


def contained(text: Column, words) -> Column:
    """How many of ``words`` occur anywhere in ``text``."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(text.contains(w), 1).otherwise(0)
    return total


def any_contained(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found

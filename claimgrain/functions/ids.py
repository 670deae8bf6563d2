"""Hashes and identifiers as expressions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrain import dims

# Word characters here are Unicode letters, digits and the underscore.
ID_PATTERN = r"(?U)^[\w\-:.]+\z"


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def query_hash(text: Column) -> Column:
    return F.substring(content_hash(text), 1, dims.QUERY_HASH_CHARS)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    part = lambda start, length: F.substring(digest, start, length)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)),
                       F.concat(variant, part(18, 3)), part(21, 12))


def isoformat(ts: Column) -> Column:
    """ISO-8601 text; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def document_id(url: Column, acquired_at: Column, name: Column,
                discriminator: Column | None = None) -> Column:
    """From the URL if there is one, else from name, time and an optional discriminator.

    Ingestion passes the content hash as discriminator: with a pinned run time, documents
    sharing a name (threads of one export file) would otherwise collide.
    """
    parts = [F.coalesce(name, F.lit("")), isoformat(acquired_at)]
    if discriminator is not None:
        parts.append(discriminator)
    return (F.when(F.coalesce(url, F.lit("")) != "", uuid5(uuid.NAMESPACE_URL, url))
            .otherwise(uuid5(uuid.NAMESPACE_DNS, F.concat_ws("::", *parts))))


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s_%04d", document_id, index)


def hmac_pads(salt: bytes) -> tuple[str, str]:
    """Inner and outer key pads (hex) of HMAC-SHA256, computed once on the driver."""
    key = hashlib.sha256(salt).digest() if len(salt) > 64 else salt
    key = key.ljust(64, b"\0")
    return (bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex())


def ip_pseudonym(ip: Column, salt: bytes) -> Column:
    """First hex digits of HMAC-SHA256(salt, ip); empty for a missing address."""
    inner, outer = (F.unhex(F.lit(p)) for p in hmac_pads(salt))
    digest = F.sha2(F.concat(inner, ip.cast("binary")), 256)
    outer_digest = F.sha2(F.concat(outer, F.unhex(digest)), 256)
    return (F.when(F.coalesce(ip, F.lit("")) == "", "")
            .otherwise(F.substring(outer_digest, 1, dims.IP_HASH_CHARS)))


def valid_id(col: Column) -> Column:
    return F.coalesce(col.rlike(ID_PATTERN), F.lit(False))

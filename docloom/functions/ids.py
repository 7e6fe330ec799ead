"""Identity from content: SHA-256 over parts joined by U+001F, 32 hex digits after a prefix."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_digest(*parts: Column) -> Column:
    # concat_ws would skip nulls, and with them a separator
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256), 1, 32)


def document_id(checksum: Column, source_uri: Column) -> Column:
    return F.concat(F.lit("doc_"), stable_digest(checksum, source_uri))


def element_id(document_id: Column, ordinal: Column, kind: Column, text: Column, page_number: Column, config_fingerprint: Column) -> Column:
    return F.concat(F.lit("elm_"), stable_digest(document_id, ordinal, kind, text, page_number, config_fingerprint))


def chunk_id(document_id: Column, ordinal: Column, config_fingerprint: Column, text: Column) -> Column:
    return F.concat(F.lit("chk_"), stable_digest(document_id, ordinal, config_fingerprint, text))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name, from its SHA-1 without a UDF."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))

"""Content-derived identifiers (name-based UUID, version 5) from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.binding import let

# Fixed value: the object-identifier namespace of RFC 4122, as hex digits.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def content_id(name: Column | str) -> Column:
    """UUIDv5 of ``name`` (UTF-8 bytes) in the object-identifier namespace."""
    name = F.col(name) if isinstance(name, str) else name
    digest = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), F.encode(name, "UTF-8")))

    def layout(h: Column) -> Column:
        # RFC 4122: digit 13 becomes the version, digit 17 keeps its two low bits.
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat_ws(
            "-",
            F.substring(h, 1, 8),
            F.substring(h, 9, 4),
            F.concat(F.lit("5"), F.substring(h, 14, 3)),
            F.concat(variant, F.substring(h, 18, 3)),
            F.substring(h, 21, 12),
        )

    # Never null (a null name has an empty id), and said to be so: joins by id then ask for nothing more, and plans that
    # shuffle the same rows by id can share the shuffle.
    return F.coalesce(let(digest, layout), F.lit(""))


def memory_id(text: Column | str, user_id: Column | str) -> Column:
    """Id of a general memory: UUIDv5 over text followed by user, no separator.

    Without a separator ("ab", "c") and ("a", "bc") share an id, so every
    merge in this package uses the key ``(user_id, memory_id)``.
    """
    text = F.col(text) if isinstance(text, str) else text
    user_id = F.col(user_id) if isinstance(user_id, str) else user_id
    return content_id(F.concat(text, user_id))

"""Text functions on message arrays.

A job carries its messages in one array, so all of these are expressions on
that array: no explode, no shuffle, no Python.  Lengths are UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.binding import let
from memlake.schema import (
    CONTEXT_BYTES,
    FALLBACK_BYTES,
    ROLE_ALIASES,
    ROLE_PREFIX,
)

# Fixed value: the characters with the Unicode property White_Space.
_WHITE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS = r"[\s\x{85}\p{Z}]"

# A sentence is text, its terminators, and one blank or the end.  A match can
# only begin at the text's start, at the end of the previous match or right
# after a terminator; saying so makes a search over text without terminators
# linear instead of quadratic.
_SENTENCE = r"(?:\G|(?<=[.!?]))[^.!?]++[.!?]++(?:[\t\n\f\r ]|\z)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(text: Column | str) -> Column:
    """Strip Unicode white space (not only blanks) from both ends."""
    return F.btrim(_col(text), F.lit(_WHITE))


def trim_user_key(key: Column | str) -> Column:
    """Strip quotes and blanks from both ends of a user key."""
    return F.btrim(_col(key), F.lit("\"' "))


def sentences(text: Column | str) -> Column:
    """Trimmed sentences of a trimmed text; the whole text where none ends."""

    def split(content: Column) -> Column:
        return let(
            F.regexp_extract_all(content, F.lit(_SENTENCE), F.lit(0)),
            lambda found: F.when(content == "", F.array().cast("array<string>"))
            .when(F.size(found) == 0, F.array(content))
            .otherwise(F.transform(found, trim_space)),
        )

    return let(trim_space(text), split)


def context_query_text(messages: Column | str, limit: int = CONTEXT_BYTES) -> Column:
    """Newest whole sentences, in talk order, until their bytes reach ``limit``.

    The sentence that reaches the limit is kept, the newest one always is.
    Separators are not counted.  Every sentence has a byte at least, so only
    the newest ``limit`` non-blank messages can matter: older ones are cut
    off before any sentence is split.
    """
    depth = max(int(limit), 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("bytes"))

    def step(acc: Column, unit: Column) -> Column:
        grown = F.struct(
            (acc["n"] + 1).alias("n"), (acc["bytes"] + F.octet_length(unit["s"])).alias("bytes")
        )
        return F.when((acc["n"] == 0) | (acc["bytes"] < limit), grown).otherwise(acc)

    def newest(spoken: Column) -> Column:
        return F.slice(
            spoken, F.greatest(F.size(spoken) - F.lit(depth) + 1, F.lit(1)), F.lit(depth)
        )

    def split(message: Column) -> Column:
        return F.transform(
            sentences(message["content"]),
            lambda s, i: F.struct(s.alias("s"), (i == 0).alias("opens")),
        )

    def tail(units: Column) -> Column:
        kept = F.aggregate(F.reverse(units), start, step, lambda acc: acc["n"])
        return F.reverse(F.slice(F.reverse(units), F.lit(1), kept))

    pieces = F.transform(
        let(
            F.flatten(
                F.transform(
                    let(
                        F.filter(_col(messages), lambda m: trim_space(m["content"]) != ""),
                        newest,
                    ),
                    split,
                )
            ),
            tail,
        ),
        lambda u, i: F.concat(
            F.when(i == 0, F.lit("")).when(u["opens"], F.lit("\n")).otherwise(F.lit(" ")),
            u["s"],
        ),
    )
    return F.coalesce(F.array_join(pieces, ""), F.lit(""))


def fallback_query_text(messages: Column | str, limit: int = FALLBACK_BYTES) -> Column:
    """Newest messages first, one per line, until the text plus its last message pass ``limit``.

    The length of the message just added counts twice, so the check is not
    monotone: it is run as the loop it is, over lengths only.
    """
    contents = F.reverse(F.transform(_col(messages), lambda m: F.coalesce(m["content"], F.lit(""))))
    # Each line has a byte at least, so limit + 1 lines always suffice.
    recent = F.slice(contents, 1, max(int(limit), 0) + 1)
    state = F.struct(
        F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("bytes"), F.lit(False).alias("full")
    )

    def step(acc: Column, content: Column) -> Column:
        size = F.octet_length(content)
        out = acc["bytes"] + size + 1
        grown = F.struct(
            (acc["n"] + 1).alias("n"), out.alias("bytes"), (out + size > limit).alias("full")
        )
        return F.when(acc["full"], acc).otherwise(grown)

    kept = F.aggregate(recent, state, step, lambda acc: acc["n"])
    lines = F.transform(F.slice(recent, F.lit(1), kept), lambda c: F.concat(c, F.lit("\n")))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def _canonical_role(role: Column, aliases: dict[str, str]) -> Column:
    if not aliases:
        return role
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(names[role], role)


def transcript_text(
    messages: Column | str, role_aliases: dict[str, str] | None = None
) -> Column:
    """One prefixed line per message of a known role; other roles are left out.

    The strict rule knows only ``user``, ``model`` and ``system``; by default
    ``assistant`` is read as ``model``.  Pass ``role_aliases={}`` for strict.
    """
    aliases = ROLE_ALIASES if role_aliases is None else role_aliases
    prefix = F.create_map(*[F.lit(x) for pair in ROLE_PREFIX.items() for x in pair])
    lines = F.transform(
        _col(messages),
        lambda m: F.concat(
            prefix[_canonical_role(m["role"], aliases)],
            F.coalesce(m["content"], F.lit("")),
            F.lit("\n"),
        ),
    )
    # Unknown roles make null lines, which array_join skips.
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def last_user_content(messages: Column | str) -> Column:
    """Content of the last user message, null where there is none."""
    asked = F.filter(_col(messages), lambda m: m["role"] == "user")
    return F.when(
        F.size(asked) > 0, F.coalesce(F.try_element_at(asked, F.lit(-1))["content"], F.lit(""))
    )


def normalise_fact(text: Column | str) -> Column:
    """Form under which two facts count as the same: case, blanks, closing marks ignored."""
    squeezed = F.regexp_replace(F.lower(_col(text)), rf"{_WS}++", " ")
    return F.rtrim(F.btrim(squeezed), F.lit(".!?"))

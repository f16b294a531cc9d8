"""Personal data: exact base patterns, and a deobfuscating reading whose finds are mapped back to the source."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from memlake.llm.batches import map_batches

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int, str]

# --- base patterns ---------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A match cannot start within a run of digits: what fails at its start fails there too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, each `@` looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (domain := _DOMAIN.match(text, end)):
            end = done = domain.end()
            yield start, end
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(digit), 10)) for digit in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of each base match that passes its check, by start, then kind as in KINDS."""
    spans = [(start, end, "email") for start, end in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            spans.append((*match.span(), "ip"))
    for match in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", match[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((*match.span(), "card"))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", match[0])) <= 15:
                spans.append((*match.span(), "phone"))
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[2])))


# --- deobfuscation ---------------------------------------------------------

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορτυχıɡ∶․‐‑‒–—―−•·。．＠",
        "ABEKMHOPCTYXaeopcyxijsdqwhlABEZHIKMNOPTYXavoptuxig:.-------...." + "@",
        strict=False,
    )
)
# Spelled digits.
_DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")) | {"oh": "0"}
# Invisible characters, left out when reading.
_HIDDEN = "­​‌‍⁠﻿"


def _plain_letters() -> dict[str, str]:
    """Characters that stand for one ASCII character: look-alikes, and forms that NFKC folds to it."""
    forms = [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x24B6, 0x24EA)]
    forms += [*range(0x2070, 0x208F), 0xB2, 0xB3, 0xB9, *range(0x660, 0x66A), *range(0x6F0, 0x6FA)]
    made = {}
    for point in forms:
        char = chr(point)
        digit = unicodedata.digit(char, None)
        folded = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
        if len(folded) == 1 and folded.isascii():
            made[char] = folded
    made |= {" ": " ", " ": " ", " ": " ", " ": " "}
    return made | {char: plain for char, plain in _LOOKALIKES.items() if plain.isascii()}


_PLAIN = _plain_letters()
_ODD_CHARACTERS = frozenset("".join(_PLAIN) + _HIDDEN)
_ODD = re.compile("[" + re.escape("".join(_PLAIN) + _HIDDEN) + "]")
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
#: A run of spelled digits and digits, with at most two blanks, hyphens, dots or commas between.
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])(?:plus[ -]+)?(?:{_WORD}|[0-9]+)(?![A-Za-z])"
    rf"(?:[ .,-]{{1,2}}(?:(?:point|dot)[ ]?)?(?:{_WORD}|[0-9]+)(?![A-Za-z]))*+",
    re.IGNORECASE,
)
_SPELLED_WORD = re.compile(rf"(?<![A-Za-z])(?:{_WORD}|plus|dot|point)(?![A-Za-z])", re.IGNORECASE)
#: A spelled digit with another one, a digit or a mark beside it.
_ANY_SPELLED = re.compile(
    rf"(?<![A-Za-z])(?:{_WORD})[ .,-]{{1,2}}(?:(?:{_WORD}|dot|point)(?![A-Za-z])|[0-9])"
    rf"|(?:[0-9]|(?<![A-Za-z])(?:dot|point|plus))[ .,-]{{1,2}}(?:{_WORD})(?![A-Za-z])",
    re.IGNORECASE,
)
_GAP = re.compile(r"[ ,]+")
_BLANKS = re.compile(r"[ ,]+$")
#: user at host dot name: words in brackets of any kind, or bare words if a dot word follows the at word.
_BRACKET_AT = r"[ ]{0,2}[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]{0,2}"
_BRACKET_DOT = r"[ ]{0,2}[\[({<][ ]?(?:dot|\.|point)[ ]?[\])}>][ ]{0,2}"
_BARE_AT, _BARE_DOT = r"[ ]{1,2}at[ ]{1,2}|[ ]{0,2}@[ ]{0,2}", r"[ ]{1,2}dot[ ]{1,2}"
_NAME = r"[A-Za-z0-9-]{1,63}"
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<user>[A-Za-z0-9_%+-]{{1,64}}(?:(?:\.|{_BRACKET_DOT}|{_BARE_DOT})[A-Za-z0-9_%+-]{{1,64}}){{0,4}})"
    rf"(?:(?P<clear>{_BRACKET_AT})|{_BARE_AT})"
    rf"(?P<host>{_NAME}(?:(?:\.|{_BRACKET_DOT}|{_BARE_DOT}){_NAME}){{1,6}})(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
_DOT_WORD = re.compile(rf"{_BRACKET_DOT}|{_BARE_DOT}", re.IGNORECASE)
_AT_WORD = re.compile(rf"{_BRACKET_AT}|{_BARE_AT}", re.IGNORECASE)
#: What looks like `at host.name` in one token, and words that stand before a bare `at` in prose.
_AT_HOST = re.compile(r"[ ]at[ ]{1,2}[A-Za-z0-9-]+\.[A-Za-z]", re.IGNORECASE)
_PROSE = frozenset(
    "available be been find found here hosted is are was were live located look looked looking looks me meet more now off online "
    "open out page read see seen site start them there us up visit website work working works".split()
)
_HINTS = re.compile(r"[\[({<][ ]?(?:at|@|dot|\.|point)[ ]?[\])}>]|[ ]@|@[ ]|[ ]dot[ ]", re.IGNORECASE)


class Reading:
    """A text read through a transducer: what was written and, for each stretch of it, where it came from."""

    def __init__(self, source: str):
        self.source, self.parts, self.starts, self.spans, self.length = source, [], [], [], 0
        self.changed: list[tuple[int, int]] = []

    def copy(self, start: int, end: int) -> None:
        if end > start:
            self._put(self.source[start:end], start, end)

    def write(self, text: str, start: int, end: int) -> None:
        """`text` stands for the source from start to end."""
        self.changed.append((self.length, self.length + len(text)))
        if text:
            self._put(text, start, end)

    def _put(self, text: str, start: int, end: int) -> None:
        self.parts.append(text)
        self.starts.append(self.length)
        self.spans.append((start, end, len(text)))
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span that the written span came from; a stretch written anew counts whole."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        from_, to, n = self.spans[i]
        first = from_ + start - self.starts[i] if to - from_ == n else from_
        from_, to, n = self.spans[j]
        last = from_ + end - self.starts[j] if to - from_ == n else to
        return first, last


def letters(source: str) -> Reading:
    """Look-alikes and compatibility forms read as ASCII, invisible characters left out."""
    reading, done = Reading(source), 0
    for match in _ODD.finditer(source):
        reading.copy(done, match.start())
        reading.write(_PLAIN.get(match[0], ""), *match.span())
        done = match.end()
    reading.copy(done, len(source))
    return reading


def _beside(reading: Reading, at: int, end: int, after: str) -> int:
    """Blanks and commas between a spelled digit and the digits that follow it are read as one blank."""
    blanks = _GAP.match(reading.source, at, end)
    if not blanks or after not in _DIGITS:
        return at
    reading.write(" ", *blanks.span())
    return blanks.end()


def digits(source: str) -> Reading:
    """Runs of two or more, one of them a spelled digit at least, read as digits; `plus` before them as a sign, `dot` and `point` between as dots."""
    reading, done = Reading(source), 0
    for run in _SPELLED.finditer(source):
        words = [word for word in _SPELLED_WORD.finditer(source, *run.span())]
        if not any(word[0].lower() in _DIGITS for word in words) or len(words) == 1 and words[0].span() == run.span():
            continue
        at, after = run.start(), ""
        reading.copy(done, at)
        for word in words:
            lower = word[0].lower()
            gap = source[at : word.start()]
            if gap and not _GAP.fullmatch(gap) or lower == "plus":
                at = _beside(reading, at, word.start(), after)
                blanks = _BLANKS.search(source, at, word.start())
                if blanks and lower != "plus":
                    reading.copy(at, blanks.start())
                    reading.write(" " if lower in _DIGITS else "", *blanks.span())
                else:
                    reading.copy(at, word.start())
            else:
                reading.write("", at, word.start())
            reading.write({"plus": "+", "dot": ".", "point": "."}.get(lower) or _DIGITS[lower], *word.span())
            at, after = word.end(), lower
            if lower in ("plus", "dot", "point"):
                skip = at
                while skip < run.end() and source[skip] in " -":
                    skip += 1
                reading.write("", at, skip)
                at = skip
        at = _beside(reading, at, run.end(), after)
        reading.copy(at, run.end())
        done = run.end()
    reading.copy(done, len(source))
    return reading


def addresses(source: str) -> Reading:
    """`user (at) host (dot) name` and the like read as addresses.

    Bare words count only if the host's last part is two to ten letters and `dot` is spelled too, or the host is
    one token with a last part in small letters and no word of prose before `at`; so other prose with `at` stays as it is.
    """
    reading, done = Reading(source), 0
    for match in _DISGUISED.finditer(source):
        host = match["host"]
        parts = [part for part in _DOT_WORD.split(host) for part in part.split(".")]
        spelled = _DOT_WORD.search(host)
        if not (2 <= len(parts[-1]) <= 10 and parts[-1].isalpha()):
            continue
        token = parts[-1].islower() or host.isupper()
        if not (match["clear"] or spelled or "@" in match[0] or token and match["user"].lower() not in _PROSE):
            continue
        marks = [(m.span(), ".") for m in _DOT_WORD.finditer(source, *match.span("user"))]
        middle = (match.end("user"), match.start("host"))
        marks.append((middle, "@"))
        marks += [(m.span(), ".") for m in _DOT_WORD.finditer(source, *match.span("host"))]
        for (start, end), mark in marks:
            reading.copy(done, start)
            reading.write(mark, start, end)
            done = end
    reading.copy(done, len(source))
    return reading


_LETTERS_ONLY = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
_SPELLED_SET = frozenset(word.encode() for word in _DIGITS)


def _words(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_LETTERS_ONLY).split())


def _has_odd(text: str) -> bool:
    return not text.isascii() and not _ODD_CHARACTERS.isdisjoint(text)


def _has_spelled(text: str) -> bool:
    """Whether the transducer of digits can change the text; whole words are looked up first, as patterns are slow."""
    return not _SPELLED_SET.isdisjoint(_words(text)) and bool(_ANY_SPELLED.search(text))


def _has_address(text: str) -> bool:
    if "@" not in text and not any(mark in text for mark in "[({<"):
        lower = text.lower()
        if " dot " not in lower and not (" at " in lower and _AT_HOST.search(lower)):
            return False
    return bool(_HINTS.search(text) or _AT_HOST.search(text))


def disguised_spans(text: str) -> list[Span]:
    """Spans in `text` of the identifiers that only its deobfuscated reading shows."""
    chain, current = [], text
    for needed, transducer in ((_has_odd, letters), (_has_spelled, digits), (_has_address, addresses)):
        if needed(current):
            reading = transducer(current)
            if reading.changed:
                chain.append(reading)
                current = reading.text
    if not chain:
        return []
    found = []
    for start, end, kind in base_spans(current):
        for reading in reversed(chain):
            start, end = reading.back(start, end)
        found.append((start, end, kind))
    return found


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans, and the spans that deobfuscation adds: those that overlap no base span of their kind."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    for start, end, kind in disguised_spans(text):
        if not any(kind == k and start < e and s < end for s, e, k in base):
            added.append((start, end, kind))
    return base, added


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def masked(text: str | None, spans: Sequence[Span]) -> str | None:
    """`text` with each stretch that spans cover replaced by the kind of its first span, as `<EMAIL>`."""
    if not spans:
        return text
    parts, done = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of `df`; n_email, n_ip, n_card, n_phone; base_spans; spans; masked.

    The counts and `base_spans` are of the base patterns, `spans` (array of start, end, kind, in code points) also
    holds what deobfuscation adds, `masked` is the text with all of them replaced. Null or empty texts: no
    spans, and `masked` as the text. Row by row: repeated rows stay, equally named input columns give way.
    """

    def start():
        def work(texts):
            rows = [(value, *spans_of(value)) for value in texts]
            counts = [[sum(kind == k for _, _, k in base) for _, base, _ in rows] for kind in KINDS]
            every = [sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]))) for _, base, added in rows]
            return [
                *counts,
                [_structs(base) for _, base, _ in rows],
                [_structs(spans) for spans in every],
                [masked(row[0], spans) for row, spans in zip(rows, every)],
            ]

        return work

    span = "array<struct<start:long,end:long,kind:string>>"
    fields = f"n_email long, n_ip long, n_card long, n_phone long, base_spans {span}, spans {span}, masked string"
    return map_batches(df, df.columns if keep is None else keep, [text], fields, start)


def _structs(spans: Sequence[Span]) -> list[dict]:
    return [{"start": start, "end": end, "kind": kind} for start, end, kind in spans]


def digest(spans: Sequence[Span]) -> str:
    """Lowercase hex of SHA-256 of kind:start:end, comma-joined."""
    return hashlib.sha256(joined(spans).encode()).hexdigest()

"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (Luhn for card numbers, remainder 97 for bank
account numbers, ranges for addresses, the calendar for dates, reserved blocks for
social security numbers); what does not validate stays as it is, but shorter stretches of
it (that end with a group of characters) and later ones are tried.  A valid value is a
number below the size of its format; a keyed Feistel network with cycle walking permutes
that range without fixed points, and the image is written in the value's own layout
(separators, case, date order).  Letters of any script are replaced by letters of their own
kind and neighbourhood.  The key and the kind alone decide, so equal values stay linked
across documents, whatever stands beside them, and with the key and the report of what was
replaced every text can be restored (``restore``).  The key is the caller's (``session_key``).

Nulls: a null text stays null, without findings.  Repeated rows are treated alike.  Empty
texts and tables stay as they are; very long texts are searched as a whole, one at a time.
Where patterns overlap the first in the order below wins.  Other columns stay, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from datetime import date
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmetrics.llm.rowmap import free_name, with_text_struct

ROUNDS = 8
#: Fixed alphabets; a character is replaced within its own.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_OF = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
_HEX = ("0123456789abcdef", "0123456789ABCDEF")
#: Characters of an IPv6 address; a digit stays a digit.
_IPV6 = {c: (a, i) for a in ("0123456789", "abcdef", "ABCDEF") for i, c in enumerate(a)}
#: Dates are permuted among these days.
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

#: Layouts in which card numbers are usually written.
_CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?!\w)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: What a grouped international phone does not run into: a card, date, social security number, address or phone.
_OTHER = rf"(?:{_CARD}|[0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}(?![0-9])|[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}(?![0-9])|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9])|{_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])(?!\w)|[0-9]{{3}}[ .-][0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9]))"
PATTERN = re.compile(
    "|".join(
        (
            r"(?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key))\s*[=:]\s*[\"'](?P<secret_value>[^\"'\s]{8,})[\"'])",
            r"(?P<email>(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+(?:xn--[A-Za-z0-9-]+|[^\W\d_]{2,}))",
            r"(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]{0,38}[0-9])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))",
            rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])(?!\w))",
            r"(?P<phone>(?<![\w+])(?<![0-9],)(?:(?:\+(?P<country>[0-9]{1,3})[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
            rf"|\+[1-9][0-9]{{7,14}}(?![0-9])|\+[1-9](?:[0-9]|[ .()-]{{1,2}}(?!{_OTHER})[0-9]){{7,14}}(?![0-9])))",
            r"(?P<iso_date>(?<![\w/.-])[0-9]{4}(?P<iso_sep>[-/.])[0-9]{2}(?P=iso_sep)[0-9]{2}(?![0-9]))",
            r"(?P<day_date>(?<![\w/.-])[0-9]{1,2}(?P<day_sep>[-/.])[0-9]{1,2}(?P=day_sep)[0-9]{4}(?![0-9]))",
            r"(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))",
            r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<card>(?<![\w.])[0-9](?:[ -]?[0-9]){11,18}(?!\w))",
        )
    )
)
_USUAL_CARD = re.compile(_CARD)
_KINDS = ("secret", "email", "ipv6", "ip", "phone", "iso_date", "day_date", "ssn", "iban", "card")
#: Every pattern needs one of these.
_MAYBE = re.compile(r"[0-9@]|[=:]\s*[\"']")


@lru_cache(maxsize=1 << 14)
def alphabet_of(c: str) -> tuple[str, int] | None:
    """The characters among which a letter or digit is replaced, and its place there; None for other characters.

    Beyond the fixed alphabets: those of its category in its block of 256 code points.
    """
    if c in _OF or not c.isalnum():
        return _OF.get(c)
    kind, first = unicodedata.category(c), ord(c) & ~0xFF
    same = "".join(x for x in map(chr, range(first, first + 256)) if x.isalnum() and x not in _OF and unicodedata.category(x) == kind)
    return same, same.index(c)


class Pseudonyms:
    """Keyed permutations of formats."""

    def __init__(self, key: bytes, backwards: bool = False):
        self.key, self.backwards = key, backwards
        self.value = lru_cache(maxsize=1 << 14)(self._value)

    def _round(self, kind: str, k: int, x: int, a: int) -> int:
        size = max(16, (a.bit_length() + 7) // 8 + 8)
        seed = b"%s|%d|%d|%d" % (kind.encode(), k, a, x)
        out = b"".join(hashlib.blake2b(seed, key=self.key[:64], salt=bytes([i])).digest() for i in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") % a

    def _network(self, x: int, n: int, kind: str, backwards: bool) -> int:
        """The Feistel network over 0 .. a * a - 1 with a = ceil(sqrt(n)), walked on until it is below n."""
        a = isqrt(n - 1) + 1
        while True:
            left, right = divmod(x, a)
            for k in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
                if backwards:
                    left, right = (right - self._round(kind, k, left, a)) % a, left
                else:
                    left, right = right, (left + self._round(kind, k, right, a)) % a
            x = left * a + right
            if x < n:
                return x

    def permute(self, x: int, n: int, kind: str) -> int:
        """The image of x in the permutation of 0 .. n - 1 that belongs to ``kind``; no number is its own image.

        A keyed step within the order that the network gives: F^-1(F(x) + s) with 0 < s < n.
        """
        if n < 2:
            return x
        step = 1 + self._round(f"{kind}|step", 0, n, n - 1)
        at = self._network(x, n, kind, False) + (-step if self.backwards else step)
        return self._network(at % n, n, kind, True)

    def characters(self, text: str, kind: str, hexadecimal: bool = False) -> str:
        """Every letter and digit replaced within its alphabet; the rest stays in place."""
        if hexadecimal:
            alphabet = _HEX[any(c.isupper() for c in text)]
            where = [(i, alphabet, alphabet.index(c)) for i, c in enumerate(text)]
        else:
            where = [(i, *found) for i, c in enumerate(text) if (found := alphabet_of(c))]
        return self._written(text, kind, where)

    def _written(self, text: str, kind: str, where: list[tuple[int, str, int]]) -> str:
        """The text with the characters at (place, alphabet, value) permuted together."""
        x, n = 0, 1
        for _, alphabet, value in where:
            x, n = x * len(alphabet) + value, n * len(alphabet)
        x = self.permute(x, n, kind)
        out = list(text)
        for i, alphabet, _ in reversed(where):
            x, value = divmod(x, len(alphabet))
            out[i] = alphabet[value]
        return "".join(out)

    def _value(self, kind: str, text: str) -> str | None:
        """A value's pseudonym; None if it isn't valid or has nothing that could be replaced."""
        new = getattr(self, f"_{kind}")(text)
        return None if new == text else new

    def _secret(self, text: str) -> str:
        return self.characters(text, "secret", bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)))

    def _email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        return f"{self.characters(local, 'email')}@{domain}"

    def _ipv6(self, text: str) -> str | None:
        try:
            IPv6Address(text)
        except AddressValueError:
            return None
        if len(text.replace(":", " ").split()) < 3:
            return None
        return self._written(text, "ipv6", [(i, *_IPV6[c]) for i, c in enumerate(text) if c != ":"])

    def _ip(self, text: str) -> str:
        x = int.from_bytes(bytes(map(int, text.split("."))), "big")
        return ".".join(map(str, self.permute(x, 1 << 32, "ip").to_bytes(4, "big")))

    def _phone(self, text: str) -> str:
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
        at = head.end() if head else 0
        new = self.characters(text[at:], "phone")
        while new.startswith("+0"):  # no country code starts so: walk on
            new = self.characters(new, "phone")
        return text[:at] + new

    def _day(self, year: int, month: int, day: int) -> date | None:
        try:
            x = date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= x <= LAST_DAY:
            return None
        return date.fromordinal(FIRST_DAY + self.permute(x - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))

    def _iso_date(self, text: str) -> str | None:
        d = self._day(*map(int, re.split("[-/.]", text)))
        return d and f"{d.year:04d}{text[4]}{d.month:02d}{text[4]}{d.day:02d}"

    def _day_date(self, text: str) -> str | None:
        """Day first; month first only where the other can't be."""
        a, b, year = map(int, re.split("[-/.]", text))
        sep = re.search("[-/.]", text)[0]
        month_first = b > 12
        d = self._day(year, a, b) if month_first else self._day(year, b, a)
        if d is None:
            return None
        if month_first and d.day <= 12:  # it would be read day first: walk on within the days that are not
            x = d
            while x.day <= 12:
                x = self._day(x.year, x.month, x.day)
            d = x
        return f"{d.month:02d}{sep}{d.day:02d}{sep}{d.year:04d}" if month_first else f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year:04d}"

    def _ssn(self, text: str) -> str | None:
        valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
        if not valid(text):
            return None
        text = self.characters(text, "ssn")
        while not valid(text):
            text = self.characters(text, "ssn")
        return text

    def _iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body = self.characters(flat[4:], "iban")
        made = iter(f"{flat[:2]}{98 - number(body + flat[:2] + '00') % 97:02d}{body}")
        return "".join(c if c == " " else next(made) for c in text)

    def _card(self, text: str) -> str | None:
        digits = [int(c) for c in text if c.isdigit()]
        if len(digits) not in range(13, 20) or luhn_digit(digits[:-1]) != digits[-1] or not any(digits):
            return None
        body = self.characters("".join(map(str, digits[:-1])), "card")
        made = iter(body + str(luhn_digit([int(c) for c in body])))
        return "".join(next(made) if c.isdigit() else c for c in text)


def luhn_digit(digits: list[int]) -> int:
    """The check digit of a number."""
    return -sum((2 * d - 9 * (d > 4)) if i % 2 == 0 else d for i, d in enumerate(reversed(digits))) % 10


def _usual_card(text: str, start: int, end: int, names: Pseudonyms) -> bool:
    """Whether a valid card number in a usual layout starts at or after ``start`` and before ``end``."""
    for k in range(start, end):
        if text[k].isdigit() and not (text[k - 1 : k].isalnum() or text[k - 1 : k] in ("_", ".")):
            m = _USUAL_CARD.match(text, k)
            if m and names.value("card", m[0]):
                return True
    return False


def _card_span(text: str, start: int, end: int, names: Pseudonyms, again: bool) -> tuple[int, int] | None:
    """The card number that starts at ``start``: in a usual layout, or else the longest that is valid.

    ``end`` is the end of the longest stretch; ``again`` if it begins in a stretch that failed.
    Shorter or later numbers have groups of at least three digits.
    """
    usual = _USUAL_CARD.match(text, start)
    if usual and names.value("card", usual[0]):
        return usual.span()
    groups = [m.span() for m in re.compile("[0-9]+").finditer(text, start, end)]
    for k in range(len(groups), 0, -1):
        stop = groups[k - 1][1]
        whole = stop == end and not again
        if (whole or min(b - a for a, b in groups[:k]) >= 3) and names.value("card", text[start:stop]):
            return None if _usual_card(text, start + 1, stop, names) else (start, stop)
    return None


def _iban_span(text: str, start: int, end: int, names: Pseudonyms) -> tuple[int, int] | None:
    """The longest valid account number that starts at ``start`` and ends with one of its groups."""
    while end - start >= 15:
        if names.value("iban", text[start:end]):
            return start, end
        end = text.rfind(" ", start, end)
    return None


def _find(text: str, names: Pseudonyms) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all valid values; after one that isn't valid the search goes on from its next character."""
    found, at, failed = [], 0, 0
    while m := PATTERN.search(text, at):
        kind = m.lastgroup if m.lastgroup in _KINDS else next(k for k in ("secret", "phone", "iso_date", "day_date") if m[k])
        span: tuple[int, int] | None = m.span("secret_value") if kind == "secret" else m.span()
        if kind == "card":
            span = _card_span(text, *span, names, m.start() < failed)
        elif kind == "iban":
            span = _iban_span(text, *span, names)
        elif names.value(kind, text[span[0] : span[1]]) is None:
            span = None
        if span is None:
            failed = max(failed, m.end())
            at = m.start() + 1
            continue
        found.append((kind, *span))
        at = m.end() if kind == "secret" else span[1]
    return found


def replace_all(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the new text.

    A value's pseudonym depends on key, kind and value alone, whatever stands beside it.
    """
    found = _find(text, names) if _MAYBE.search(text) else []
    return _replaced(text, found, names)


def restore_all(text: str, found: list[tuple[str, int, int]], names: Pseudonyms) -> str:
    """The text before ``replace_all``, which reported ``found``; ``names`` are the key's backwards.

    The report is needed: beside other characters a pseudonym may look like part of another value.
    """
    return _replaced(text, found, names)[0]


def _replaced(text: str, found: list[tuple[str, int, int]], names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    out, made, at, size = [], [], 0, 0
    for kind, a, b in found:
        new = names.value(kind, text[a:b]) or text[a:b]
        size += a - at
        made.append((kind, size, size + len(new)))
        out += [text[at:a], new]
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), made


_own_key = secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The secret of ``spark.draftmetrics.pii.key``; where it is not set, random bytes that live as long as this process.

    Set it (from a secret store) where pseudonyms must agree between runs or be restored later.
    """
    given = spark.conf.get("spark.draftmetrics.pii.key", None)
    return hashlib.blake2b(given.encode()).digest() if given else _own_key


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with its text replaced and a struct column of findings (kinds, starts, ends)."""
    name = name or free_name(docs, "pii")

    def make():
        names = Pseudonyms(key)

        def work(texts: list[str | None]) -> list[list]:
            done = [(None, []) if t is None else replace_all(t, names) for t in texts]
            return [[t for t, _ in done], [[k for k, _, _ in f] for _, f in done], [[a for _, a, _ in f] for _, f in done], [[b for _, _, b in f] for _, f in done]]

        return work

    out = with_text_struct(docs, text_col, name, "text string, kinds array<string>, starts array<long>, ends array<long>", make)
    columns = [f"`{name}`.text AS `{c}`" if c == text_col else f"`{c}`" for c in docs.columns]
    return out.selectExpr(*columns, f"struct(`{name}`.kinds, `{name}`.starts, `{name}`.ends) AS `{name}`")


def restore(docs: DataFrame, key: bytes, text_col: str = "text", name: str = "pii") -> DataFrame:
    """The documents before ``pseudonymise``, whose findings are in column ``name`` (which goes)."""

    @F.pandas_udf("string")
    def back(text: pd.Series, kinds: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        names = Pseudonyms(key, True)
        return pd.Series([None if t is None else restore_all(t, list(zip(k, a, b)), names) for t, k, a, b in zip(text, kinds, starts, ends)], dtype=object)

    return docs.withColumn(text_col, back(F.col(text_col), *[F.col(f"`{name}`.{c}") for c in ("kinds", "starts", "ends")])).drop(name)

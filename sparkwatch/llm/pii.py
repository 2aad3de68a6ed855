"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation.

Values are found by pattern and then validated: card numbers by the Luhn digit, IBANs by
their check digits, calendar dates, dotted quads, social security numbers by their ranges,
phone numbers by length. What doesn't validate is left alone, and the search goes on inside it:
an IBAN is tried at its country's length and then at each word end, from the longest, and other
values from the next character on. The payload of a validated value is a number of a finite
domain; a Feistel network over the next even number of bits, keyed and walked until the number
falls into the domain again, permutes that domain. Check digits are computed anew, separators,
letter case and length stay. So a pseudonym has the value's format and validates too, equal
values get equal pseudonyms in all documents, different values different ones, and the holder
of the key can invert it (``Pseudonyms(..., undo=True)``). Equal means the value and not its
spelling: a date is its day (1999-12-31, 31/12/1999, 12/31/1999), and days of month up to 12 and
beyond are permuted among themselves, so that what could be read in one order only stays so; a
phone number is its country code and its digits, whatever stands between them, and a number
without a country code is one of country code 1; cards, IBANs, addresses and secrets are their
digits and letters, without separators and letter case. To invert a whole text, ``undo`` has
to find the values again; where a word beside a pseudonym validates together with it by chance,
it reads another value.

Kinds: card, iban, date (years 1900 to 2099), ssn, phone, ip, email (all but the top-level
domain), secret (hexadecimal strings of 32, 40 or 64 digits).

Defined cases: a null text stays null with no findings; an empty text or one without
findings is returned as it is, character for character; repeated rows get equal results; an
empty table gives an empty result; all columns of the input are kept by ``mask``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, release_memory, require_columns

ROUNDS = 10
KINDS = ("card", "iban", "date", "ssn", "phone", "ip", "email", "secret")
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

_PATTERN = re.compile(
    r"""
    (?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))
  | (?P<secret>(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![A-Za-z0-9]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<date>(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]))
  | (?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))
  | (?P<phone>(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])
            | (?<![0-9(+])\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?![0-9]) | (?<![0-9+.-])[0-9]{3}([.-])[0-9]{3}\g<sep>[0-9]{4}(?![0-9]))
  | (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
  | (?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\g<dash>[0-9]{4}\g<dash>[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))
    """.replace(r"([.-])", r"(?P<sep>[.-])").replace(r"\g<sep>", r"(?P=sep)").replace(r"([ -])", r"(?P<dash>[ -])").replace(r"\g<dash>", r"(?P=dash)"),
    re.VERBOSE,
)
#: What every value of any kind holds: a digit, an @, or as many letters as a secret without digits.
_MAYBE = re.compile(r"[0-9@]|[a-f]{32}|[A-F]{32}")
#: Country calling codes of one and two digits; all others have three.
_ONE_DIGIT = "17"
_TWO_DIGITS = """20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66
    81 82 84 86 90 91 92 93 94 95 98""".split()
#: Characters of an IBAN by country.
_IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29
    ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20
    LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29
    PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20
    YE30""".split()}


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


class Pseudonyms:
    """The pseudonyms under one key. ``undo`` gives the inverse mapping."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = hashlib.sha256(key).digest(), undo
        self.value = lru_cache(100_000)(self._value)

    def _half(self, kind: str, k: int, value: int, bits: int) -> int:
        data = f"{kind}|{bits}|{k}|{value}".encode()
        size = bits // 8 + 9
        out = b"".join(hashlib.blake2b(data + bytes([i]), key=self.key).digest() for i in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _feistel(self, kind: str, number: int, half: int) -> int:
        mask = (1 << half) - 1
        left, right = number >> half, number & mask
        if self.undo:
            for k in reversed(range(ROUNDS)):
                left, right = right ^ self._half(kind, k, left, half), left
        else:
            for k in range(ROUNDS):
                left, right = right, left ^ self._half(kind, k, right, half)
        return left << half | right

    def permute(self, kind: str, number: int, size: int) -> int:
        """A keyed permutation of 0 .. size - 1; ``kind`` and ``size`` choose the permutation."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        tweak = f"{kind}|{size}"
        while True:
            number = self._feistel(tweak, number, half)
            if number < size:
                return number

    def characters(self, kind: str, text: str) -> str:
        """Permutes the letters and digits of ``text`` inside their classes; the rest stays."""
        sizes = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in text]
        number, size = 0, 1
        for c, n in zip(text, sizes):
            number = number * n + (ord(c.lower()) - 97 if n == 26 else int(c) if n == 10 else 0)
            size *= n
        number = self.permute(f"{kind}|{''.join('a' if n == 26 else '0' if n == 10 else c for c, n in zip(text, sizes))}", number, size)
        out = []
        for c, n in zip(reversed(text), reversed(sizes)):
            number, d = divmod(number, n)
            out.append(c if n == 1 else str(d) if n == 10 else chr(97 + d).upper() if c.isupper() else chr(97 + d))
        return "".join(reversed(out))

    def digits(self, kind: str, text: str, count: int | None = None) -> str:
        """Permutes the digits of ``text`` as one number, separators stay."""
        old = "".join(c for c in text if c.isdigit())
        new = iter(str(self.permute(kind, int(old), 10 ** len(old))).zfill(len(old)))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where ``text`` doesn't validate."""
        digits = "".join(c for c in text if c.isdigit())
        if kind == "card":
            if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
                return None
            new = self.digits("card", digits[:-1])
            return _refill(text, new + str(luhn(new)))
        if kind == "iban":
            plain = text.replace(" ", "")
            if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != int(plain[2:4]):
                return None
            account = self.characters("iban" + plain[:2], plain[4:])
            new = iter(plain[:2] + f"{iban_check(plain[:2], account):02d}" + account)
            return "".join(c if c == " " else next(new) for c in text)
        if kind == "date":
            parts = re.split(r"[^0-9]", text)
            year_first = len(parts[0]) == 4
            # 31/12/1999 or 12/31/1999: day first unless only month first is a date
            for order in ((0, 1, 2),) if year_first else ((2, 1, 0), (2, 0, 1)):
                try:
                    day = dt.date(*(int(parts[k]) for k in order)).toordinal()
                except ValueError:
                    continue
                if _FIRST_DAY <= day <= _LAST_DAY:
                    return self._date(text, order, day)
            return None
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
                return None
            n = self.permute("ip", int.from_bytes(bytes(octets), "big"), 1 << 32)
            return ".".join(map(str, n.to_bytes(4, "big")))
        if kind == "ssn":
            area, group, serial = text.split("-")
            if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
                return None
            areas = [a for a in range(1, 900) if a != 666]
            n = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
            n, s = divmod(self.permute("ssn", n, len(areas) * 99 * 9999), 9999)
            return f"{areas[n // 99]:03d}-{n % 99 + 1:02d}-{s + 1:04d}"
        if kind == "phone":
            if not 8 <= len(digits) <= 15:
                return None
            country = calling_code(digits) if text[0] == "+" else ""
            own = digits[len(country) :]
            new = self.permute(f"phone{country or 1}", int(own), 10 ** len(own))
            return _refill(text, country + str(new).zfill(len(own)))
        if kind == "secret":
            n = self.permute("secret", int(text, 16), 16 ** len(text))
            out = f"{n:0{len(text)}x}"
            return out.upper() if text.upper() == text else out
        head, _, top = text.rpartition(".")
        return f"{self.characters('email', head)}.{top}"

    def _date(self, text: str, order: tuple[int, ...], day: int) -> str:
        """Days are permuted under one key for all spellings, those up to the 12th of a month and the
        others among themselves: a text that is read month first stays so, and one that could be
        read day first too."""
        size = _LAST_DAY - _FIRST_DAY + 1
        late = dt.date.fromordinal(day).day > 12
        n = day - _FIRST_DAY
        while True:
            n = self.permute("date", n, size)
            new = dt.date.fromordinal(_FIRST_DAY + n)
            if (new.day > 12) == late:
                break
        values = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
        seps = re.findall(r"[^0-9]", text)
        return f"{values[0]}{seps[0]}{values[1]}{seps[1]}{values[2]}"

    def mask(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and the number of findings by kind."""
        if not _MAYBE.search(text):
            return text, {}
        found: dict[str, int] = {}
        out, done, at = [], 0, 0
        while m := _PATTERN.search(text, at):
            kind = _kind(m)
            for value in _ibans(m[0]) if kind == "iban" else (m[0],):
                if (new := self.value(kind, value)) is not None:
                    found[kind] = found.get(kind, 0) + 1
                    out += [text[done : m.start()], new]
                    done = at = m.start() + len(value)
                    break
            else:
                at = m.start() + 1
        return "".join([*out, text[done:]]), found


def _ibans(text: str) -> list[str]:
    """What ``text`` may hold from its start on: the country's length first, then from the longest."""
    ends = [text, *(text[: m.start()] for m in reversed(list(re.finditer(" ", text))))]
    return sorted(ends, key=lambda t: len(t.replace(" ", "")) != _IBAN_LENGTHS.get(t[:2]))


def calling_code(digits: str) -> str:
    """The country calling code that ``digits`` begin with."""
    return digits[:1] if digits[0] in _ONE_DIGIT else digits[:2] if digits[:2] in _TWO_DIGITS else digits[:3]


def _kind(m: re.Match) -> str:
    return next(k for k in KINDS if m[k] is not None)


def _refill(text: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


@lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def mask(docs: DataFrame, key: bytes, counts: bool = True) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` under the secret ``key``; with ``counts`` also ``n_<kind>`` columns, in place
    of columns of these names. No shuffle."""
    prepare(docs.sparkSession)
    require_columns(docs, "text")

    @F.pandas_udf("text string, " + ", ".join(f"n_{k} int" for k in KINDS))
    def run(texts: pd.Series) -> pd.DataFrame:
        p = pseudonyms(key)
        rows = [p.mask(t) if t is not None else (None, {}) for t in texts]
        release_memory()
        return pd.DataFrame({"text": [r[0] for r in rows]} | {f"n_{k}": [r[1].get(k, 0) for r in rows] for k in KINDS})

    out = free_name(docs, "masked")
    names = {f"n_{k}" for k in KINDS} if counts else set()
    columns = [F.col(f"{out}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    extra = [F.col(f"{out}.n_{k}").alias(f"n_{k}") for k in KINDS] if counts else []
    return docs.withColumn(out, run(F.col("text"))).select(*columns, *extra)

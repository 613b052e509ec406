"""Format-preserving pseudonyms for personal data.

Values are found by pattern, validated (check digits, calendar, octet and area rules), turned
into a number, permuted by a keyed Feistel network over exactly the numbers that are valid in
their format, and written back in the same format.  The permutation depends on the key and the
kind alone: equal values get equal pseudonyms in every document, different values of a kind
different ones.  A date is one value in all of its spellings, as is an IPv6 address, which comes
out with its eight groups.  Everything else in a text stays as it is.

Values of any length are taken: of long ones PART characters at a time are permuted, each part
under a tweak of the parts before it, so the whole stays a permutation and the time linear.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Callable
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table

#: The key of tests and of the registered query; production passes its own.
KEY = b"spanloom demonstration key"
ROUNDS = 10
#: Characters that are permuted as one number.
PART = 96


def feistel(x: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of the numbers 0 <= x < size, or of those among them that are valid.

    The number is split into two digits of a radix near sqrt(size); rounds add a keyed hash of
    one digit to the other.  Results outside the domain are permuted on until one falls inside.
    """
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    head = tweak.encode() + b"|" + size.to_bytes(size.bit_length() // 8 + 1, "big") + b"|"
    wide = size.bit_length() // 8 + 8
    digest_size = 24 if wide < 27 else 64
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS):
            source = right if r % 2 == 0 else left
            digest = hashlib.blake2b(head + bytes((r,)) + source.to_bytes(wide, "big"), key=key[:64], digest_size=digest_size).digest()
            f = int.from_bytes(digest, "big")
            if r % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        x = left * b + right
        if x < size and (valid is None or valid(x)):
            return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """The digits in the places that digits have in shape."""
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() and c.isascii() else c for c in shape)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _number(value: str, key: bytes, kind: str) -> tuple[str, str]:
    """Long digit runs: with a right Luhn digit they stay so, without one they stay without."""
    digits = _digits(value)
    if 13 <= len(digits) <= 19 and luhn(digits):
        body = str(feistel(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card")).zfill(len(digits) - 1)
        check = next(c for c in "0123456789" if luhn(body + c))
        return _refill(value, body + check), "card"
    n = len(digits)
    if n > PART:
        return _classes(value, key, "number"), "number"
    keeps = (lambda x: not luhn(str(x).zfill(n))) if 13 <= n <= 19 else None
    return _refill(value, str(feistel(int(digits), 10**n, key, "number", keeps)).zfill(n)), "number"


def _ssn_ok(x: int) -> bool:
    s = f"{x:09d}"
    return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"


def _ssn(value: str, key: bytes, kind: str) -> tuple[str, str] | None:
    n = int(_digits(value))
    return (_refill(value, f"{feistel(n, 10**9, key, 'ssn', _ssn_ok):09d}"), kind) if _ssn_ok(n) else None


def _phone(value: str, key: bytes, kind: str) -> tuple[str, str] | None:
    digits = _digits(value)
    if not 9 <= len(digits) <= 15:
        return None
    country = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
    keep = len(country[1]) if country else 0
    n = len(digits) - keep
    return _refill(value, digits[:keep] + str(feistel(int(digits[keep:]), 10**n, key, f"phone{n}")).zfill(n)), kind


def _ip(value: str, key: bytes, kind: str) -> tuple[str, str] | None:
    parts = [int(x) for x in value.split(".")]
    if any(p > 255 for p in parts):
        return None
    n = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big"))), kind


def _ip6(value: str, key: bytes, kind: str) -> tuple[str, str] | None:
    try:
        n = int(ipaddress.IPv6Address(value))
    except ValueError:
        return None
    digits = value.replace(":", "")
    if len(digits) < 4 or not any(c.isdigit() for c in digits):  # a scope of program text, or no host
        return None
    new = ipaddress.IPv6Address(feistel(n, 1 << 128, key, "ip6")).exploded
    return new.upper() if value != value.lower() else new, kind


#: Letters that a permuted name may hold beside a-z and 0-9: the small letters of Latin-1.
LATIN = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", LATIN)
HEX = ("0123456789abcdef",)
#: Digits of any base up to 36, as int() reads them.
_BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=8)
def _places(classes: tuple[str, ...]) -> dict[str, int]:
    """Character to the number of its class."""
    return {c: n for n, k in enumerate(classes) for c in k}


def _to_number(chars: str, kinds: list[int], classes: tuple[str, ...]) -> tuple[int, int]:
    """The characters as one number, and how many numbers there are."""
    first = classes[kinds[0]]
    if len(first) <= 36 and kinds.count(kinds[0]) == len(kinds):
        digits = chars if _BASE36.startswith(first) else chars.translate(str.maketrans(first, _BASE36[: len(first)]))
        return int(digits, len(first)), len(first) ** len(chars)
    x, size = 0, 1
    for c, k in zip(chars, kinds, strict=True):
        letters = classes[k]
        size *= len(letters)
        x = x * len(letters) + letters.index(c)
    return x, size


def _from_number(x: int, kinds: list[int], classes: tuple[str, ...]) -> str:
    first = classes[kinds[0]]
    if len(first) in (10, 16) and kinds.count(kinds[0]) == len(kinds):
        return format(x, "d" if len(first) == 10 else "x").zfill(len(kinds))
    out = []
    for k in reversed(kinds):
        x, r = divmod(x, len(classes[k]))
        out.append(classes[k][r])
    return "".join(reversed(out))


def _classes(value: str, key: bytes, tweak: str, classes: tuple[str, ...] = CLASSES) -> str:
    """Permute the characters of known classes; case and all others keep their places."""
    low = value.lower()
    if len(low) != len(value):  # a few letters have longer small forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    place = _places(classes)
    where = [i for i, c in enumerate(low) if c in place]
    if not where:
        return value
    chars = low if len(where) == len(low) else "".join([low[i] for i in where])
    shape = "".join([str(place[c]) if c in place else "-" for c in low]) if len(low) <= PART else str(len(low))
    new, before = [], ""
    for s in range(0, len(chars), PART):
        part = chars[s : s + PART]
        kinds = [place[c] for c in part]
        x, size = _to_number(part, kinds, classes)
        new.append(_from_number(feistel(x, size, key, f"{tweak}|{shape}{before}"), kinds, classes))
        before = "|" + hashlib.blake2b((before + part).encode(), key=key[:64], digest_size=16).hexdigest()
    changed = "".join(new)
    if value == chars:
        return changed
    out = list(value)
    for i, c in zip(where, changed, strict=True):
        out[i] = c.upper() if value[i] != low[i] and len(c.upper()) == 1 else c
    return "".join(out)


def _email(value: str, key: bytes, kind: str) -> tuple[str, str]:
    name, _, host = value.rpartition("@")
    return f"{_classes(name, key, 'email')}@{host}", kind


def _hex(value: str, key: bytes, kind: str) -> tuple[str, str]:
    return _classes(value, key, "hex", HEX), kind


def _iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def _iban(value: str, key: bytes, kind: str) -> tuple[str, str] | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _classes(plain[4:].lower(), key, f"iban{plain[:2]}").upper()
    check = 98 - _iban_number(body + plain[:2] + "00") % 97
    it = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(it) for c in value), kind


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def _date(value: str, key: bytes, kind: str) -> tuple[str, str] | None:
    parts = re.split(r"[-./]", value)
    seps = re.findall(r"[-./]", value)
    if seps[0] != seps[1]:
        return None
    year_first = len(parts[0]) == 4
    y, m, d = (parts[0], parts[1], parts[2]) if year_first else (parts[2], parts[1], parts[0])
    swapped = not year_first and int(m) > 12  # month first
    if swapped:
        m, d = d, m
    try:
        day = dt.date(int(y), int(m), int(d))
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    days = (LAST_DAY - FIRST_DAY).days + 1
    # a date that was written month first must stay unreadable as day first, so days beyond 12 stay beyond 12
    # in every spelling
    alike = lambda n: ((FIRST_DAY + dt.timedelta(n)).day > 12) == (day.day > 12)
    new = FIRST_DAY + dt.timedelta(feistel((day - FIRST_DAY).days, days, key, "date", alike))
    two = lambda n, like: f"{n:02d}" if len(like) == 2 else str(n)
    first = (two(new.month, m), two(new.day, d)) if swapped or year_first else (two(new.day, d), two(new.month, m))
    return seps[0].join([str(new.year), *first] if year_first else [*first, str(new.year)]), kind


def _secret(value: str, key: bytes, kind: str) -> tuple[str, str]:
    return _classes(value, key, "secret"), kind


#: Telephone numbers: with a bracketed area, in groups, in pairs, unbroken, and national.
PHONE = r"(?<![\d+])(?:" + "|".join(
    (
        r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}",
        r"\+\d{1,3}[ .-]\d(?:[ .-]\d{2}){4}",
        r"\+\d{1,3}(?:[ .-]\d{2}){4,5}",
        r"\+\d{1,3}[ .-]\d{1,4}[ .-]\d{3,4}[ .-]\d{3,4}",
        r"\+\d{9,15}",
        r"\(\d{3}\) ?\d{3}[ .-]\d{4}",
        r"\d{3}[.-]\d{3}[.-]\d{4}",
    )
) + r")(?!\d)"

#: Kind, pattern and rewriting rule, in the order in which they are tried at a place.
KINDS = (
    # from the start of a run on and without going back, so a long run without an @ is read once
    ("email", r"(?<![^\s@<>\"'(),;:|=])[^\s@<>\"'(),;:|=]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\d.\-/])(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4})(?![\d\-/]|\.\d)", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("phone", PHONE, _phone),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.\d)", _ip6),
    ("number", r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{12,})(?!\d)", _number),
    ("hex", r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])", _hex),
    ("secret", r"(?i:(?<=password = \")|(?<=password=)|(?<=password: )|(?<=secret = \")|(?<=secret=)|(?<=token = \")|(?<=token=)|(?<=api_key = \")|(?<=api_key=))[^\s\"']{6,}", _secret),
)
_RULES = {kind: rule for kind, _, rule in KINDS}


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern:
    # hexadecimal runs begin like long digit runs, so they are tried first
    order = ["hex", *(k for k, _, _ in KINDS if k != "hex")]
    by = {k: p for k, p, _ in KINDS}
    return re.compile("|".join(f"(?P<{k}>{by[k]})" for k in order))


#: A text without one of these holds no personal data of a known kind.
_GATE = re.compile(r"\d|@|(?i:password|secret|token|api_key)")


def pseudonymize_text(text: str | None, key: bytes = KEY) -> tuple[str | None, list[str]]:
    """The text with pseudonyms, and the kinds of the values replaced, in order."""
    if not text or not _GATE.search(text):
        return text, []
    kinds: list[str] = []
    out, at, search = [], 0, _pattern().search
    where = 0
    while m := search(text, where):
        done = _RULES[m.lastgroup](m.group(), key, m.lastgroup)
        if done is None:  # not valid as this kind: look again from the next character on
            where = m.start() + 1
            continue
        kinds.append(done[1])
        out += [text[at : m.start()], done[0]]
        at = where = m.end()
    return "".join([*out, text[at:]]), kinds


def pseudonymize(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """Replace personal data in every whole text.

    All columns stay; ``text`` is rewritten, ``n_pii`` (BIGINT) and ``pii_kinds`` (sorted, distinct,
    comma-joined) are added and replace columns of these names.  Null texts stay null, empty ones
    empty, both with n_pii 0; repeated rows are rewritten each; an empty table gives no rows.
    """
    secret = bytes(key)

    @F.arrow_udf("struct<text: string, n: long, kinds: string>")
    def rewrite(texts: pa.Array) -> pa.Array:
        done = [pseudonymize_text(t, secret) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [
                pa.array([t for t, _ in done], pa.string()),
                pa.array([len(k) for _, k in done], pa.int64()),
                pa.array([",".join(sorted(set(k))) for _, k in done], pa.string()),
            ],
            names=["text", "n", "kinds"],
        )

    out = docs.withColumn("__pii", rewrite(F.col(text)))
    return out.withColumns(
        {text: F.col("__pii.text"), "n_pii": F.col("__pii.n"), "pii_kinds": F.col("__pii.kinds")}
    ).drop("__pii")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs).select("doc_id", "n_pii", "pii_kinds", "text")

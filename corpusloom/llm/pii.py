"""Format-preserving pseudonyms.

Personal values are found by pattern, validated (Luhn, octets, calendar, mod 97, area rules) and permuted by a keyed
Feistel network inside the set of valid values of their own format, so the output has the same form and passes the same validation, and equal values
get equal pseudonyms in every document. A value x of a domain of size M goes to P^-1(P(x) + c mod M), with P the Feistel
permutation and c a key-derived shift that is not 0: a keyed permutation under which no value stays as it is.
Values that fail validation are not personal data and stay. So do kinds that are not looked for: names, street addresses, bare runs of digits
that are no card number (a ten-digit phone number without + or separators among them), and passwords.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

KEY = b"corpusloom demonstration key: replace in production"
ROUNDS = 10


class Feistel:
    """A keyed permutation of range(size): an unbalanced Feistel network over a x b >= size, with cycle walking."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.a = isqrt(max(size - 1, 0)) + 1
        self.b = -(-size // self.a)
        self.key = hashlib.blake2b(tweak.encode() + size.to_bytes(64, "big"), key=key[:64], digest_size=32).digest()
        self.shift = 1 + int.from_bytes(self._hash(b"shift"), "big") % (size - 1) if size > 1 else 0

    def _hash(self, data: bytes) -> bytes:
        return hashlib.blake2b(data, key=self.key, digest_size=48).digest()

    def _f(self, i: int, v: int, m: int) -> int:
        return int.from_bytes(self._hash(bytes([i]) + v.to_bytes(40, "big")), "big") % m

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(0, ROUNDS, 2):
            left = (left + self._f(i, right, self.a)) % self.a
            right = (right + self._f(i + 1, left, self.b)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS - 2, -1, -2):
            right = (right - self._f(i + 1, left, self.b)) % self.b
            left = (left - self._f(i, right, self.a)) % self.a
        return left * self.b + right

    def permute(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def unpermute(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x

    def encrypt(self, x: int) -> int:
        return self.unpermute((self.permute(x) + self.shift) % self.size)

    def decrypt(self, x: int) -> int:
        return self.unpermute((self.permute(x) - self.shift) % self.size)


@lru_cache(4096)
def feistel(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def refill(shape: str, symbols: str) -> str:
    """Put the symbols where shape has letters or digits, in their order."""
    it = iter(symbols)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in shape)


def _radix(chars: str, hexa: bool = False) -> tuple[int, int]:
    """Value and size of a string of ASCII letters and digits, each position within its own class."""
    value, size = 0, 1
    for c in chars.lower():
        base, v = (16, int(c, 16)) if hexa else (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - 97)
        value, size = value * base + v, size * base
    return value, size


def _unradix(value: int, like: str, hexa: bool = False) -> str:
    out = []
    for c in reversed(like):
        base = 16 if hexa else 10 if c.isdigit() else 26
        value, v = divmod(value, base)
        x = "0123456789abcdef"[v] if hexa else str(v) if c.isdigit() else chr(97 + v)
        out.append(x.upper() if (like.isupper() if hexa else c.isupper()) else x)
    return "".join(reversed(out))


PIECE = 64  # letters and digits that are permuted together; longer values go in pieces


def _string(s: str, kind: str, key: bytes, back: bool, hexa: bool = False) -> str:
    """ASCII letters and digits permuted position by position, each within its class; other characters stay."""
    body, out = "".join(c for c in s if c.isascii() and c.isalnum()), []
    for i in range(0, len(body), PIECE):
        part = body[i : i + PIECE]
        value, size = _radix(part, hexa)
        shape = "".join("x" if hexa else "0" if c.isdigit() else "a" for c in part)
        f = feistel(key, f"{kind}:{shape}" + (f":{i}" if i else ""), size)
        out.append(_unradix(f.decrypt(value) if back else f.encrypt(value), part, hexa))
    return refill(s, "".join(out))


def email(s: str, key: bytes, back: bool) -> str:
    """Everything but the last label is permuted, position by position within letters and digits."""
    head, _, tld = s.rpartition(".")
    return _string(head, "email", key, back) + "." + tld


def card(s: str, key: bytes, back: bool) -> str | None:
    """13 to 19 digits that pass Luhn: the first digit stays, the check digit is made anew."""
    d = "".join(c for c in s if c.isdigit())
    if not 13 <= len(d) <= 19 or luhn_sum(d) or len(set(d)) == 1:
        return None
    body = d[1:-1]
    f = feistel(key, f"card:{len(d)}:{d[0]}", 10 ** len(body))
    x = f.decrypt(int(body)) if back else f.encrypt(int(body))
    new = d[0] + str(x).zfill(len(body))
    return refill(s, new + str(-luhn_sum(new + "0") % 10))


def ipv4(s: str, key: bytes, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    f = feistel(key, "ipv4", 1 << 32)
    return ".".join(map(str, (f.decrypt(value) if back else f.encrypt(value)).to_bytes(4, "big")))


def ipv6(s: str, key: bytes, back: bool) -> str | None:
    """Its hexadecimal digits, in the groups that they are in."""
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return None
    return _string(s, "ipv6", key, back, hexa=True) if sum(c != ":" for c in s) > 2 else None


def phone(s: str, key: bytes, back: bool) -> str | None:
    """Digits after the country code; +1 and formatted ten-digit numbers, or + and 7 to 15 digits."""
    m = re.match(r"\+1(?=[\s.(-]|\d{10}$)|\+\d{2}(?=[\s.(-])|\+\d|", s)
    head, rest = s[: m.end()], s[m.end() :]
    digits = "".join(c for c in rest if c.isdigit())
    if not 6 <= len(digits) <= 14:
        return None
    return head + _string(rest, f"phone{head}", key, back)


def ssn(s: str, key: bytes, back: bool) -> str | None:
    a, g, n = (int(s[:3]), int(s[4:6]), int(s[7:]))
    if a in (0, 666) or a >= 900 or g == 0 or n == 0:
        return None
    f = feistel(key, "ssn", 898 * 99 * 9999)
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1
    x = f.decrypt(x) if back else f.encrypt(x)
    x, n = divmod(x, 9999)
    a, g = divmod(x, 99)
    a += 1
    return f"{a + (a >= 666):03d}{s[3]}{g + 1:02d}{s[6]}{n + 1:04d}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(s: str, key: bytes, back: bool) -> str | None:
    d = s.replace(" ", "")
    if not 15 <= len(d) <= 34 or _mod97(d[4:] + d[:4]) != 1:
        return None
    body = _string(d[4:], f"iban{d[:2]}", key, back)
    return refill(s, f"{d[:2]}{98 - _mod97(body + d[:2] + '00'):02d}{body}")


FIRST, LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
MONTHS = "January February March April May June July August September October November December".split()


def _date(y: int, m: int, d: int) -> int | None:
    try:
        x = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    return x if FIRST <= x <= LAST else None


SHORT_MONTHS = [m[:3] for m in MONTHS]
NEAR, FAR = dt.date(1970, 1, 1).toordinal(), dt.date(2069, 12, 31).toordinal()  # what two digits of a year stand for


def date(s: str, key: bytes, back: bool) -> str | None:
    """A day of 1900 to 2099 (with two digits of the year, 1970 to 2069) in any of the formats; day first, or month first where only that is a date."""

    def moved(x: int, first: int, last: int) -> dt.date:
        f = feistel(key, "date" if first == FIRST else "date2", last - first + 1)
        return dt.date.fromordinal(first + (f.decrypt(x - first) if back else f.encrypt(x - first)))

    if m := re.fullmatch(r"(\d{4})([-/.])(\d\d)\2(\d\d)", s):
        if (x := _date(int(m[1]), int(m[3]), int(m[4]))) is None:
            return None
        n = moved(x, FIRST, LAST)
        return f"{n.year}{m[2]}{n.month:02d}{m[2]}{n.day:02d}"
    if m := re.fullmatch(r"(\d{2})([-/.])(\d{2})\2(\d{4}|\d\d)", s):
        short = len(m[4]) == 2
        a, b, y = int(m[1]), int(m[3]), int(m[4]) + (0 if not short else 1900 if int(m[4]) >= 70 else 2000)
        day_first = _date(y, b, a)
        x = day_first or _date(y, a, b)
        if x is None:
            return None
        n = moved(x, *((NEAR, FAR) if short else (FIRST, LAST)))
        # the month stays in front only if that reads the same way again
        first, second = (n.day, n.month) if day_first or n.day <= 12 else (n.month, n.day)
        return f"{first:02d}{m[2]}{second:02d}{m[2]}" + (f"{n.year % 100:02d}" if short else str(n.year))
    if m := re.fullmatch(r"(?:(\d{1,2}) )?([A-Z][a-z]+)(?: (\d{1,2}),)? (\d{4})", s):
        names = MONTHS if m[2] in MONTHS else SHORT_MONTHS
        if m[2] not in names or (m[1] is None) == (m[3] is None) or (x := _date(int(m[4]), names.index(m[2]) + 1, int(m[1] or m[3]))) is None:
            return None
        n = moved(x, FIRST, LAST)
        # May is long and short and counts as long, so that the way back from it does not tell which the value was
        name = names[n.month - 1]
        return f"{n.day} {name} {n.year}" if m[1] else f"{name} {n.day}, {n.year}"
    return None


def token(s: str, key: bytes, back: bool) -> str:
    """An access key: what follows its known beginning."""
    head = re.match(ISSUED, s)[0]
    return head + _string(s[len(head) :], f"token{head}", key, back)


def secret(s: str, key: bytes, back: bool) -> str:
    return _string(s, "hex", key, back, hexa=True)


BEGIN = "sk- ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ xoxa- xoxb- xoxp- xoxr- xoxs- AKIA ASIA AIza glpat-".split()  # of issued keys
ISSUED = "|".join(BEGIN)
_MONTH = "(?:" + "|".join([*MONTHS, *SHORT_MONTHS]) + ")"
_NUM, _END = r"(?<![\w.])", r"(?![\w]|\.\d)"
PATTERN = re.compile(
    r"(?P<email>(?<![^\W_])[^\W_](?:[\w.%+-]{0,255})@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    rf"|(?P<token>(?<![\w-])(?:{ISSUED})[A-Za-z0-9_-]{{16,}}(?![\w-]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    rf"|(?P<ipv4>{_NUM}\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_END})"
    r"|(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))"
    rf"|(?P<date>{_NUM}(?:\d{{4}}(?P<d1>[-/.])\d\d(?P=d1)\d\d|\d\d(?P<d2>[-/.])\d\d(?P=d2)\d{{4}}|(?<!/)\d\d/\d\d/\d\d){_END}(?!/)|\b{_MONTH} \d{{1,2}}, \d{{4}}\b|(?<![\w.])\d{{1,2}} {_MONTH} \d{{4}}\b)"
    r"|(?P<ssn>(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?<=[\"'=: ])(?P<secret>[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"
)
HAS = re.compile("[0-9@]|::|[A-Fa-f]:[A-Fa-f]{1,4}:|[a-f]{32}|[A-F]{32}|" + ISSUED)
KINDS = {"email": email, "token": token, "ipv6": ipv6, "iban": iban, "ipv4": ipv4, "date": date, "ssn": ssn, "phone": phone, "card": card, "secret": secret}


_CARD = re.compile(r"\d(?:[ -]?\d){12,18}")
_PHONE = re.compile(r"\+[\d ().-]{6,}\d|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}")


def _value(m: re.Match, key: bytes, back: bool) -> tuple[str, int, str] | None:
    """(pseudonym, end, kind) of a match. A phone or card may have run into a number after it: then the longest valid part up to a separator counts."""
    kind, text = m.lastgroup, m[0]
    new = KINDS[kind](text, key, back)
    if new is not None:
        return new, m.end(), kind
    if kind not in ("phone", "card", "ssn"):
        return (new, m.end(), "card") if _CARD.fullmatch(text) and (new := card(text, key, back)) is not None else None
    for end in [len(text), *(i for i in range(len(text) - 1, 0, -1) if text[i] in " .-")]:
        part = text[:end]
        for other, form in (("phone", _PHONE), ("card", _CARD)):
            if form.fullmatch(part) and (new := KINDS[other](part, key, back)) is not None:
                return new, m.start() + end, other
    return None


def rewrite(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its personal values permuted, and how many of each kind there were."""
    found: dict[str, int] = {}

    def rewritten(line: str) -> str:
        out, last, pos = [], 0, 0
        while m := PATTERN.search(line, pos):
            got = _value(m, key, back)
            if got is None:
                # its last group may begin the next value
                cut = max(m[0].rfind(c) for c in " -")
                pos = m.start() + cut + 1 if cut > 0 and m.lastgroup in ("phone", "card") else m.end()
                continue
            new, end, kind = got
            found[kind] = found.get(kind, 0) + 1
            out += [line[last : m.start()], new]
            last = pos = end
        return "".join(out) + line[last:] if out else line

    # no value spans lines, so lines without a digit, an at sign or another mark of a value are left alone
    return "\n".join(rewritten(line) if HAS.search(line) else line for line in text.split("\n")), found


RESULT = "struct<text:string,found:map<string,int>>"


def pseudonymizer(spark: SparkSession, key: bytes = KEY):
    """A function of a text column: struct(text, found), null where nothing can be found.

    Only texts with a digit, an at sign or another mark of a value cross to Python; of the others nothing can match.
    """
    ship(spark)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
            else:
                new, found = rewrite(t, key)
                out.append({"text": new, "found": list(found.items())} if found else None)
        return pa.array(out, pa.struct([("text", pa.string()), ("found", pa.map_(pa.string(), pa.int32()))]))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    f = F.arrow_udf(run, RESULT)

    def of(text: Column) -> Column:
        # the tests go from the cheap and likely to the dear and rare
        marked = text.rlike("[0-9@]") | text.contains("::")
        for x in BEGIN:
            marked = marked | text.contains(x)
        return f(F.when(marked | text.rlike("[a-f]{32}|[A-F]{32}|[A-Fa-f]:[A-Fa-f]{1,4}:"), text))

    return of


def found_values(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, the rewritten text and the number of values of each kind, of every row that has any.

    Rows with a null or empty text, or without personal values, give no row. Repeated rows are rewritten alike; texts
    are read whole; other columns are ignored; an empty table gives an empty result.
    """
    p = docs.select("doc_id", pseudonymizer(docs.sparkSession, key)(F.col("text")).alias("p")).where("p is not null")
    n = F.aggregate(F.map_values("p.found"), F.lit(0), lambda a, x: a + x)
    return p.select("doc_id", F.col("p.text").alias("text"), n.alias("n_values"), F.array_join(F.array_sort(F.map_keys("p.found")), ",").alias("kinds"))


def pseudonymized(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Every row, with its columns and their order; text is rewritten and n_chars, if it is there, is its length.

    Null and empty texts, and those without personal values, stay as they are; repeated rows are rewritten alike; whole texts are read; an empty
    table stays empty.
    """
    p = docs.withColumn("__loom_pii", pseudonymizer(docs.sparkSession, key)(F.col("text")))
    new = F.coalesce(F.col("__loom_pii.text"), F.col("text"))
    cols = [new.alias(c) if c == "text" else F.when(F.col("__loom_pii").isNull(), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return p.select(*cols)

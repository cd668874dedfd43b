"""Format-preserving pseudonyms by a keyed Feistel permutation.

A value that passes its format's validation (Luhn, octets, calendar, check digits) becomes a number below the size of
its format, is permuted there and written back in the same shape. The permutation depends on key and format alone, so
equal values get equal pseudonyms in every document, and with the key they can be turned back.

The key is the caller's; there is no default, for who knows the key can turn every pseudonym back.

Defined cases: null text stays null with no spans, empty text stays empty, an empty table gives an empty result; a very
long text is searched whole; every row is rewritten by itself, repeated rows each, a null doc_id stays null; all other
columns are dropped, whatever their names; values that fail their validation stay as they are; of two kinds that claim
the same place the first of ``KINDS`` has it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from .common import bound_batches

ROUNDS = 8
KINDS = ("email", "iban", "card", "ip", "date", "ssn", "phone")
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2100, 1, 1).toordinal() - FIRST_DAY


def _halves(size: int) -> int:
    return max(1, (max(size - 1, 1).bit_length() + 1) // 2)


def _round(key: bytes, tweak: bytes, i: int, x: int, bits: int) -> int:
    n = (bits + 7) // 8
    h = hashlib.shake_256(b"%d:%s%d:%s:%d:" % (len(key), key, len(tweak), tweak, i) + x.to_bytes(n, "big"))
    return int.from_bytes(h.digest(n), "big") & ((1 << bits) - 1)


def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it lands inside."""
    bits = _halves(size)
    low = (1 << bits) - 1
    while True:
        a, b = x >> bits, x & low
        if not back:
            for i in range(ROUNDS):
                a, b = b, a ^ _round(key, tweak, i, b, bits)
        else:
            for i in reversed(range(ROUNDS)):
                a, b = b ^ _round(key, tweak, i, a, bits), a
        x = a << bits | b
        if x < size:
            return x


def permute_text(s: str, key: bytes, tweak: bytes, back: bool = False) -> str:
    """Digits for digits, letters for letters of the same case; everything else stays."""
    sets = [next((z for z in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if ch in z), "") for ch in s]
    size = value = 0
    for ch, z in zip(s, sets, strict=True):
        if z:
            value, size = value * len(z) + z.index(ch), (size or 1) * len(z)
    if not size:
        return s
    value = permute(value, size, key, tweak + b"/%d" % size, back)
    out = []
    for ch, z in zip(reversed(s), reversed(sets), strict=True):
        if z:
            value, r = divmod(value, len(z))
            ch = z[r]
        out.append(ch)
    return "".join(reversed(out))


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = permute_text(d[:-1], key, b"card", back)
    return _refill(s, body + luhn_digit(body))


def _ip(s: str, key: bytes, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, key, b"ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(s: str, key: bytes, back: bool) -> str | None:
    sep = "-" if "-" in s else "/" if "/" in s else "."
    a, b, c = s.split(sep)
    order = "ymd" if len(a) == 4 else "dmy"
    for shape in ((order,) if order == "ymd" else ("dmy", "mdy")):
        f = dict(zip(shape, (int(a), int(b), int(c)), strict=True))
        try:
            n = dt.date(f["y"], f["m"], f["d"]).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= n < DAYS:
            return None
        # days after the 12th stay so: a date reads as the same shape afterwards, and is linked whatever its shape
        late, day = f["d"] > 12, None
        while day is None or (day.day > 12) != late:
            n = permute(n, DAYS, key, b"date", back)
            day = dt.date.fromordinal(FIRST_DAY + n)
        got = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
        return sep.join(got[k] for k in shape)
    return None


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    area, group, serial = s.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    n = int(area)
    x = ((n - 1 - (n > 666)) * 99 + int(group) - 1) * 9999 + int(serial) - 1  # 898 areas
    x = permute(x, 898 * 99 * 9999, key, b"ssn", back)
    x, e = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{e + 1:04d}"


def _phone(s: str, key: bytes, back: bool) -> str | None:
    d = _digits(s)
    if not 7 <= len(d) <= 15:
        return None
    national = d[-10:] if len(d) >= 10 else d
    return _refill(s, d[: len(d) - len(national)] + permute_text(national, key, b"phone", back))


def _email(s: str, key: bytes, back: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    return f"{permute_text(local, key, b'email:' + domain.lower().encode(), back)}@{domain}"


def _iban(s: str, key: bytes, back: bool) -> str | None:
    number = lambda head, rest: int("".join(str(int(c, 36)) for c in rest + head))
    t = s.replace(" ", "")
    if not 15 <= len(t) <= 34 or number(t[:4], t[4:]) % 97 != 1:
        return None
    rest = permute_text(t[4:], key, b"iban:" + t[:2].encode(), back)
    it = iter(t[:2] + f"{98 - number(t[:2] + '00', rest) % 97:02d}" + rest)
    return "".join(c if c == " " else next(it) for c in s)


PATTERNS: dict[str, tuple[re.Pattern[str], Callable[[str, bytes, bool], str | None]]] = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), _email),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?!\w)"), _iban),
    "card": (re.compile(r"(?<!\w)[0-9](?:[ -]?[0-9]){12,}(?!\w)"), _card),
    "ip": (re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"), _ip),
    "date": (re.compile(r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![\w/-]|\.[0-9])"), _date),
    "ssn": (re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _ssn),
    "phone": (re.compile(r"(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?!\w|[.-][0-9])|(?<![\w.+])\+[0-9]{8,15}(?!\w)"), _phone),
}
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9]+")
#: Group lengths in which cards are printed, and how issued numbers begin.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (4, 4, 4, 4, 3), (6, 13), *((n,) for n in range(13, 20))}
_ISSUED = re.compile("[3-6]|2(?:2[2-9]|[3-6]|7[0-2])")


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of one value, or None if it fails its validation."""
    return PATTERNS[kind][1](value, key, back)


def _cards(text: str, lo: int, hi: int, free: Callable[[int, int], bool], key: bytes, back: bool) -> list[tuple[int, int, str, str]]:
    """Cards of a run of digit groups, which may hold other numbers too: every group may begin one and every group end one.

    About a tenth of all digit strings pass Luhn's test, so of overlapping cards the one in printed groups and with an
    issuer's first digits wins, then the one in printed groups, then the leftmost and longest.
    """
    groups = [m.span() for m in _GROUP.finditer(text, lo, hi)]
    found = []
    for i, (start, _) in enumerate(groups):
        lengths: tuple[int, ...] = ()
        for a, end in groups[i : i + 19]:
            lengths += (end - a,)
            n = sum(lengths)
            if n > 19:
                break
            if n >= 13 and (new := pseudonym("card", text[start:end], key, back)) is not None and free(start, end):
                printed = lengths in CARD_GROUPS and len(set(re.sub("[0-9]", "", text[start:end]))) < 2
                found.append((0 if printed and _ISSUED.match(text, start) else 1 if printed else 2, start, -end, new))
    found.sort()
    taken: set[int] = set()
    out = []
    for _, start, end, new in found:
        places = range(start, -end)
        if taken.isdisjoint(places):
            taken.update(places)
            out.append((start, -end, "card", new))
    return out


def _ibans(text: str, pattern: re.Pattern[str], key: bytes, back: bool) -> Iterator[tuple[int, int, str, str]]:
    """IBANs in one piece or in groups; what follows the last group, or goes before the first, may look like a group."""
    m = pattern.search(text)
    while m:
        value = m[0]
        new = pseudonym("iban", value, key, back)
        while new is None and " " in value:
            value = value.rpartition(" ")[0]
            new = pseudonym("iban", value, key, back)
        if new is not None:
            yield m.start(), m.start() + len(value), "iban", new
        m = pattern.search(text, m.start() + len(value))


def rewrite(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was found, in code points of the original."""
    spans: list[tuple[int, int, str, str]] = []
    digits = _DIGIT.search(text) is not None
    free = lambda a, b: all(b <= s[0] or s[1] <= a for s in spans)
    for kind, (pattern, _) in PATTERNS.items():
        if kind == "email" and "@" not in text or kind != "email" and not digits:
            continue
        if kind == "card":
            own = [x for m in pattern.finditer(text) for x in _cards(text, *m.span(), free, key, back)]
        elif kind == "iban":
            own = list(_ibans(text, pattern, key, back))
        else:
            own = [(*m.span(), kind, new) for m in pattern.finditer(text) if (new := pseudonym(kind, m[0], key, back)) is not None]
        spans += [x for x in own if not spans or free(x[0], x[1])]
    spans.sort()
    out, at = [], 0
    for start, end, _, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:], [(kind, start, end) for start, end, kind, _ in spans]


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (rewritten), n_<kind> for every kind, spans (kind:start:end of the original, comma-joined)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                new, spans = rewrite(text, key) if text else (text, [])
                rows.append((new, *(sum(s[0] == k for s in spans) for k in KINDS), ",".join(f"{k}:{a}:{b}" for k, a, b in spans)))
            out = pd.DataFrame(rows, columns=["text", *(f"n_{k}" for k in KINDS), "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string")

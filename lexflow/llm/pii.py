"""Personal data under format-preserving pseudonyms.

Candidates found by patterns are validated (checksums, ranges, calendar) and then permuted within their own
format by a keyed Feistel network over their digits or letters: a number of n digits becomes another of
n digits with the same separators and a right checksum, a date another date, an address another address.
The permutation depends on key, kind and value only, not on how the value is written: phone numbers are permuted
behind their country's code whatever their groups, and days whatever the order of their parts. So equal values
get equal pseudonyms in all documents, and who has the key can invert it. Texts without a candidate pass through untouched.

Patterns take as much as they can, so a match may be a value with its neighbour. Where matches meet, every
start, kind and end at a separator is tried, and of the valid spans those are taken that together cover most.
Patterns look no further than a bound from each place where one may begin, so time is linear in a text's length; an
address's name has at most 256 characters.
"""

import hashlib
import hmac
import re
from bisect import bisect_right
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lexflow.llm.arrow_text import task

#: The session's setting that holds the secret key.
SETTING = "spark.lexflow.pii.key"
ROUNDS = 10

#: Country codes of one and two digits; all others have three. Fixed values.
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

#: One pattern a kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,255}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d-])",
    "phone": r"(?<![\w+])\+\d(?:(?: ?\(|\)[ .-]?|[ .-])?\d){6,14}(?!\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
}
FINDER = "|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items())
#: What every candidate has; texts without it need no search (RE2 syntax, in Arrow).
SCREEN = r"@|\d{3}|[0-9a-fA-F]{32}|\d\.\d+\.\d|\d[ -]\d|\d\d/\d"
KINDS = tuple(PATTERNS)
EACH = {k: re.compile(v) for k, v in PATTERNS.items()}
#: Where a value may begin behind the start of another match, and what may end a shorter span of a match.
START = re.compile(r"(?<![0-9A-Za-z])[\w+]|(?<=[^\W\d])\d")
ENDS = {"iban": re.compile(" "), "phone": re.compile("[ .-]"), "card": re.compile("[ -]")}

#: Days that dates are permuted among.
FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)


def feistel(key: bytes, kind: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of 0 to size - 1: an alternating Feistel network, walked until it is in range again."""
    if size < 2:
        return value
    a = max(2, int(size**0.5))
    while a * a < size:
        a += 1
    b = -(-size // a)

    def f(r: int, x: int) -> int:
        return int.from_bytes(hmac.digest(key, f"{kind}|{size}|{r}|{x}".encode(), hashlib.sha256)[:16], "big")

    while True:
        hi, lo = divmod(value, b)  # hi below a, lo below b
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if r % 2:
                hi = (hi + (-1 if back else 1) * f(r, lo)) % a
            else:
                lo = (lo + (-1 if back else 1) * f(r, hi)) % b
        value = hi * b + lo
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that belongs behind digits."""
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _symbols(key: bytes, kind: str, text: str, back: bool) -> str:
    """Digits and letters of text permuted together, each within its own class (digit, lower, upper, hex apart)."""
    bases = [(10, "0") if c in "0123456789" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c) for c in text]
    value, size = 0, 1
    for (n, first), c in zip(bases, text, strict=True):
        value, size = value * n + (ord(c) - ord(first) if n > 1 else 0), size * n
    value, out = feistel(key, kind, value, size, back), []
    for n, first in reversed(bases):
        value, d = divmod(value, n)
        out.append(chr(ord(first) + d) if n > 1 else first)
    return "".join(reversed(out))


def _refill(shape: str, chars: str) -> str:
    """shape with its letters and digits replaced by chars, in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _digits(key: bytes, kind: str, text: str, back: bool) -> str:
    return f"{feistel(key, kind, int(text), 10 ** len(text), back):0{len(text)}d}" if text else text


def _card(key, text, back):
    d = re.sub(r"\D", "", text)
    if luhn(d[:-1]) != int(d[-1]):
        return None
    body = _digits(key, "card", d[:-1], back)
    return _refill(text, body + str(luhn(body)))


def _long_number(key, text, back):
    """A run of 13 to 19 digits whose checksum is wrong: permuted among those with a wrong checksum, step by step."""
    d = re.sub(r"\D", "", text)
    while True:
        d = _digits(key, "number", d, back)
        if luhn(d[:-1]) != int(d[-1]):
            return _refill(text, d)


def _iban(key, text, back):
    s = re.sub(r"\s", "", text)
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _symbols(key, "iban" + s[:2], s[4:], back)
    return _refill(text, f"{s[:2]}{98 - number(body + s[:2] + '00') % 97:02d}{body}")


def _date(key, text, back):
    parts = [int(x) for x in re.split(r"\D", text)]
    y, m, d = parts if len(text.split("-")) == 3 else parts[::-1]
    flip = "/" in text and m > 12  # month first
    try:
        day = date(y, d, m) if flip else date(y, m, d)
    except ValueError:
        return None
    if not FIRST <= day <= LAST:
        return None
    spans, at = (LAST - FIRST).days + 1, (day - FIRST).days
    while True:  # days that show whether the month is first stay among themselves, in all notations
        at = feistel(key, "date", at, spans, back)
        new = FIRST + timedelta(at)
        if (new.day > 12) == (day.day > 12):
            break
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    if "-" in text:
        return f"{y}-{m}-{d}"
    sep = text[2]
    return sep.join([m, d, y] if flip else [d, m, y])


def _ipv4(key, text, back):
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = feistel(key, "ipv4", int.from_bytes(bytes(parts), "big"), 1 << 32, back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _phone(key, text, back):
    trunk = re.match(r"\+\d{1,3} ?(\(0\))", text)  # a zero that is only dialled within the country
    d = re.sub(r"\D", "", text if trunk is None else text[: trunk.start(1)] + text[trunk.end(1) :])
    code = next((d[:n] for n in (1, 2) if d[:n] in CODES), d[:3])
    own = d[len(code) :]
    if not 6 <= len(own) or len(d) > 15 or code[0] == "0":
        return None
    new = code + _digits(key, "phone" + code, own, back)
    if trunk is None:
        return _refill(text, new)
    shape = text[: trunk.start(1)] + text[trunk.end(1) :]
    out = _refill(shape, new)
    return out[: trunk.start(1)] + "(0)" + out[trunk.start(1) :]


def _ssn(key, text, back):
    area, group, serial = text.split("-")
    right = lambda a, g, s: a not in ("000", "666") and a[0] != "9" and g != "00" and s != "0000"
    if not right(area, group, serial):
        return None
    while True:
        d = _digits(key, "ssn", area + group + serial, back)
        area, group, serial = d[:3], d[3:5], d[5:]
        if right(area, group, serial):
            return f"{area}-{group}-{serial}"


def _secret(key, text, back):
    upper = text.isupper()
    n = len(text)
    return f"{feistel(key, 'secret', int(text, 16), 16**n, back):0{n}{'X' if upper else 'x'}}"


def _email(key, text, back):
    name, _, domain = text.partition("@")
    return f"{_symbols(key, 'email', name, back)}@{domain}"


_RULES = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "phone": _phone, "card": _card, "ssn": _ssn, "ipv4": _ipv4}


def pseudonym(kind: str, text: str, key: bytes, back: bool = False, any_number: bool = True) -> str | None:
    """The pseudonym of a candidate, or what it stands for with back; None if the candidate isn't valid."""
    found = _RULES[kind](key, text, back)
    if found is None and kind == "card" and any_number and re.fullmatch(r"\d{13,19}", text):
        return _long_number(key, text, back)
    return found


def protect(text: str, key: bytes, *, any_number: bool = True, known: dict | None = None, finder=re.compile(FINDER)) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms and how many of each kind were put in."""
    counts: dict[str, int] = {}
    parts, done, m = [], 0, finder.search(text)

    def new_of(kind: str, own: str) -> str | None:
        if known is None:
            return pseudonym(kind, own, key, any_number=any_number)
        if (kind, own) not in known:
            new = pseudonym(kind, own, key, any_number=any_number)
            if len(known) >= 100_000:
                return new
            known[kind, own] = new
        return known[kind, own]

    while m:
        found, reach = _valid_spans(text, m.start(), new_of)
        for at, to, kind, new in _widest(found):
            parts += [text[done:at], new]
            done = to
            counts[kind] = counts.get(kind, 0) + 1
        m = finder.search(text, reach)
    return "".join(parts) + text[done:], counts


def _valid_spans(text: str, at: int, new_of) -> tuple[list[tuple[int, int, str, str]], int]:
    """Valid spans (start, end, kind, pseudonym) of the matches from at on that meet one another, and where these end."""
    found, reach, mail = {}, at + 1, at
    while True:
        for kind, pattern in EACH.items():
            if kind == "email" and at < mail or not (m := pattern.match(text, at)):
                continue
            to = m.end()
            reach = max(reach, to)
            mail = to if kind == "email" else mail
            shorter = [e.start() for e in ENDS[kind].finditer(text, at, to)] if kind in ENDS else []
            for end in [to, *reversed(shorter)]:
                if (end == to or pattern.fullmatch(text, at, end)) and (at, end) not in found and (new := new_of(kind, text[at:end])) is not None:
                    found[at, end] = (kind, new)
        m = START.search(text, at + 1, reach)
        if not m:
            return [(a, b, *x) for (a, b), x in found.items()], reach
        at = m.start()


def _widest(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Spans that don't overlap and cover most characters together, in few pieces."""
    if len(spans) < 2:
        return spans
    spans = sorted(spans, key=lambda x: (x[1], x[0]))
    ends, best = [x[1] for x in spans], [(0, 0, -1, 0)]  # covered, less pieces, last span, what is before it
    for k, (at, to, _, _) in enumerate(spans):
        before = bisect_right(ends, at, 0, k)
        with_it = (best[before][0] + to - at, best[before][1] - 1, k, before)
        best.append(max(best[-1], with_it, key=lambda x: x[:2]))
    out, now = [], best[-1]
    while now[2] >= 0:
        out.append(spans[now[2]])
        now = best[now[3]]
    return out[::-1]


def key_of(spark: SparkSession, otherwise: bytes | None = None) -> bytes:
    """The session's key; without one, and without another to use in its place, an error."""
    key = spark.conf.get(SETTING, None)
    if not key and otherwise is None:
        raise ValueError(f"{SETTING} isn't set")
    return key.encode() if key else otherwise


def _task(key: bytes, any_number: bool, at: int, counted: bool):
    @task
    def run(batches):
        finder, known = re.compile(FINDER), {}
        for batch in batches:
            texts = batch.column(at)
            hits = pc.fill_null(pc.match_substring_regex(texts, SCREEN), False).to_numpy(zero_copy_only=False).nonzero()[0]
            n, new, counts = len(texts), {}, {}
            for i in hits.tolist():
                text, found = protect(texts[i].as_py(), key, any_number=any_number, known=known, finder=finder)
                if found:
                    new[i], counts[i] = text, found
            if new:
                mask = pa.array([i in new for i in range(n)])
                texts = pc.replace_with_mask(texts, mask, pa.array(list(new.values()), texts.type))
            columns = [*batch.columns[:at], texts, *batch.columns[at + 1 :]]
            names = list(batch.schema.names)
            if counted:
                columns += [pa.array([counts.get(i, {}).get(k, 0) for i in range(n)], pa.int64()) for k in KINDS]
                names += [f"n_{k}" for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pseudonymised(docs: DataFrame, *, key: bytes, any_number: bool = True) -> DataFrame:
    """docs with pseudonyms in text; its rows, columns and their order stay.

    Defined cases: null and empty texts stay; a candidate that fails its validation stays, but any_number
    permutes plain runs of 13 to 19 digits with a wrong checksum too; repeated rows get the same text; no
    rows give no rows. Columns of any name are carried along.
    """
    return docs.mapInArrow(_task(key, any_number, docs.columns.index("text"), False), docs.schema)


def pii_report(docs: DataFrame, *, key: bytes, any_number: bool = True) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind> of each row of docs."""
    own = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return own.mapInArrow(_task(key, any_number, 1, True), schema)

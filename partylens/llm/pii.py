"""Operator 5: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the lower-cased text: at-signs, schemes, colons,
identifier cues (password, token, iban, tel, street, ...), prefixes of access keys, and pairs of digits or digit
and dot, which every number has. At an anchor a deterministic parser expands to the boundaries on both sides and
validates what it finds:

email      local@domain: letters of any alphabet, digits and marks, up to 64; labels of letters, digits and
           hyphens, and a letters-only last label. Scripts that are written without blanks end a local part
url        a URL with credentials before its host, to the end of its path
ipv4       four numbers of up to 255, not part of a longer run of digits and dots
ipv6       a valid address of three groups or more
phone      an international number: + and 8 to 15 digits with single separators or one bracketed group; a national
           one as (ddd) ddd-dddd or ddd-ddd-dddd, or 6 to 15 digits after tel, phone, mobile, cell or fax
address    a house number, one to four capitalised words and a word like Street, or Straße with the number behind
account    a digit run of 12 to 19 (single blanks or hyphens allowed between groups of 4 or more): card,
           if the Luhn sum holds, else account, unless it reads as a time (milliseconds or yyyymmddhhmm[ss]); an
           IBAN whose check digits hold. Of a longer stretch of groups all boundaries are tried, those of a card
           first, then the longest. After account, acct, routing or iban a number of 6 to 19 digits
ssn        ddd-dd-dddd outside of the ranges never issued
secret     the value after password, token, api key, access key or secret and = or :, 6 characters or more; a token
           of 16 or more after bearer; access keys known by their prefix; a private key block

Spans are as long as what they hold: no value is cut at a length. They don't overlap: of two, the one that begins
first stays, then the longer. Places are in characters. Time is linear in the text: an anchor inside of a value
that was taken isn't expanded again.
Defined results: null and empty texts hold nothing. Repeated rows are each reported. Values that stand
twice in a text are two findings. Other columns are ignored.
"""

from __future__ import annotations

import functools
import ipaddress
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partylens.llm.base import find_texts, table

CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "api key", "access_key", "access key", "access-key", "accesskey")
ACCOUNT_CUES = ("account", "acct", "routing", "iban")
PHONE_CUES = ("tel", "phone", "mobile", "cell", "fax")
STREET_CUES = ("street", " st", "avenue", " ave", "road", " rd", "boulevard", "blvd", "lane", "drive", "square", " court", "straße", "strasse")
#: Prefixes of access keys, and what follows them.
KEY_PREFIXES = {
    "akia": r"AKIA[0-9A-Z]{16}", "asia": r"ASIA[0-9A-Z]{16}", "ghp_": r"ghp_[A-Za-z0-9]{36,}", "gho_": r"gho_[A-Za-z0-9]{36,}", "ghs_": r"ghs_[A-Za-z0-9]{36,}", "github_pat_": r"github_pat_\w{22,}",
    "xoxb-": r"xoxb-[A-Za-z0-9-]{10,}", "xoxp-": r"xoxp-[A-Za-z0-9-]{10,}", "sk_live_": r"sk_live_[A-Za-z0-9]{16,}", "aiza": r"AIza[A-Za-z0-9_-]{35}",
}
_EDGE = ".%+-'"


def _local(c: str) -> bool:
    """Letters and digits of alphabets, combining marks and what else a local part may hold."""
    return c.isalnum() and ord(c) < 0x0E00 or c in "._%+-" or "\u0300" <= c <= "\u036f"


_WORD = r"[^\W_\u0e00-\U0010ffff]"
_TOP = re.compile(rf"(?:{_WORD}(?:(?:{_WORD}|-){{0,61}}{_WORD})?\.)+[^\W\d_\u0e00-\U0010ffff]{{2,24}}(?!{_WORD}|@)")
_NUMBER = frozenset("0123456789. -()+")
_IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
_NATIONAL = re.compile(r"(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}([.-]))\d{3}(?(1)\1|[.-])\d{4}(?![\w-]|\.\d)")
_CALLED = re.compile(r"(?<![A-Za-z])(?:tele|cell|mobile|tel)?[ -]?(?:phone|mobile|cell|tel|fax)(?![A-Za-z])(?:[ ._:#-]{0,3}(?:numbers?|num|nos?|nr)(?![A-Za-z]))?[ ._:#=-]{0,4}(\+?\(?\d(?:[ ./()-]{0,2}\d){5,14})(?![\w-]|[ ./-]?\d)", re.I)
_PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\w)")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_DIGITS = re.compile(r"(?<![\w.+-])\d+(?:[ -]\d+)*(?![\w-]|\.\d)")
#: Group lengths of a card number that may stand beside other groups.
_CARD_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))}
_CUED = re.compile(r"(?<![A-Za-z0-9])(?:accounts?|accts?|routing|iban)(?![A-Za-z0-9])(?:[\s._:#=-]{0,3}(?:account|transit|numbers?|num|nos?|nr|code|id|is)(?![A-Za-z0-9])){0,3}[\s._:#='\"(-]{0,4}(\d+(?:[ -]\d+){0,18})(?![\w-]|\.\d)", re.I)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api[ _-]?key|access[ _-]?key)['\"]?\s{0,3}[:=]\s{0,3}['\"]?([^\s'\",;]{6,})", re.I)
_BEARER = re.compile(r"(?<![A-Za-z0-9])bearer[ \t]{1,3}((?=[^\s]*\d)[A-Za-z0-9._~+/-]{16,}=*)", re.I)
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_KEYS = {k: re.compile(rf"(?<![A-Za-z0-9_]){v}(?![A-Za-z0-9_])") for k, v in KEY_PREFIXES.items()}
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_USERINFO = re.compile(r"://[^\s/@:]+:[^\s/]+@[\w.-]+(?::\d{1,5})?(?:[/?#][^\s<>\"']*)?")
_HEX = frozenset("0123456789abcdefABCDEF:.")
_TIME = re.compile(r"1\d{12}|20\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[01]\d|2[0-3])[0-5]\d(?:[0-5]\d)?")
_STREET = re.compile(r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Drive|Square|Court)(?!\w)\.?")
_BEFORE_STREET = re.compile(r"(?<![\w.,-])\d{1,5}[A-Za-z]? (?:(?:[A-Z][\w'-]*|\d{1,3}(?:st|nd|rd|th))\.? ){1,4}\Z")
_STRASSE = re.compile(r"(?<!\w)(?:[^\W\d_]+[- ]?)?[sS]tra(?:ß|ss)e \d{1,4}(?: ?[a-z])?(?!\w)")


@functools.cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("secret", CUES), ("account", ACCOUNT_CUES), ("called", PHONE_CUES), ("street", STREET_CUES), ("key", KEY_PREFIXES), ("bearer", ["bearer"]), ("block", ["-----begin "]), ("email", "@"), ("url", ["://"]), ("colon", ":")):
        for word in words:
            found.add_word(word, (kind, word))
    for a in "0123456789":
        for b in ".0123456789":
            found.add_word(a + b, ("number", a + b))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _email(text: str, at: int) -> tuple | None:
    begin = at
    while begin > 0 and at - begin < 64 and _local(text[begin - 1]):
        begin -= 1
    if begin and _local(text[begin - 1]):
        return None  # longer than an address can be
    while begin < at and text[begin] in _EDGE:
        begin += 1
    edge = min(len(text), at + 256)
    host = _TOP.match(text, at + 1, edge)
    if begin == at or text[at - 1] == "." or not host or host.end() == edge < len(text):
        return None
    return begin, host.end(), "email"


def _ipv6(text: str, at: int) -> tuple[int, int, bool]:
    """The stretch of hexadecimal digits, colons and dots around a colon, and whether it is an address."""
    begin, end = at, at + 1
    while begin > 0 and text[begin - 1] in _HEX:
        begin -= 1
    while end < len(text) and text[end] in _HEX:
        end += 1
    reach = end
    if end - begin > 60:
        return begin, reach, False
    while end > begin and text[end - 1] == "." or text[begin:end].endswith(":") and not text[begin:end].endswith("::"):
        end -= 1
    whole = not (begin and (text[begin - 1].isalnum() or text[begin - 1] in "_-")) and not (end < len(text) and (text[end].isalnum() or text[end] in "_"))
    if whole and 6 <= end - begin <= 45 and sum(bool(g) for g in text[begin:end].split(":")) >= 3:
        try:
            ipaddress.IPv6Address(text[begin:end])
            return begin, end, True
        except ValueError:
            pass
    return begin, reach, False


def _street(text: str, word: int, last: int) -> tuple | None:
    """A house number, capitalised words and the street word that ends at ``last``; or a Straße and its number."""
    for m in _STRASSE.finditer(text, max(0, last - 60), min(len(text), last + 8)):
        if m.start() <= last < m.end():
            return (*m.span(), "address")
    m = _STREET.match(text, word)
    # a street's name is short, so what stands before it is looked for in a few words
    before = m and _BEFORE_STREET.search(text, max(0, word - 120), word)
    return (before.start(), m.end(), "address") if before else None


def _numbers(text: str, begin: int, end: int) -> list[tuple]:
    """What a stretch of number characters holds; the patterns look at two characters behind it, too."""
    found, end = [], min(len(text), end + 2)
    for m in _IPV4.finditer(text, begin, end):
        found.append((*m.span(), "ipv4"))
    for m in _PHONE.finditer(text, begin, end):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((*m.span(), "phone"))
    for m in _NATIONAL.finditer(text, begin, end):
        found.append((*m.span(), "phone"))
    for m in _SSN.finditer(text, begin, end):
        found.append((*m.span(), "ssn"))
    for m in _DIGITS.finditer(text, begin, end):
        found += _accounts(text, *m.span())
    return found


def _accounts(text: str, begin: int, end: int) -> list[tuple]:
    """Cards and accounts in a stretch of digit groups: at each choice a card first, then the longest, then the first."""
    groups = [m.span() for m in re.finditer(r"\d+", text[begin:end])]
    size = [b - a for a, b in groups]
    choices = []
    for i, n in enumerate(size):
        if n < 4:
            continue
        for j in range(i, len(size)):
            n += size[j] if j > i else 0
            if n > 19 or (j > i and size[j] > 7):
                break
            if n >= 12:
                digits = re.sub(r"[ -]", "", text[begin + groups[i][0] : begin + groups[j][1]])
                card = luhn(digits)
                if i == j and _TIME.fullmatch(digits):
                    continue
                whole = (i, j) == (0, len(size) - 1)
                choices.append((not (card and (whole or tuple(size[i : j + 1]) in _CARD_GROUPS)), -n, i, j, "card" if card else "account"))
            if j > i and size[j] < 4:
                break  # a shorter group can only be the last
    found, taken = [], set()
    for _, _, i, j, kind in sorted(choices):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            found.append((begin + groups[i][0], begin + groups[j][1], kind))
    return found


def _cued(text: str, begin: int, end: int) -> tuple | None:
    """The number at ``begin`` after a cue: a card first, then the longest; with 6 digits, only groups of 4 or more go on."""
    best, n = None, 0
    for m in re.finditer(r"\d+", text[begin:end]):
        size = m.end() - m.start()
        if n + size > 19 or (n >= 6 and size < 4):
            break
        n += size
        if n >= 6:
            card = n >= 12 and luhn(re.sub(r"[ -]", "", text[begin : begin + m.end()]))
            if card or not best or best[2] != "card":
                best = begin, begin + m.end(), "card" if card else "account"
    return best if best and not _SSN.fullmatch(text, best[0], best[1]) else None


def find(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the findings in one text, in order."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found, seen, taken, hex_seen = [], -1, 0, -1
    for last, (kind, word) in automaton().iter(low):
        first = last - len(word) + 1
        if kind == "email":
            one = _email(text, last)
            if one:
                found.append(one)
        elif kind == "number":
            if last <= seen:
                continue
            begin, end = last - 1, last + 1
            while begin > 0 and text[begin - 1] in _NUMBER:
                begin -= 1
            while end < len(text) and text[end] in _NUMBER:
                end += 1
            seen = end
            found += _numbers(text, begin, end)
            # an IBAN's letters stand before its first digits, and groups may hold letters
            for m in _IBAN.finditer(text, max(0, last - 4), min(len(text), last + 44)):
                if iban(m.group()):
                    found.append((*m.span(), "account"))
        elif kind == "account":
            m = _CUED.search(text, max(0, last - 6), min(len(text), last + 100))
            if m and m.start() <= last:
                one = _cued(text, *m.span(1))
                if one:
                    found.append(one)
        elif kind == "called":
            m = _CALLED.search(text, max(0, first - 6), min(len(text), last + 60))
            if m and m.start() <= first:
                found.append((*m.span(1), "phone"))
        elif kind == "street":
            one = _street(text, first + (word[0] == " "), last)
            if one:
                found.append(one)
        elif kind == "colon":
            if last > hex_seen and (text[last - 1 : last] in _HEX if last else True) and text[last + 1 : last + 2] in _HEX:
                begin, end, good = _ipv6(text, last)
                hex_seen = end
                if good:
                    found.append((begin, end, "ipv6"))
        elif first >= taken:  # what lies in a value that was taken needn't be read again
            if kind == "url":
                m, begin = _USERINFO.match(text, first), first
                while m and begin > 0 and text[begin - 1] in _SCHEME:
                    begin -= 1
                while m and begin < first and not text[begin].isalpha():
                    begin += 1
                one = (begin, m.end(), "url") if m and begin < first else None
            elif kind == "block":
                m = _KEY_BLOCK.match(text, first)
                end = m and _KEY_END.search(text, m.end())
                one = (first, end.end() if end else len(text), "secret") if m else None
            else:
                m = (_KEYS[word] if kind == "key" else _SECRET if kind == "secret" else _BEARER).match(text, first)
                one = (*m.span(0 if kind == "key" else 1), "secret") if m else None
            if one:
                found.append(one)
                taken = one[1]
    kept, reach = [], -1
    for begin, end, kind in sorted(set(found), key=lambda x: (x[0], -x[1], x[2])):
        if begin >= reach:
            kept.append((begin, end, kind))
            reach = end
    return kept


def redact(text: str) -> str:
    """The text with each finding replaced by its kind."""
    out, at = [], 0
    for begin, end, kind in find(text):
        out += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, begin, end, value): one row for each finding."""

    def make():
        def each(texts):
            rows, out = [], {"kind": [], "begin": [], "end": [], "value": []}
            for i, text in enumerate(texts):
                for begin, end, kind in find(text):
                    rows.append(i)
                    for name, value in zip(out, (kind, begin, end, text[begin:end])):
                        out[name].append(value)
            return rows, out

        return each

    fields = [T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())]
    return find_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", make, fields)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op5_pii": op5_pii}
SQL: dict[str, str] = {}

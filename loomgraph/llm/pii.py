"""Personal data replaced by surrogates.

Detected entities get replacements that are functions of a secret key and the entity alone, so that one entity has one
replacement in all documents (coreference) without any exchange between tasks. The functions are keyed permutations:
Feistel networks over the set of strings of the same type and format, and keyed rotations of name lists of the same
gender and script; so no two entities share a replacement. verify() checks that over a whole table, whatever its size.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import col, read
from loomgraph.llm.names import CUES, GIVEN, HAN_FAMILY, SUFFIXES, TITLES


class CollisionError(ValueError):
    """Two entities got the same surrogate."""


_OF_NAME = {n: (group, i) for group, names in GIVEN.items() for i, n in enumerate(names)}


def _signs(*categories: str) -> str:
    """The signs of these general categories, as ranges of a class of a regular expression."""
    hit = [c for c in range(0x80, 0x30000) if unicodedata.category(chr(c)) in categories]
    cut = [i for i, c in enumerate(hit) if not i or hit[i - 1] != c - 1] + [len(hit)]
    return "".join(f"{chr(hit[a])}-{chr(hit[b - 1])}" for a, b in zip(cut, cut[1:]))


_UP, _LOW = f"A-Z{_signs('Lu', 'Lt')}", f"a-z{_signs('Ll', 'Mn', 'Mc', 'Lm')}"
#: Letters of scripts without capitals, but for those of which words are run together.
_PLAIN = rf"(?:(?![\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af])[{_signs('Lo')}])[{_signs('Lo', 'Mn', 'Mc')}]*"
_TITLE = rf"(?:{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})\.?"
_NAME = "|".join(sorted(map(re.escape, _OF_NAME), key=len, reverse=True))
_FAMILY = rf"(?:[{_UP}][{_LOW}]+(?:['’-][{_UP}][{_LOW}]+)*|[{_UP}]['’][{_UP}][{_LOW}]+|{_PLAIN})"
_CUE = "|".join(map(re.escape, sorted(CUES, key=len, reverse=True)))

# Between the parts of a number there may be marks that a broken page has put there, but no line end.
_GAP = r"[^\w\n+@]{1,6}"
_NUMBERS = re.compile(
    rf"""(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))
    |(?P<phone>\+\d{{1,3}}{_GAP}\d{{2,4}}{_GAP}\d{{3}}{_GAP}\d{{4}}(?!\w)|\+\d(?:[ ().-]{{0,2}}\d){{6,14}}(?!\w)|(?<![\w(])\(\d{{3}}\)[ ]?\d{{3}}-\d{{4}}(?!\w)|(?<![\w-])\d{{3}}-\d{{3}}-\d{{4}}(?![\w-]))
    |(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
    |(?P<card>(?<![\w.+-])(?:\d{{4}}[ -]){{3}}\d{{1,7}}(?![\w-])|(?<![\w.+-])\d{{13,19}}(?![\w]))""",
    re.VERBOSE | re.ASCII,
)
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|api[_-]?key|access[_-]?key)\W{1,12}?(?P<secret>[A-Za-z0-9_+/-]{16,})(?![\w])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{2,}(?!\w)")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
_PERSON = re.compile(rf"(?<!\w)(?:{_TITLE} (?P<titled>(?:(?:{_NAME}) )?{_FAMILY})|(?P<plain>(?:{_NAME}) {_FAMILY}))(?!\w)")
# After a cue, any name of two or three words counts; their genders aren't known.
_CUED = re.compile(rf"(?<!\w)(?:{_CUE})(?:[:：,] ?\n?| )(?:{_TITLE} )?(?P<cued>{_FAMILY}(?: {_FAMILY}){{1,2}})(?!\w)")
_HAN = re.compile(rf"(?:我叫|姓名[:：] ?|我的名字是)(?P<han>[{HAN_FAMILY}][\u4e00-\u9fff]{{1,2}})(?![\u4e00-\u9fff])|(?<![\u4e00-\u9fff])(?P<han2>[{HAN_FAMILY}][\u4e00-\u9fff]{{0,2}})(?={'|'.join(SUFFIXES)})")
_LETTERS = re.compile(r"[^\W\d_]+")
#: A text without any of these words names no person.
_FIRST = {w for x in (*_OF_NAME, *TITLES) for w in _LETTERS.findall(x)}
_CUE_FIRST = {_LETTERS.findall(x)[0] for x in CUES if x[0] < "\u3000"}
_LOOSE = re.compile(r"[\u0900-\u097f]")  # words with marks, which aren't letters


def _valid_card(s: str) -> bool:
    """Whether digits are a card number: by the Luhn check, and by the first one, which tells the industry."""
    d = re.sub(r"[^0-9]", "", s)
    return 13 <= len(d) <= 19 and d[0] in "23456" and _luhn(d[:-1]) == int(d[-1])


def _is_ip6(s: str) -> bool:
    try:
        return s.count(":") >= 2 and len(re.findall(r"[0-9A-Fa-f]+", s)) >= 2 and ipaddress.IPv6Address(s).ipv4_mapped is None
    except ValueError:
        return False


def find(text: str) -> list[tuple[int, int, str]]:
    """(from, to, type) of the entities of a text, in order, none overlapping; where two do, the earlier, then the
    longer one counts. Types: email, secret, ip, ip6, phone, ssn, card (one that passes the Luhn check), iban, person.
    A person is a given name of GIVEN with a family name, a name after a title, or two or three names after a cue."""
    found = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    digits = bool(_DIGITS.search(text))
    if digits:
        found += [(*m.span(), m.lastgroup) for m in _NUMBERS.finditer(text) if m.lastgroup != "card" or _valid_card(m[0])]
        found += [(*m.span("secret"), "secret") for m in _SECRET.finditer(text) if any(c.isdigit() for c in m["secret"])]
        found += [(*m.span(), "iban") for m in _IBAN.finditer(text)]
        if ":" in text:
            found += [(*m.span(), "ip6") for m in _IP6.finditer(text) if _is_ip6(m[0])]
    words = _LETTERS.findall(text)
    loose = bool(_LOOSE.search(text))
    if loose or not _FIRST.isdisjoint(words):
        found += [(*m.span(m.lastgroup), "person") for m in _PERSON.finditer(text)]
    if loose or not _CUE_FIRST.isdisjoint(words):
        found += [(*m.span("cued"), "person") for m in _CUED.finditer(text)]
    if _CJK.search(text):
        found += [(*m.span(m.lastgroup), "person") for m in _HAN.finditer(text)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


_CJK = re.compile(r"[\u4e00-\u9fff]")
_DIGITS = re.compile(r"[0-9]")


def _feistel(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of 0..size-1, for each tweak another one: a Feistel network of ten rounds over the least
    even number of bits that holds size, walked until it falls into the range; or, back, its inverse."""
    half = max(1, (((size - 1).bit_length() + 1) // 2))
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def f(r: int, x: int) -> int:
        seed = hmac.digest(key, f"{tweak}|{size}|{r}|".encode() + x.to_bytes(width, "big"), "sha256")
        return int.from_bytes(seed if width <= 32 else hashlib.shake_256(seed).digest(width), "big") & mask

    while True:
        a, b = value >> half, value & mask
        if back:
            for r in range(9, -1, -1):
                a, b = b ^ f(r, a), a
        else:
            for r in range(10):
                a, b = b, a ^ f(r, b)
        value = (a << half) | b
        if value < size:
            return value


def _other(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of 0..size-1 that leaves nothing in its place (if size is over 1): a step along a cycle
    through all of the range in a keyed order."""
    if size <= 1:
        return value
    return _feistel(key, tweak, (_feistel(key, tweak, value, size) + 1) % size, size, back=True)


_ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "äöüàâéèêëîïôûùáíóúœæ", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ")
_CLASS = {c: (k, i) for k, a in enumerate(_ALPHABETS) for i, c in enumerate(a)}
_HEX = {c: ("hex", i) for i, c in enumerate("0123456789abcdef")}


@functools.cache
def _members(block: int, category: str) -> str:
    """The letters, or digits, of a block of 128 signs that replace each other: none of _ALPHABETS, and of letters with
    case the small ones whose large form is one sign and leads back."""
    signs = [chr(c) for c in range(block << 7, (block + 1) << 7)]
    return "".join(c for c in signs if unicodedata.category(c) == category and c not in _CLASS and (category != "Ll" or (len(c.upper()) == 1 and c.upper().lower() == c)))


def _class(c: str, classes: dict) -> tuple | None:
    """(class, place in it, its members) of a sign that is replaced, None of one that stays."""
    if (k := classes.get(c)) is not None:
        return k[0], k[1], "0123456789abcdef" if k[0] == "hex" else _ALPHABETS[k[0]]
    if classes is _HEX or c < "\x80" or (category := unicodedata.category(c)) not in ("Ll", "Lo", "Nd"):
        return None
    all_ = _members(ord(c) >> 7, category)
    i = all_.find(c)
    return ((ord(c) >> 7, category), i, all_) if i >= 0 else None


def _permute_text(key: bytes, kind: str, s: str, classes: dict = _CLASS) -> str:
    """s in lower case with each character replaced by one of its class (digit, vowel, consonant ... of a script, or
    letters of a block of Unicode), others as they are: a permutation of the strings of one format."""
    value, size, form = 0, 1, []
    known = [_class(c, classes) for c in s]
    for c, k in zip(s, known):
        form.append(c if k is None else f"\0{k[0]}")
        if k is not None:
            value, size = value * len(k[2]) + k[1], size * len(k[2])
    if size == 1:
        return s
    new = _other(key, kind + "|" + "".join(form), value, size)
    out = []
    for c, k in zip(reversed(s), reversed(known)):
        if k is None:
            out.append(c)
        else:
            out.append(k[2][new % len(k[2])])
            new //= len(k[2])
    return "".join(reversed(out))


def _small(s: str) -> str:
    """s in lower case, of as many characters."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def _like(pattern: str, s: str) -> str:
    """s in the case of pattern, which has as many characters."""
    return "".join(c.upper() if p.isupper() and len(c.upper()) == 1 else c for p, c in zip(pattern, s))


def _luhn(digits: str) -> int:
    """The check digit that makes these digits valid."""
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _fill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in pattern)


def normal(kind: str, s: str) -> str:
    """What the mentions of one entity have in common: of numbers the digits, of e-mails and such the lower case."""
    if kind == "phone" and s.startswith("+"):
        return "+" + re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return ".".join(str(int(x)) for x in s.split("."))
    if kind in ("phone", "ssn", "card"):
        return re.sub(r"[^0-9]", "", s)
    if kind == "ip6":
        return str(ipaddress.IPv6Address(s))
    if kind == "iban":
        return s.replace(" ", "")
    if kind == "secret" and not (set(s.lower()) <= set(_HEX) and s in (s.lower(), s.upper())):
        return s
    return s if kind == "person" else _small(s)


#: Country codes of one and two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _private(address: int) -> int:
    """Bits of the network, if the address is of a private range or the loopback one; else 0."""
    a, b = address >> 24, address >> 16 & 255
    return 8 if a in (10, 127) else 16 if (a, b) == (192, 168) else 12 if a == 172 and 16 <= b < 32 else 0


def surrogate(key: bytes, kind: str, s: str) -> str:
    """The replacement of an entity: of its type, separators, case and script, and for persons gender; a card
    number keeps its first digit and meets the Luhn check again, the country code of a phone number stays, an e-mail keeps its top-
    level domain, an IPv4 address stays one, a private one private, an IPv6 address keeps its first 16 bits."""
    if kind == "ip":
        value = int.from_bytes(bytes(int(x) for x in s.split(".")), "big")
        keep = _private(value)
        low = 32 - keep
        # leading zeros, as in 010.0.0.1, aren't kept; such forms name the same address
        new = value
        while True:  # of a public address, until the result is public
            new = (value >> low << low) | _other(key, f"ip|{value >> low if keep else -1}", new & ((1 << low) - 1), 1 << low)
            if _private(new) == keep:
                break
        return ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "card":
        d = normal(kind, s)
        body = d[0] + _permute_text(key, f"card{d[0]}", d[1:-1])  # the first digit, of the industry, stays
        return _fill(s, body + str(_luhn(body)))
    if kind in ("phone", "ssn"):
        d = re.sub(r"[^0-9]", "", s)
        # by the digits alone, so that all spellings of a number agree
        code = 0 if not s.startswith("+") else 1 if d[:1] in _CODES else 2 if d[:2] in _CODES else 3
        return _fill(s, d[:code] + _permute_text(key, f"{kind}|{d[:code]}", d[code:]))
    if kind == "email":
        low = _small(s)
        at = low.rindex(".")
        return _like(s, _permute_text(key, "email", low[:at]) + low[at:])
    if kind == "ip6":
        value = int(ipaddress.IPv6Address(s))
        return str(ipaddress.IPv6Address(value >> 112 << 112 | _other(key, f"ip6|{value >> 112}", value & ((1 << 112) - 1), 1 << 112)))
    if kind == "secret":
        low = _small(s)
        return _like(s, _permute_text(key, kind, low, _HEX)) if normal(kind, s) == low else _cased(key, kind, s)
    if kind == "iban":
        new = iter(_cased(key, kind, normal(kind, s)[2:]))
        return s[:2] + "".join(c if c == " " else next(new) for c in s[2:])
    # word by word, so that "Anna Schmidt" and "Ms Schmidt" stay one person
    first, *rest = s.split(" ")
    if rest and first in _OF_NAME:
        first = _given(key, first)
    else:
        first = _cased(key, "family", first)
        while rest and first in _OF_NAME:  # on to one that isn't a known given name, as those replace each other
            first = _cased(key, "family", first)
    return " ".join([first, *(_cased(key, "family", w) for w in rest)])


def _given(key: bytes, name: str) -> str:
    group, i = _OF_NAME[name]
    n = len(GIVEN[group])
    turn = 1 + int.from_bytes(hmac.digest(key, f"given|{group}".encode(), "sha256")[:8], "big") % (n - 1)
    return GIVEN[group][(i + turn) % n]


def _cased(key: bytes, kind: str, s: str) -> str:
    """As _permute_text, with the case of each letter part of the format."""
    low = _small(s)
    case = "".join("U" if c.isupper() else "l" for c in s)
    return _like(s, _permute_text(key, f"{kind}|{case}", low))


@dataclass
class Replacer:
    """Rewrites texts; surrogates of up to a number of entities are remembered, which only saves time."""

    key: bytes
    most: int = 200_000

    def __post_init__(self):
        self.known: dict[tuple[str, str], str] = {}

    def one(self, kind: str, s: str) -> str:
        got = self.known.get((kind, s))
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = self.known[kind, s] = surrogate(self.key, kind, s)
        return got

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (type, entity, surrogate) of each."""
        out, at, pairs = [], 0, []
        for a, b, kind in find(text):
            new = self.one(kind, text[a:b])
            out += (text[at:a], new)
            pairs.append((kind, text[a:b], new))
            at = b
        return ("".join((*out, text[at:])) if out else text), pairs


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities) for each row, the text with its personal data replaced.

    NULL stays NULL with 0 entities; an empty text stays empty. Texts without entities are as they were. Repeated rows
    each appear, with equal results. No rows give no rows.
    """
    secret = key.encode()

    def apply(batches):
        r = Replacer(secret)
        for b in batches:
            texts, n = [], []
            for t in b.column(1).to_pylist():
                t, pairs = (None, []) if t is None else r.rewrite(t)
                texts.append(t)
                n.append(len(pairs))
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32())], ["doc_id", "text", "n_entities"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_entities", T.IntegerType())])
    return docs.select(col(id_col), col(text_col)).mapInArrow(apply, schema)


def entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(type, entity, surrogate), entity and surrogate in normal form, for each mention; repeated rows count each time.
    NULL and empty texts have none; no rows give no rows."""
    secret = key.encode()

    def apply(batches):
        r = Replacer(secret)
        for b in batches:
            rows = [(k, normal(k, a), normal(k, s)) for t in b.column(0).to_pylist() if t for k, a, s in r.rewrite(t)[1]]
            yield pa.record_batch([pa.array([x[i] for x in rows], pa.string()) for i in range(3)], ["type", "entity", "surrogate"])

    return docs.select(col(text_col)).mapInArrow(apply, "type string, entity string, surrogate string")


def collisions(mentions: DataFrame) -> DataFrame:
    """(type, surrogate, n) of what more than one entity has, over a whole table of entities(); none if all is well. n is
    2, for at least two. Smallest and largest entity are found before the shuffle, so a frequent one costs no more than a rare."""
    ends = mentions.groupBy("type", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("b"))
    return ends.where("a <> b").select("type", "surrogate", F.lit(2).cast("long").alias("n"))


def verify(docs: DataFrame, key: str, text_col: str = "text") -> None:
    """CollisionError, if two entities of the whole table have one surrogate. NULL and empty texts, repeated rows and empty
    tables have nothing that could collide beyond what others have."""
    if collisions(entities(docs, key, text_col)).limit(1).count():
        raise CollisionError("two entities have one surrogate")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pseudonymise() of all documents, after verify() of all."""
    docs, key = read(spark, sf_dir, "documents"), spark.conf.get("spark.loomgraph.pii.key", "a key for tests; set your own")
    verify(docs, key)
    return pseudonymise(docs, key=key)

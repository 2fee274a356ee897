"""Surrogates for personal data: every entity becomes another of its type, gender, script and format.

A surrogate is the next entity of its format class in a keyed order: a Feistel permutation p of the class's numbers 0..n-1,
and x goes to p((inverse of p)(x) + 1). So equal entities get equal surrogates everywhere (coreference), different ones
different surrogates, none its own, and nothing has to be gathered or stored. Collisions are checked all the same: entities()
lists what was replaced by what, as keyed digests, collisions() counts surrogates that stand for two entities, or entities with
two surrogates, and resolve() lists, as a table, the entities that share one and how far each moves along the order.

What is a name is told by evidence: the cue before it, and for each of its words whether it is an ordinary word, in the corpus
(ordinary_words) or in the text itself.
"""

from __future__ import annotations

import hashlib
import logging
import re
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.llm.common import cut

# Titles by gender, given names by script and gender, alphabets by script.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Señora Sra Doña Госпожа Κυρία".split(),
    "n": "Dr Prof Professor Доктор".split(),
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Charles Peter Paul Hans Karl Jean Pierre Carlos Juan Luis Miguel Antonio Stefan".split(),
    ("latin", "f"): "Mary Anna Linda Susan Sarah Karen Laura Emma Julia Marie Claire Sophie Carmen Lucia Elena Monika Petra Heike Ingrid Nicole".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Павел Владимир".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Вера".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα".split(),
}
#: Words before a name that tell no gender and how much each says, and Han names: family names, and what is said after a whole name, by gender.
CUES = {"my name is": 3, "signed,": 3, "regards,": 2, "sincerely,": 2, "name:": 1, "dear": 1, "attn:": 1, "contact:": 1, "patient:": 1, "author:": 1}
#: Evidence of a title, of one that is a usual word as well, of a given name of the lists, of a word ordinary in the corpus, of one ordinary in the text.
TITLE, WEAK_TITLE, LISTED, ORDINARY, ORDINARY_HERE = 3, 2, 2, -1, -2
WEAK_TITLES = frozenset("Sir Miss Sr Don Sra".split())
#: Words that a name seldom follows: articles and the like, and words of time and place.
BEFORE_NOUNS = frozenset(
    "the a an this that these those its every each in since until during der die das den dem des ein eine einen im seit le la les un une du dans depuis el los las una del desde ο η το в с".split()
)
#: Kinds of streets: after the name in English, at its end in German, before it in French and Spanish.
STREETS = {
    "en": "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Square Terrace".split(),
    "de": "straße strasse weg platz gasse allee".split(),
    "fr": "rue avenue boulevard place chemin impasse".split(),
    "es": "Calle Avenida Plaza Paseo".split(),
}
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蔡蒋余"
HAN_TITLES = {"m": ["先生"], "f": ["女士", "小姐", "太太"], "n": ["博士", "教授", "医生", "老师"]}
HAN_GIVEN = {"m": "伟强磊军勇杰涛明超刚平辉健波斌浩宇峰龙鹏", "f": "芳娜敏静丽艳娟霞秀兰燕玲丹萍雪梅琳莉婷红"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуыэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзйклмнпрстфхцчшщьъ", "greek": "βγδζθκλμνξπρστφχψ"}

#: Letters with marks that names of the Latin script have: vowels, consonants.
MARKED = ["áàâäãåæéèêëíìîïóòôöõøúùûüýÿœ", "çñßšžčćđłńřťď"]
#: Addresses (first, one past the last) that aren't public: each range is a class of its own.
RANGES = [(0x00000000, 0x01000000), (0x0A000000, 0x0B000000), (0x64400000, 0x64800000), (0x7F000000, 0x80000000), (0xA9FE0000, 0xA9FF0000),
          (0xAC100000, 0xAC200000), (0xC0A80000, 0xC0A90000), (0xE0000000, 0xF0000000), (0xF0000000, 0x100000000)]

#: Country codes of two digits; those that begin with 1 or 7 have one, all others three.
COUNTRY = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Last letters of feminine names outside the Latin script.
FEMININE = {"latin": "", "cyrillic": "ая", "greek": "αη"}

ROUNDS = 6
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_CAP = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-ЯЁ][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_GIVEN = "|".join(sorted({n for g in GIVEN.values() for n in g}, key=len, reverse=True))
_EMAIL = re.compile(r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")
_NUMBER = re.compile(
    r"(?P<ipv4>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-]))"
    r"|(?P<phone>(?<![\w+])0[1-9](?:[ .-]\d{2}){4}(?!\w)|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?:[ .-]?\d{2,4})?(?!\w)|(?<![\w+])\+\d{9,15}(?!\w))"
)
_IBAN = re.compile(r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)")
_NAME = re.compile(rf"\b(?P<title>{_TITLE})\b\.?\s(?P<name>{_CAP}(?:\s{_CAP})?)|\b(?P<full>(?:{_GIVEN})\s{_CAP})")
_CUED = re.compile(rf"(?P<cue>(?i:{'|'.join(map(re.escape, CUES))}))\s+(?P<cued>{_CAP}\s{_CAP})")
_PARTICLES = r"(?:(?:de|du|des|del|la|las|los|el|le|les)\s|l['’])*"
_STREET = re.compile(
    rf"(?P<address>(?<![\w.,-])[1-9]\d{{0,4}}\s(?:{_CAP}\s){{1,3}}(?:{'|'.join(STREETS['en'])})\b"
    rf"|\b[A-ZÄÖÜ][a-zäöüß]+(?:{'|'.join(STREETS['de'])})\s[1-9]\d{{0,3}}\b"
    rf"|(?<![\w.,-])[1-9]\d{{0,3}},?\s(?:{'|'.join(STREETS['fr'])})\s{_PARTICLES}{_CAP}(?:\s{_CAP})?"
    rf"|\b(?:{'|'.join(STREETS['es'])})\s{_PARTICLES}{_CAP}(?:\s{_CAP})?,?\s[1-9]\d{{0,3}}\b)"
)
_HAN = re.compile(rf"(?P<han>[{HAN_FAMILY}][\u4e00-\u9fff]{{1,2}}?)(?P<after>{'|'.join(t for g in HAN_TITLES.values() for t in g)})")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[+(]?\d[\d .()+-]*")


@lru_cache(maxsize=1)
def _cues() -> ahocorasick.Automaton:
    """Titles, given names and cues, each with its search, to be found in one pass over a text."""
    a = ahocorasick.Automaton()
    for n in {n for g in (*TITLES.values(), *GIVEN.values()) for n in g}:
        a.add_word(n, 3)
    for n in CUES:
        for w in {n, n.title(), n.capitalize(), n.upper()}:
            a.add_word(w, 4)
    for n in {n for g in HAN_TITLES.values() for n in g}:
        a.add_word(n, 5)
    for n in {n for g in STREETS.values() for n in g}:
        a.add_word(n, 6)
    a.make_automaton()
    return a


def _plausible(kind: str, value: str) -> bool:
    """Whether a number follows a plan: cards end in their check digit, telephone numbers have a country code, a trunk zero, an area in
    brackets, or area and exchange of the North American plan."""
    d = "".join(c for c in value if c in DIGITS)
    if kind == "card":
        return d[0] in "23456" and _luhn_ok(d)
    if kind != "phone":
        return True
    if value.startswith("+"):
        return d[0] != "0" and (len(d) == 11 if d[0] == "1" else 8 <= len(d) <= 15)
    if d[0] == "0":
        return 9 <= len(d) <= 12
    return _north_american(d) if len(d) == 10 else value.startswith("(") and 7 <= len(d) <= 11


def _north_american(digits: str) -> bool:
    return len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789"


def _found(text: str):
    """Matches of all kinds by place, without overlaps; of two at one place the kind named first. Cheap tests tell which searches a text needs."""
    every = []
    if "@" in text:
        every += [(m.start(), 0, m) for m in _EMAIL.finditer(text)]
    runs = [m.span() for m in _DIGITS.finditer(text)]  # numbers are searched for where digits are
    for s, e in runs:
        every += [(m.start(), 1, m) for m in _NUMBER.finditer(text, s, e + 2) if _plausible(m.lastgroup, m.group())]
    if runs:
        every += [(m.start(), 2, m) for m in _IBAN.finditer(text)]
    cues = {k for _, k in _cues().iter(text)}
    for k, search in ((3, _NAME), (4, _CUED), (5, _HAN), (6, _STREET)):
        if k in cues and (k != 6 or runs):
            every += [(m.start(m.lastgroup if k == 4 else 0), k, m) for m in search.finditer(text)]
    end = 0
    for s, k, m in sorted(every, key=lambda x: x[:2]):
        if s >= end:
            end = m.end("han") if k == 5 else m.end()
            yield m


def _gender(kind: str, m: re.Match) -> str:
    if kind == "han":
        return next(g for g, t in HAN_TITLES.items() if m.group("after") in t)
    gender = next((g for g, t in TITLES.items() if m.group("title") in t), "") if kind == "name" else ""
    if gender in ("", "n"):
        first = m.group(kind).split()[0]
        gender = next((g for (_, g), given in GIVEN.items() if first in given), gender) or "n"
    return gender


def _evidence(kind: str, m: re.Match, ordinary: frozenset[str], here: set[str]) -> int:
    """How much speaks for a name: its cue and a given name of the lists for it, ordinary words against it."""
    if kind == "name":
        score = WEAK_TITLE if m.group("title") in WEAK_TITLES else TITLE
    else:
        score = CUES[m.group("cue").lower()] if kind == "cued" else LISTED
    words = _WORD.findall(m.group(kind))
    if kind != "full" and _lower(words[0]) in _pools():
        score += LISTED
    return score + sum(ORDINARY_HERE if w in here else ORDINARY if w.lower() in ordinary else 0 for w in words)


def detect(text: str | None, ordinary: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str]]:
    """(start, end, type, gender or '') of the entities of a text, in order, without overlaps.

    Capitalised words after a cue are a name if the evidence for it isn't below that against it: words of `ordinary`, and words that the
    text itself has in lower case or after an article, speak against it. Words of a name that was found are names wherever else
    the text has them, with the gender that they had first, but not after an article or a word of time or place, and ordinary words only
    beside another word of a name. Two passes over the text, whatever the number of names.
    """
    found = [("han" if "han" in m.re.groupindex else m.lastgroup, m) for m in _found(text or "")]
    guesses = {w for kind, m in found if kind in ("name", "full", "cued") for w in _WORD.findall(m.group(kind))}
    spelt = {w.lower(): w for w in guesses if w.lower() != w}
    places, here = [], set()
    if guesses:
        before, end = "", 0
        for m in _WORD.finditer(text):
            w = m.group()
            if w in guesses:
                gap = text[end : m.start()]
                places.append((m, before if gap.isspace() else "", gap))
                if places[-1][1].lower() in BEFORE_NOUNS:
                    here.add(w)
            elif w in spelt:
                here.add(spelt[w])
            before, end = w, m.end()
    out, names, han = [], {}, {}
    for kind, m in found:
        s, e = m.span(kind)
        if kind not in ("name", "full", "cued", "han"):
            out.append((s, e, kind, ""))
        elif kind == "han" or _evidence(kind, m, ordinary, here) >= 0:
            gender = _gender(kind, m)
            out.append((s, e, "name", gender))
            for w in [m.group(kind)] if kind == "han" else _WORD.findall(m.group(kind)):
                (han if kind == "han" else names).setdefault(w, gender)
    if not names and not han:
        return out
    more = []
    for m, before, gap in places:
        w = m.group()
        if w in names and len(w) > 1 and before.lower() not in BEFORE_NOUNS:
            if before in names or gap == "-" or not (w in here or w.lower() in ordinary):
                more.append((*m.span(), "name", names[w]))
    if han:
        a = ahocorasick.Automaton()
        for w in han:
            a.add_word(w, w)
        a.make_automaton()
        more += [(end + 1 - len(w), end + 1, "name", han[w]) for end, w in a.iter(text)]
    return _merged(out, more)


def _merged(found: list[tuple[int, int, str, str]], more: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found, and those of more that overlap none of them nor, of more, an earlier or longer one."""
    out, end = [], 0
    rank = {x: 0 for x in found}
    for x in sorted({*found, *more}, key=lambda x: (x[0], rank.get(x, 1), -x[1])):
        if x in rank:  # what was found goes first
            while out and out[-1][1] > x[0] and out[-1] not in rank:
                out.pop()
            out.append(x)
            end = x[1]
        elif x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def _round(key: bytes, tag: bytes, r: int, x: int, n: int) -> int:
    """A keyed pseudo-random number below n."""
    size = (n.bit_length() + 7) // 8 + 8
    h = hashlib.blake2b(tag + bytes([r]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), key=key, digest_size=min(64, size)).digest()
    return int.from_bytes(h, "big") % n


def permute(x: int, n: int, key: bytes, tag: str, back: bool = False) -> int:
    """A keyed permutation of 0..n-1, or its inverse: Feistel rounds on a grid of a x b >= n cells, walked until back below n."""
    if n <= 1:
        return x
    a = max(2, int(n**0.5) if n < 1 << 52 else 1 << ((n.bit_length() + 1) // 2))
    b = -(-n // a)
    t = f"{tag}:{n}".encode()
    while True:
        left, right = divmod(x, b)
        if back:
            for r in range(ROUNDS - 2, -1, -2):
                right = (right - _round(key, t, r + 1, left, b)) % b
                left = (left - _round(key, t, r, right, a)) % a
        else:
            for r in range(0, ROUNDS, 2):
                left = (left + _round(key, t, r, right, a)) % a
                right = (right + _round(key, t, r + 1, left, b)) % b
        x = left * b + right
        if x < n:
            return x


def following(x: int, n: int, key: bytes, tag: str) -> int:
    """The number after x in a keyed cyclic order of 0..n-1: a bijection without fixed points, where n is 2 or more."""
    return permute((permute(x, n, key, tag, back=True) + 1) % n, n, key, tag) if n > 1 else x


def _by_class(s: str, key: bytes, tag: str, classes: list[str]) -> str:
    """Moves the characters of s that are in one of the classes, as one mixed-radix number; the others stay."""
    where = {c: k for k in classes for c in k}
    x, total = 0, 1
    for c in s:
        if c in where:
            abc = where[c]
            x = x * len(abc) + abc.index(c)
            total *= len(abc)
    y = following(x, total, key, f"{tag}|{''.join(str(classes.index(where[c])) if c in where else c for c in s)}")
    out = []
    for c in reversed(s):
        if c in where:
            y, d = divmod(y, len(where[c]))
            out.append(where[c][d])
        else:
            out.append(c)
    return "".join(reversed(out))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _luhn_sum(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _luhn_ok(digits: str) -> bool:
    return _luhn_sum(digits) == 0


def _layout(original: str, chars: str, keep: str) -> str:
    """chars put where `original` has characters of `keep`."""
    it = iter(chars)
    return "".join(next(it) if c in keep else c for c in original)


def _card(value: str, key: bytes) -> str:
    """First digit and Luhn validity stay: the last digit keeps its offset from the one that would be valid."""
    d = "".join(c for c in value if c in DIGITS)
    off = _luhn_sum(d)
    body = d[0] + _by_class(d[1:-1], key, f"card{len(d)}{d[0]}", [DIGITS])
    last = next(c for c in DIGITS if _luhn_sum(body + c) == off)
    return _layout(value, body + last, DIGITS)


def _ipv4(value: str, key: bytes) -> str:
    """Within its own range of RANGES, or among the addresses outside all of them, by rank."""
    x = int.from_bytes(bytes(map(int, value.split("."))), "big")
    low, high = next(((a, b) for a, b in RANGES if a <= x < b), (None, None))
    if low is not None:
        x = low + following(x - low, high - low, key, f"ipv4.{low}")
    else:
        x = following(x - sum(b - a for a, b in RANGES if b <= x), (1 << 32) - sum(b - a for a, b in RANGES), key, "ipv4")
        for a, b in RANGES:
            x += (b - a) * (x >= a)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(value: str, key: bytes) -> str:
    """Numbers that can be issued stay so: area 001 to 899 but 666, group and serial not zero; all others stay among the others."""
    area, group, serial = map(int, value.split("-"))
    if 0 < area < 900 and area != 666 and group and serial:
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(following(x, 898 * 99 * 9999, key, "ssn"), 9999)
        area, group = divmod(x, 99)
        area, group, serial = area + 1 + (area >= 665), group + 1, serial + 1
    else:
        x = int(value.replace("-", ""))
        while True:  # about one number in nine
            x = following(x, 10**9, key, "ssn other")
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            if not (0 < area < 900 and area != 666 and group and serial):
                break
    return f"{area:03}-{group:02}-{serial:04}"


def _iban_mod(body: str, check: str, country: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def _iban(flat: str, key: bytes) -> str:
    """Country and validity stay: the check digits 02 to 98 keep the remainder by 97, which is 1 if the number is valid."""
    country, check, body = flat[:2], flat[2:4], flat[4:]
    new = _by_class(body, key, f"iban{country}", [DIGITS, UPPER])
    if "02" <= check <= "98":
        check = f"{2 + (_iban_mod(body, check, country) - _iban_mod(new, '02', country)) % 97:02}"
    return country + check + new


def _country(digits: str) -> int:
    """Digits of the country code that an international number begins with."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in COUNTRY else 3


def _subscriber(rest: str, tag: str, american: bool, key: bytes) -> str:
    """The digits after country and trunk: numbers of the North American plan stay in it, others of their length outside it."""
    if american and _north_american(rest):
        x = ((int(rest[:3]) - 200) * 800 + int(rest[3:6]) - 200) * 10**4 + int(rest[6:])
        x, line = divmod(following(x, 800 * 800 * 10**4, key, tag + "plan"), 10**4)
        return f"{x // 800 + 200}{x % 800 + 200}{line:04}"
    low, new = 10 ** (len(rest) - 1), rest
    while True:
        new = str(low + following(int(new) - low, 9 * low, key, tag))
        if not (american and _north_american(new)):
            return new


def _address(value: str, key: bytes) -> str:
    """The number moves among those of its length, the street's words as words of names do; kinds of streets and particles stay."""
    out = []
    for part in re.split(r"([^\W_]+)", value):
        if part.isdigit():
            low = 10 ** (len(part) - 1)
            part = str(low + following(int(part) - low, 9 * low, key, "house"))
        elif part[:1].isupper() and part not in STREETS["en"] + STREETS["es"]:
            kind = next((k for k in STREETS["de"] if part.endswith(k) and len(part) > len(k) and part[-len(k) - 1].islower()), "")
            part = _name(part[: len(part) - len(kind)], key) + kind
        out.append(part)
    return "".join(out)


def _script(word: str) -> str:
    c = word[0]
    return "han" if "\u4e00" <= c <= "\u9fff" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _lower(name: str) -> str:
    """Lower case, the Greek final sigma as any other, so that a name's case and place don't count."""
    return name.lower().replace("ς", "σ")


def _cased(like: str, word: str) -> str:
    return "".join(w.upper() if c.isupper() and len(w.upper()) == 1 else w for c, w in zip(like, word)) if len(like) == len(word) else word[:1].upper() + word[1:]


@lru_cache(maxsize=1)
def _pools() -> dict[str, list[str]]:
    """The list of given names, in lower case, that each given name is in."""
    pools = [[_lower(n) for n in names] for names in GIVEN.values()]
    return {n: p for p in pools for n in p}


def _word_name(word: str, key: bytes, tag: str) -> str:
    """A name outside the lists: vowels to vowels, consonants to consonants, marked letters to marked ones; a feminine ending stays,
    no other word gets one."""
    script, low = _script(word), _lower(word)
    tail = FEMININE[script]
    body, end = (low[:-1], low[-1:]) if low[-1] in tail else (low, "")
    while True:  # names outside the lists stay outside, words without the ending stay without: a permutation of the rest
        body = _by_class(body, key, f"{tag}{script}{end}", [VOWELS[script], CONSONANTS[script], *(MARKED if script == "latin" else [])])
        if body + end not in _pools() and (end or body[-1] not in tail):
            return body + end


def _han_name(word: str, key: bytes) -> str:
    """Family names of the list stay in it; the others' characters, and those of given names by their list, move within theirs."""
    lists = [HAN_GIVEN["m"], HAN_GIVEN["f"]]
    out = []
    for k, c in enumerate(word):
        if k == 0 and c in HAN_FAMILY:
            out.append(HAN_FAMILY[following(HAN_FAMILY.index(c), len(HAN_FAMILY), key, "han family")])
            continue
        abc = next((x for x in lists if c in x), None)
        if abc:
            out.append(abc[following(abc.index(c), len(abc), key, f"han{abc[0]}")])
            continue
        x = ord(c) - 0x4E00
        while True:  # the rest of the block
            x = following(x, 0x5200, key, "han")
            if not any(chr(0x4E00 + x) in a for a in lists):
                break
        out.append(chr(0x4E00 + x))
    return "".join(out)


def _name(value: str, key: bytes) -> str:
    """Given names of the lists move within their script and gender, all other words by letters; each word alike wherever it
    stands, so that a surname alone, after any title and in a full name agree."""
    out = []
    for word in re.split(r"(\s+|[-'’])", value):
        if not word or not word[0].isalpha():
            out.append(word)
            continue
        pool = _pools().get(low := _lower(word))
        if _script(word) == "han":
            out.append(_han_name(word, key))
            continue
        new = pool[following(pool.index(low), len(pool), key, f"given{pool[0]}")] if pool else _word_name(word, key, "name")
        if new[-1] == "σ":
            new = new[:-1] + "ς"
        out.append(_cased(word, new))
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def surrogate(kind: str, value: str, gender: str, key: bytes) -> str:
    """The replacement of an entity, in the value's own layout."""
    if kind == "email":
        local, _, domain = value.lower().partition("@")
        host, _, tld = domain.rpartition(".")
        return f"{_by_class(local, key, 'mailbox', [LOWER, DIGITS])}@{_by_class(host, key, f'host.{tld}', [LOWER, DIGITS])}.{tld}"
    if kind == "ipv4":
        return _ipv4(".".join(str(int(p)) for p in value.split(".")), key)
    if kind == "card":
        return _card(value, key)
    if kind == "ssn":
        return _ssn(value, key)
    if kind == "iban":
        return _layout(value, _iban(value.replace(" ", ""), key), DIGITS + UPPER)
    if kind == "address":
        return _address(value, key)
    if kind == "phone":
        d = "".join(c for c in value if c in DIGITS)
        head = _country(d) if value.startswith("+") else 0
        zeros = len(d) - head - len(d[head:].lstrip("0"))  # trunk prefixes stay, and no other number gets one
        rest = d[head + zeros :]
        if rest:
            rest = _subscriber(rest, f"phone{value[:1] == '+'}{d[: head + zeros]}", d[: head + zeros] in ("", "1"), key)
        return _layout(value, d[: head + zeros] + rest, DIGITS)
    return _name(value, key)


def canonical(kind: str, value: str) -> str:
    """What two mentions of one entity share: the layout of numbers and the case of addresses don't count."""
    if kind in ("card", "phone"):
        return ("+" if value.startswith("+") else "") + "".join(c for c in value if c in DIGITS)
    if kind == "iban":
        return value.replace(" ", "")
    if kind in ("name", "address"):
        return _lower(value)
    return value.lower() if kind == "email" else ".".join(str(int(p)) for p in value.split(".")) if kind == "ipv4" else value


def _moved(kind: str, value: str, gender: str, key: bytes, moved: dict[bytes, int]) -> str:
    """The surrogate, as many steps further along its order as `moved` says for the entity's digest."""
    new = surrogate(kind, value, gender, key)
    for _ in range(moved.get(_digest(key, kind, canonical(kind, value)), 0) if moved else 0):
        new = surrogate(kind, new, gender, key)
    return new


def replace(text: str | None, key: bytes, moved: dict[bytes, int] | None = None, ordinary: frozenset[str] = frozenset()) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """(text with surrogates, [(start, length in the new text, type, gender)])."""
    out, at, size, found = [], 0, 0, []
    for s, e, kind, gender in detect(text, ordinary):
        new = _moved(kind, text[s:e], gender, key, moved or {})
        out += [text[at:s], new]
        size += s - at
        found.append((size, len(new), kind, gender))
        size += len(new)
        at = e
    return ("".join([*out, text[at:]]) if found else text), found


def ordinary_words(docs: DataFrame, text_col: str = "text", most: int = 65_536) -> frozenset[str]:
    """The `most` commonest ordinary words of all texts, in lower case: those that stand in lower case at half of their places or more.

    Words of up to 64 letters, at 3 places or more, ties by their order; so the set has 16 MB at most. Words are counted
    over whole texts where they are read, and summed up before the shuffle; of the counts the driver gets a histogram.
    The words of one text are an array while they are counted, about 100 bytes a word. Null and empty texts have none; an empty table gives no words.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).where("length(w) <= 64")
    low = F.lower("w")
    n = words.groupBy(low.alias("word")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("w") == low).cast("long")).alias("plain"))
    n = cut(n.where("n >= 3 and 2 * plain >= n").select("word", "n", F.floor(8 * F.log2("n")).alias("size")))
    least, total = 0, 0
    for r in sorted(n.groupBy("size").count().collect(), reverse=True):  # 512 sizes at most
        least, total = r.size, total + r["count"]
        if total >= most:
            break
    top = cut(n.where(F.col("size") >= least).orderBy(F.desc("n"), "word"))  # lies in order: a limit reads its first ranges alone
    return frozenset(r.word for r in top.select("word").limit(most).collect())


def _moves(b: pa.RecordBatch) -> list[dict[bytes, int]]:
    """The moves of a batch's rows, if the rows have any."""
    if "moves" not in b.schema.names:
        return [{}] * b.num_rows
    return [{x["entity"]: x["steps"] for x in row or ()} for row in b.column("moves").to_pylist()]


def _replaced(batches, key, ordinary):
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("gender", pa.string())]))
    for b in batches:
        got = [replace(t, key, m, ordinary) for t, m in zip(b.column("text").to_pylist(), _moves(b))]
        spans = pa.array([[dict(zip(("start", "length", "type", "gender"), f)) for f in fs] for _, fs in got], span)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([t for t, _ in got], pa.string()), pa.array([len(f) for _, f in got], pa.int32()), spans], ["doc_id", "text", "n_entities", "entities"])


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", moved: DataFrame | None = None, ordinary: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, text, n_entities, entities) of every row: the text with surrogates and where they stand in it.

    Types: email, ipv4, ssn, card, iban, phone, address, name (gender m, f or n from a title or a given name). `moved` is what resolve()
    found, `ordinary` what ordinary_words() did. Null stays null, empty empty; a text without entities comes back as it is. Equal rows
    give equal rows; rows with a null id are like others; other columns aren't read. Texts are replaced whole and where they are
    read: no shuffle unless entities have to be moved, and a lost task runs again to the same result.
    """
    rows = _with_moves(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), key, moved, ordinary)
    return rows.mapInArrow(partial(_replaced, key=key, ordinary=ordinary), "doc_id long, text string, n_entities int, entities array<struct<start:long,length:long,type:string,gender:string>>")


def _with_moves(rows: DataFrame, key: bytes, moved: DataFrame | None, ordinary: frozenset[str]) -> DataFrame:
    """rows with the moves of their text's entities, by the text's digest. Two joins on single-row sides, which AQE splits where a text or an entity is hot."""
    if moved is None:
        return rows
    rows = rows.withColumn("t", F.sha2("text", 256))
    own = rows.select("t", "text").mapInArrow(partial(_marked, key=key, ordinary=ordinary), "t string, entity binary").distinct()
    moves = own.join(moved, "entity").groupBy("t").agg(F.collect_list(F.struct("entity", "steps")).alias("moves"))
    return rows.join(moves, "t", "left").drop("t")


def _marked(batches, key, ordinary):
    for b in batches:
        rows = [(t, x) for t, text in zip(b.column("t").to_pylist(), b.column("text").to_pylist()) for x in {_digest(key, kind, canonical(kind, text[s:e])) for s, e, kind, _ in detect(text, ordinary)}]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary())], ["t", "entity"])


def _digest(key: bytes, *parts: str) -> bytes:
    return hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest()


def _listed(batches, key, ordinary):
    for b in batches:
        rows = set()
        for t, moved in zip(b.column("text").to_pylist(), _moves(b)):
            for s, e, kind, gender in detect(t, ordinary):
                new = _moved(kind, t[s:e], gender, key, moved)
                rows.add((kind, _digest(key, kind, canonical(kind, t[s:e])), _digest(key, kind, canonical(kind, new))))
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["type", "entity", "surrogate"])


def entities(docs: DataFrame, key: bytes, text_col: str = "text", moved: DataFrame | None = None, ordinary: frozenset[str] = frozenset()) -> DataFrame:
    """Distinct (type, entity, surrogate) as keyed digests of 128 bits. Null and empty texts have none, repeated rows count once, an
    empty table gives none; whole texts are searched, where they are read, and only digests are shuffled."""
    rows = _with_moves(docs.select(F.col(text_col).alias("text")), key, moved, ordinary)
    return rows.mapInArrow(partial(_listed, key=key, ordinary=ordinary), "type string, entity binary, surrogate binary").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """(type, surrogate, entity, n): surrogates that stand for n > 1 entities (entity null), entities with n > 1 surrogates
    (surrogate null). None for an empty table; rows that repeat count once."""
    shared = found.groupBy("type", "surrogate").agg(F.countDistinct("entity").alias("n")).where("n > 1")
    split = found.groupBy("type", "entity").agg(F.countDistinct("surrogate").alias("n")).where("n > 1")
    return shared.unionByName(split, allowMissingColumns=True).select("type", "surrogate", "entity", "n")


def resolve(docs: DataFrame, key: bytes, text_col: str = "text", ordinary: frozenset[str] = frozenset(), rounds: int = 32) -> DataFrame | None:
    """(entity, steps) for pseudonymise(): the entities, as digests, whose surrogates have to move along their order, and how far, so
    that no two share one; None if none has to.

    Of the entities that share a surrogate the one with the smallest digest keeps it. The orders are bijections, so
    there are none unless a class is wrongly told apart. However many there are, they stay a table that is joined with the texts. An
    entity with two surrogates can't be mended by moving: it is logged, and collisions() lists it. Null and empty texts
    and empty tables have no entities, repeated rows count once. Surrogates that still collide after `rounds` rounds are an error.
    """
    moved = None
    for _ in range(rounds):
        found = cut(entities(docs, key, text_col, moved, ordinary))
        clash = cut(collisions(found))
        shared = clash.where("entity is null").select("type", "surrogate")
        if shared.isEmpty():
            if not clash.isEmpty():
                logging.getLogger(__name__).warning("%d entities have more than one surrogate", clash.count())
            return moved
        first = found.join(shared, ["type", "surrogate"]).groupBy("type", "surrogate").agg(F.min("entity").alias("first"))
        again = found.join(first, ["type", "surrogate"]).where("entity <> first").select("entity").distinct().withColumn("steps", F.lit(1))
        moved = cut(again if moved is None else moved.unionByName(again).groupBy("entity").agg(F.sum("steps").cast("int").alias("steps")))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")

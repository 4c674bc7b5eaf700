"""Surrogates for personal data.

Detected entities (e-mail and IP addresses, phone, card, account and social security numbers,
names, credentials) get replacements of their own kind. A replacement is a keyed permutation of
all values of the same format: digits stay digits, vowels vowels and consonants consonants of
their script, capitals capitals; card numbers keep their check digit valid (or as invalid as it
was), account numbers their country and check digits, given names their gender and script,
Slavic surnames and given names that are not listed the ending that tells the gender; a listed given
name never stands for itself. Permuting keeps distinct values distinct, and one value has one
replacement wherever and however it is written. A name is detected after a title, after a listed
given name in capitals or not, after words that introduce one ("my name is", "signed"), and where
two capitalised words come before a verb of speech ("wrote", "said"); from then on its parts are
names in the whole document, alone as well. A name that nothing of this points to is not found.

Words are no names on weak evidence: an introduction or a verb of speech makes no name of words
that the corpus also writes in lower case (at least one in ``RARE`` of its words, so at most so many,
counted over all texts) or that are listed as common, and such words are never names alone, whatever found
them. Four numbers with dots after "version" and the like are no address, and 13 to 19 bare digits are
a card number only if their check digit holds or a word before them says so.

What the permutation can't know is checked against the corpus: the distinct entities are
gathered, and a replacement that is itself an entity of the corpus, or that another entity has
already, goes to a further attempt under another key until none is left. Documents are rewritten
in place by the first attempt; only the entities that needed another one are joined to their
documents.

Defined results: null texts stay null, empty ones empty; texts without entities stay as they are,
byte for byte; whole texts are read; rows that repeat get equal texts; rows with null ids are
rewritten like all others; an empty table gives an empty result; all columns of the input are
kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ionflow.llm import secret_scan
from ionflow.llm.common import free_name, materialise, slices

KEY = b"ionflow surrogates"
ROUNDS = 8
ATTEMPTS = 48
LONGER = 8  # from this attempt on, letters and digits are appended, so small formats can't run out

# Frequent given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sarah Sophie Marie Claire Camille Lucia Carmen Elena Marta Paula Petra Sabine Ursula Monika Ingrid Mary Linda Susan Karen Nancy Emily Alice Helen Ruth Jane Olivia Charlotte Amelia Isabella Hannah Chloe Margaret Barbara Jennifer Jessica Rebecca Patricia Elizabeth Katharina Birgit Heike Nathalie Isabelle Sofia Rosa".split(),
    ("latin", "m"): "John James Robert Michael William David Richard Thomas Charles Daniel Peter Paul Hans Klaus Jürgen Stefan Wolfgang Pierre Jacques Michel Antoine Luc Carlos Miguel Javier Pablo Diego Luis George Edward Liam Noah Oliver Henry Benjamin Matthew Andrew Joseph Anthony Steven Kevin Brian Jason Andreas Matthias Martin Laurent Philippe Alejandro Fernando Ricardo Antonio".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Людмила Екатерина".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Михаил Николай Андрей Владимир Павел Борис".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Κωνσταντίνος Ιωάννης Νικόλαος Χρήστος".split(),
}
# Titles that precede a name, and alphabets whose letters replace one another.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sra Sr Don Doña Г-н Г-жа Κύριος Κυρία".split()
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãå", "éèêë", "íìîï", "óòôöõø", "úùûü", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ"]
GENDERED = ("овская", "евская", "ская", "цкая", "ова", "ева", "ёва", "ина", "ovskaya", "skaya", "ova", "eva", "ina")
CLASS = {c: a for a in ALPHABETS for c in a}
WHOSE = {n.lower(): k for k, names in GIVEN.items() for n in names}
ORDER = ("secret", "email", "iban", "card", "ssn", "phone", "ip", "given", "surname")

_AT_LEFT = re.compile(r"[A-Za-z0-9._%+\-À-ÖØ-öø-ÿ]{1,64}\Z")
_AT_RIGHT = re.compile(r"(?:[A-Za-z0-9À-ÖØ-öø-ÿ](?:[A-Za-z0-9À-ÖØ-öø-ÿ-]{0,61}[A-Za-z0-9À-ÖØ-öø-ÿ])?\.)+[A-Za-z]{2,24}")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_CANDIDATE = re.compile(r"[+(0-9][0-9 .()/+-]{5,}")
_NUMBER = re.compile(
    rf"""(?<![\w.])(?:
      (?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})
    | (?P<ssn>\d{{3}}-\d\d-\d{{4}})
    | (?P<card>\d{{4}}(?P<gap>[ -])\d{{4}}(?P=gap)\d{{4}}(?P=gap)\d{{1,7}}|\d{{4}}[ -]\d{{6}}[ -]\d{{5}}|\d{{13,19}})
    | (?P<phone>\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|\(\d{{2,5}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}|(?:1[ .-])?\d{{3}}[.-]\d{{3}}[.-]\d{{4}}|(?:1[ ])?[2-9]\d\d[ ][2-9]\d\d[ ]\d{{4}}|\d{{3}}-\d{{4}}|0\d{{1,4}}[ /-]\d{{3,4}}[ -]\d{{3,4}}|0\d{{1,4}}[ /-]\d{{5,8}}|0\d(?:[ .]\d\d){{4}})
    )(?!\w|[.-]\d)""",
    re.X,
)
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4})*(?![\w:])")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_WORD = r"(?:[ODL]['’])?[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][^\W\d_]+"
_TITLED = re.compile(rf"(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ \xa0](?:({_WORD})[ \xa0])?({_WORD})(?:-({_WORD}))?(?!\w)")
_NAMED = re.compile(rf"({'|'.join(sorted({n for names in GIVEN.values() for n in names}, key=len, reverse=True))})[ \xa0](?:[A-Z]\.[ \xa0])?({_WORD})(?:-({_WORD}))?(?!\w)")
_LETTERS = re.compile(r"(?<![\w'’])(?:[ODL]['’](?=[A-Z]))?[^\W\d_]+(?!\w)")
# Words that introduce a name, and verbs that follow one.
BEFORE = "my name is|name|signed|sincerely|regards|contact|contact person|on behalf of|ich heiße|mein name ist|je m'appelle|mon nom est|me llamo|mi nombre es|меня зовут|με λένε".split("|")
AFTER = "wrote|writes|said|says|asked|replied|answered|signed|called|lives|schrieb|schreibt|sagte|sagt|fragte|antwortete|écrit|dit|demande|répond|escribió|dijo|preguntó|respondió|написал|написала|сказал|сказала|έγραψε|είπε".split("|")
_FULL = rf"({_WORD})[ \xa0](?:[A-Z]\.[ \xa0])?({_WORD})(?:-({_WORD}))?(?!\w)"
_INTRODUCED = re.compile(rf"(?i:(?<!\w)(?:{'|'.join(BEFORE)}))[ \xa0]?[:,]?[ \xa0\n]{_FULL}")
_SPEAKS = re.compile(rf"[ \xa0](?:{'|'.join(AFTER)})(?!\w)")
_SPEAKER = re.compile(rf"(?<![^\W\d_]){_FULL}\Z")
_CAPITALS = re.compile(r"[A-ZÀ-ÞА-ЯЁΑ-Ω]{2,}[ \xa0](?:[A-Z]\.[ \xa0])?[A-ZÀ-ÞА-ЯЁΑ-Ω]{2,}")
_NAMED_IN_CAPITALS = re.compile(rf"({'|'.join(sorted({n.upper() for names in GIVEN.values() for n in names}, key=len, reverse=True))})[ \xa0](?:[A-Z]\.[ \xa0])?({_WORD})(?:-({_WORD}))?(?!\w)")
_NAME_LENGTH = 120
# Words that a heading may capitalise after a given name; alone they are no names.
PLAIN = frozenset("a an the of in on at by to for from with and or but is was are were has had as he she it they who der die das und oder in im von mit ist war hat zu le la les de du des et ou est un une dans par el los las y en es con del por".split())


# Words of headings, institutions and places that stand in capitals without being names of people.
COMMON = frozenset("new old white black red green house street city county state states united national international general first second north south east west central press times post news daily report office bureau board council committee department ministry government court university college school institute society association company group team bank fund market marketing sales product service services support customer description title subject project program center centre research science technology development management security health public private president minister director chairman chief editor author reader user manager doctor nurse mother father brother sister king queen prince princess lord lady saint captain january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
#: A word that is at least one in so many of the corpus's words in lower case is common.
RARE = 20_000
_VERSION = re.compile(r"(?:version|release|revision|rev|section|chapter|build|firmware|ver|v)[.:#]? ?\Z", re.I)
_BOOK_CUE = re.compile(r"(?:isbn|ean|gtin|issn)(?:-1[03])?[:#]?[ ]?\Z", re.I)
_CARD_CUE = re.compile(r"(?:card|visa|mastercard|amex|karte|carte|tarjeta|kreditkarte)\W{0,3}(?:\w{1,8}\W{1,3}){0,2}\Z", re.I)

# What Arrow looks for in a whole batch of texts at once, by detector. Each pattern covers all that its detector finds,
# so a detector is only tried on the texts its pattern matches. A dotless or dotted capital i counts as an i in any case.
_CAPITAL = "[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω]"
_GIVEN = sorted({n for names in GIVEN.values() for n in names})
CUES = {
    "secret": secret_scan.BASE_CUE,
    "email": "@",
    "number": r"[+(0-9][0-9 .()/+-]{5}",
    "ip6": r"(?:[0-9A-Fa-f]{1,4}:){3}",
    "iban": r"[A-Z]{2}(?:[0-9]|[^\x00-\x7f]){2}(?: ?[A-Z0-9]{4}){2}",
    "titled": rf"(?:{'|'.join(TITLES)})\.?[ \x{{a0}}]{_CAPITAL}",
    "named": rf"(?:{'|'.join(_GIVEN)})[ \x{{a0}}]{_CAPITAL}",
    "capitals": rf"(?:{'|'.join(n.upper() for n in _GIVEN)})[ \x{{a0}}]{_CAPITAL}",
    "introduced": rf"(?i:{'|'.join(w.replace('i', '[iıİ]') for w in BEFORE)})[ \x{{a0}}]?[:,]?[ \x{{a0}}\n]{_CAPITAL}",
    "speaker": rf"{_CAPITAL}\S*[ \x{{a0}}](?:[A-Z]\.[ \x{{a0}}])?{_CAPITAL}\S*[ \x{{a0}}](?:{'|'.join(AFTER)})",
}
ALL = frozenset(CUES)

# Permutations ---------------------------------------------------------------------------------


def permute(key: bytes, label: str, x: int, size: int) -> int:
    """Keyed permutation of range(size): a Feistel network over the next even number of bits, walked until it falls inside."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            data = f"{label}|{r}|{half}|".encode() + right.to_bytes(width, "big")
            digest = b"".join(hashlib.blake2b(data + bytes([i]), key=key[:64], digest_size=64).digest() for i in range(-(-width // 64)))
            left, right = right, left ^ (int.from_bytes(digest[:width], "big") & mask)
        x = left << half | right
        if x < size:
            return x


def _alphabet(c: str) -> str:
    """The characters that may stand for a lower-case letter or digit; itself alone if it is neither."""
    found = CLASS.get(c)
    if found or not c.isalnum():
        return found or c
    at = ord(c)
    if 0x4E00 <= at <= 0x9FA5:
        return _block(0x4E00, 0x9FA5 - 0x4E00 + 1)
    return _block(at & ~31, 32) if c in _block(at & ~31, 32) else c


@lru_cache(maxsize=512)
def _block(start: int, size: int) -> str:
    return "".join(c for c in map(chr, range(start, start + size)) if c.isalpha() and c == c.lower() and len(c.upper()) == 1)


def respell(key: bytes, label: str, value: str) -> str:
    """Permute a lower-case value among all of its format."""
    sets = [_alphabet(c) for c in value]
    size, x = 1, 0
    for c, a in zip(value, sets, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)
    x = permute(key, f"{label}|{''.join(a[0] for a in sets)}", x, size)
    out = []
    for a in reversed(sets):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    return sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits)), 1)) % 10


# Kinds: canonical value -> canonical replacement ----------------------------------------------


def _digits_after(keep: int) -> Callable[[bytes, str, str], str]:
    return lambda key, label, v: v[:keep] + respell(key, label, v[keep:])


def _card(key: bytes, label: str, v: str) -> str:
    body = respell(key, label, v[:-1])
    return next(body + d for d in "0123456789" if _luhn(body + d) == _luhn(v))


def _phone(key: bytes, label: str, v: str) -> str:
    keep = 2 if v.startswith("+") else 0  # the sign and the first digit of the country code
    return v[:keep] + respell(key, label + str(keep), v[keep:])


def _ip(key: bytes, label: str, v: str) -> str:
    x = 0
    for part in v.split("."):
        x = x << 8 | int(part)
    x = permute(key, label, x, 1 << 32)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _ip6(key: bytes, label: str, v: str) -> str:
    hexes = "0123456789abcdef"
    digits = [c for c in v if c in hexes]
    x = permute(key, f"{label}|6|{len(digits)}", int("".join(digits), 16), 16 ** len(digits))
    fresh = iter(f"{x:0{len(digits)}x}")
    return "".join(next(fresh) if c in hexes else c for c in v)


def _email(key: bytes, label: str, v: str) -> str:
    name, _, host = v.rpartition("@")
    site, _, top = host.rpartition(".")
    return respell(key, label, f"{name}@{site}") + "." + top


def _iban(key: bytes, label: str, v: str) -> str:
    country, body = v[:2], respell(key, label, v[4:])
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    rest = int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97
    return country + f"{(98 - number % 97 + rest - 1) % 97:02d}" + body


def _given(key: bytes, label: str, v: str) -> str:
    """A listed name goes to the next one on a keyed circle of its group, a later attempt further on; another keeps its last letter, which tells the gender."""
    group = WHOSE.get(v)
    if not group:
        return respell(key, label + v[-1:], v[:-1]) + v[-1:]
    names = [n.lower() for n in GIVEN[group]]
    circle = sorted(range(len(names)), key=lambda i: permute(key, f"circle|{group}", i, len(names)))
    step = 1 + int(label.rpartition("|")[2]) % (len(names) - 1)
    return names[circle[(circle.index(names.index(v)) + step) % len(names)]]


def _surname(key: bytes, label: str, v: str) -> str:
    ending = next((e for e in GENDERED if v.endswith(e) and len(v) > len(e) + 1), "")
    return respell(key, label + ending, v[: len(v) - len(ending)]) + ending


def _secret(key: bytes, label: str, v: str) -> str:
    """Case counts in credentials: capitals are permuted among capitals."""
    if v.startswith("AKIA"):
        return "AKIA" + _secret(key, label + "|AKIA", v[4:])
    hexes = set(v) <= set("0123456789abcdef")
    sets = ["0123456789abcdef" if hexes else "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else c for c in v]
    size, x = 1, 0
    for c, a in zip(v, sets, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)
    x, out = permute(key, f"{label}|{''.join(a[0] for a in sets)}", x, size), []
    for a in reversed(sets):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))


KINDS: dict[str, Callable[[bytes, str, str], str]] = {
    "secret": _secret, "email": _email, "iban": _iban, "card": _card, "ssn": _digits_after(0), "phone": _phone,
    "ip": lambda key, label, v: _ip6(key, label, v) if ":" in v else _ip(key, label, v), "given": _given, "surname": _surname,
}


def surrogate(kind: str, value: str, key: bytes = KEY, attempt: int = 0) -> str:
    """Canonical replacement of a canonical value."""
    if attempt >= LONGER and kind not in ("ip", "given"):
        extra = "0" * (attempt - LONGER + 1) if kind in ("card", "ssn", "phone") else "a" * (attempt - LONGER + 1)
        at = value.rfind("@") if kind == "email" else len(value)
        value = value[:at] + extra + value[at:]
    return KINDS[kind](key, f"{kind}|{attempt}", value)


# Detection -------------------------------------------------------------------------------------


def canonical(kind: str, mention: str) -> str:
    """What all spellings of one entity share."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", mention)
    if kind == "phone":
        return "+" * ("+" in mention) + re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "")
    return mention if kind == "secret" else mention.lower()


def dress(kind: str, mention: str, value: str) -> str:
    """A canonical replacement in the spelling of a mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        fresh = iter(value.lstrip("+"))
        out = "".join([next(fresh, "") if c.isalnum() else c for c in mention])
        return out + "".join(fresh)
    if kind in ("email", "given", "surname"):
        if mention.isupper():
            return value.upper()
        if len(mention) == len(value):
            return "".join([v.upper() if m.isupper() and len(v.upper()) == 1 else v for m, v in zip(mention, value, strict=True)])
        return value[:1].upper() + value[1:] if mention[:1].isupper() else value
    return value.upper() if ":" in mention and kind == "ip" and mention.isupper() else value


def cues(texts: pa.Array) -> list[frozenset[str]]:
    """Per text the detectors that may find something in it; none for nulls."""
    out: list[frozenset[str]] = []
    for at, end in slices(texts):
        part = texts.slice(at, end - at)
        some = pc.fill_null(pc.match_substring_regex(part, "|".join(f"(?:{p})" for p in CUES.values())), False)
        held = part.filter(some)
        tested = [[name if hit else None for hit in pc.match_substring_regex(held, p).to_pylist()] for name, p in CUES.items()]
        sets = iter([frozenset(found) - {None} for found in zip(*tested, strict=True)])
        out += [next(sets) if hit else frozenset() for hit in some.to_pylist()]
    return out


def _full_names(text: str, may: frozenset[str]) -> Iterator[re.Match]:
    """Matches of full names in their contexts; the dearer patterns are only tried where a cheap look finds their cue."""
    if "titled" in may:
        yield from _TITLED.finditer(text)
    if "named" in may:
        yield from _NAMED.finditer(text)
    if "capitals" in may and _CAPITALS.search(text):
        yield from _NAMED_IN_CAPITALS.finditer(text)
    if "introduced" in may and any(w in text.lower() for w in BEFORE):
        yield from _INTRODUCED.finditer(text)
    for cue in _SPEAKS.finditer(text) if "speaker" in may else ():
        m = _SPEAKER.search(text, max(0, cue.start() - _NAME_LENGTH), cue.start())
        if m:
            yield m


def _number_kind(text: str, m: re.Match) -> str | None:
    """What a number is; None for versions and for bare digits that nothing makes a card number."""
    kind = next(k for k in ("ip", "ssn", "card", "phone") if m[k])
    before = text[max(0, m.start() - 30) : m.start()]
    if kind == "ip" and _VERSION.search(before):
        return None
    if kind == "card" and _BOOK_CUE.search(before):
        return None
    if kind == "card" and m[0].isdigit() and _luhn(m[0][:-1] + "0") != (10 - int(m[0][-1])) % 10 and not _CARD_CUE.search(before):
        return None
    return kind


def entities(text: str, common: frozenset[str] = frozenset(), may: frozenset[str] = ALL) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) in order; where kinds overlap the first in ``ORDER`` wins. ``common``: the corpus's words in lower case; ``may``: the text's ``cues``."""
    if not may:
        return []
    usual = lambda word: word.lower() in common or word.lower() in COMMON
    found: list[tuple[int, int, str]] = []
    for start, end, kind in secret_scan.base_spans(text) if "secret" in may else ():
        if kind == "assign":
            m = secret_scan._ASSIGN.match(text, start)
            start = m.start(2)
        found.append((start, end, "secret"))
    at = text.find("@")
    while at >= 0:
        left, right = _AT_LEFT.search(text[max(0, at - 64) : at]), _AT_RIGHT.match(text, at + 1)
        if left and right:
            start = at - len(left[0]) + len(left[0]) - len(left[0].lstrip(".-"))
            if start < at:
                found.append((start, right.end(), "email"))
        at = text.find("@", at + 1)
    for c in _CANDIDATE.finditer(text) if "number" in may else ():
        found += [(m.start(), m.end(), kind) for m in _NUMBER.finditer(text, c.start(), c.end() + 1) if (kind := _number_kind(text, m))]
    if "ip6" in may and ("::" in text or text.count(":") >= 3):
        found += [(m.start(), m.end(), "ip") for m in _IP6.finditer(text)]
    if "iban" in may:
        found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if len(m[0].replace(" ", "")) >= 15 and not text[max(0, m.start() - 1) : m.start()].isalnum()]
    for m in _full_names(text, may):
        listed = m.re in (_NAMED, _NAMED_IN_CAPITALS)
        if text[max(0, m.start() - 1) : m.start()].isalnum():
            continue
        if not listed and m.re is not _TITLED and any(usual(m[g]) for g in (1, 2, 3) if m[g]):
            continue  # an introduction or a verb alone makes no name of common words
        for g in (1, 2, 3):
            if m[g] and (listed or m.re is _TITLED or m[g].lower() not in PLAIN):
                given = g == 1 and (m.re is not _TITLED or m[2]) or m[g].lower() in WHOSE
                found.append((m.start(g), m.end(g), "given" if given else "surname"))
    names: dict[str, str] = {}
    for start, end, kind in found:
        if kind in ("given", "surname") and text[start:end].lower() not in PLAIN and not usual(text[start:end]):
            for spelling in (text[start:end], text[start:end].upper(), text[start:end].capitalize()):
                if names.get(spelling) != "given":
                    names[spelling] = kind
    if names:
        found += [(m.start(), m.end(), names[m[0]]) for m in _LETTERS.finditer(text) if m[0] in names]
    found.sort(key=lambda s: (ORDER.index(s[2]), s[0], -s[1]))
    taken: list[tuple[int, int, str]] = []
    for s in found:
        i = bisect(taken, s)
        if (i == 0 or taken[i - 1][1] <= s[0]) and (i == len(taken) or s[1] <= taken[i][0]):
            taken.insert(i, s)
    return taken


def replace(text: str, known: dict[tuple[str, str], str], key: bytes = KEY, common: frozenset[str] = frozenset(), may: frozenset[str] = ALL) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the spans they replaced; ``known``: replacements of later attempts; ``may``: the text's ``cues``."""
    spans = entities(text, common, may)
    out, at = [], 0
    for start, end, kind in spans:
        mention = text[start:end]
        value = canonical(kind, mention)
        out += [text[at:start], dress(kind, mention, known.get((kind, value)) or _first(kind, value, key))]
        at = end
    return "".join(out) + text[at:] if spans else text, spans


@lru_cache(maxsize=20_000)
def _first(kind: str, value: str, key: bytes) -> str:
    return surrogate(kind, value, key)


# Corpus ------------------------------------------------------------------------------------------


def key_of(id_col: str, text_col: str) -> Column:
    """What a document's later replacements are kept under: its id, or a hash of its text where that is null."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64(F.col(text_col).cast("string")).cast("string")))


def common_words(docs: DataFrame, text_col: str = "text", rare: int = RARE) -> frozenset[str]:
    """Words in lower case that are at least one in ``rare`` of all words, so at most ``rare``; counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        total = 0

        def part() -> pa.RecordBatch:
            own = [(w, n) for w, n in counts.items() if w.islower() and w.isalpha() and len(w) < 64]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([None, *(w for w, _ in own)], pa.string()), pa.array([total, *(n for _, n in own)], pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0):
                words = (text.as_py() or "").split()
                counts.update([w.rstrip(".,;:!?") for w in words])
                total += len(words)
            if len(counts) > 1 << 17:
                yield part()
                total = 0
        yield part()

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "words")
    total = sums.where("word IS NULL").agg(F.sum("n").alias("n")).first()["n"] or 0
    return frozenset(r["word"] for r in sums.where("word IS NOT NULL").where(F.col("n") * rare >= max(total, 1)).select("word").toLocalIterator())


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: frozenset[str] = frozenset()) -> DataFrame:
    """(id, kind, value): the distinct entities of each document, in canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, may in zip(b.column(0), b.column(1), cues(b.column(1)), strict=True):
                if may:
                    text = text.as_py()
                    out += [(i.as_py(), k, v) for k, v in sorted({(k, canonical(k, text[s:e])) for s, e, k in entities(text, common, may)})]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["id", "kind", "value"])

    return docs.select(key_of(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id string, kind string, value string")


def resolve(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, surrogate, attempt) of every distinct entity; no surrogate is shared or, but for given names, an entity itself."""

    def propose(attempt: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [surrogate(k, v, key, attempt) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string()), pa.array([attempt] * len(new), pa.int32())], ["kind", "value", "surrogate", "attempt"])

        return run

    shape = "kind string, value string, surrogate string, attempt int"
    everyone = materialise(found.select("kind", "value").distinct(), "entities")
    pending, settled = everyone, None
    for attempt in range(ATTEMPTS):
        tried = pending.mapInArrow(propose(attempt), shape)
        originals = everyone.where("kind <> 'given'").select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("taken"))
        taken = originals if settled is None else originals.union(settled.select("kind", "surrogate", F.lit(True).alias("taken")))
        # Of entities that want one surrogate the smallest gets it, unless it is taken.
        winners = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("winner"))
        judged = tried.join(winners, ["kind", "surrogate"]).join(taken.distinct(), ["kind", "surrogate"], "left")
        judged = materialise(judged.select("kind", "value", "surrogate", "attempt", (F.col("taken").isNull() & (F.col("value") == F.col("winner"))).alias("good")), "surrogates")
        good = judged.where("good").drop("good")
        settled = good if settled is None else settled.union(good)
        pending = judged.where("NOT good").select("kind", "value")
        if pending.isEmpty():
            return settled
    raise RuntimeError("surrogates did not settle")


def pseudonymise(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with surrogates in the text; ``spans`` adds the replaced spans (kind:start:end of the original, comma-joined)."""
    common = common_words(docs, text_col)
    found = materialise(mentions(docs, id_col, text_col, common), "mentions")
    later = resolve(found, key).where("attempt > 0")
    extra, own, id_name = free_name(docs, "later"), free_name(docs, "replaced"), free_name(docs, "key")
    per_doc = found.join(later, ["kind", "value"]).groupBy(F.col("id").alias(id_name)).agg(F.to_json(F.collect_set(F.struct("kind", "value", "surrogate"))).alias(extra))
    per_doc = materialise(per_doc, "later")  # so its size is known to the planner
    if per_doc.isEmpty():
        joined = docs.withColumn(extra, F.lit(None).cast("string"))
    else:
        joined = docs.withColumn(id_name, key_of(id_col, text_col)).join(per_doc, id_name, "left").select(*docs.columns, extra)
    at, names = [c.lower() for c in docs.columns].index(text_col.lower()), [*docs.columns, own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = cues(b.column(at))
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                texts, marks = [], []
                for text, known, may in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), seen[start : start + 512], strict=True):
                    table = {(x["kind"], x["value"]): x["surrogate"] for x in json.loads(known)} if known else {}
                    new, gone = replace(text, table, key, common, may) if may else (text, [])
                    texts.append(new)
                    marks.append(",".join(f"{k}:{s}:{e}" for s, e, k in gone))
                columns = [*part.columns[:-1], pa.array(marks, pa.string())]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(run, StructType([*docs.schema.fields, StructField(own, StringType())]))
    return out if spans else out.select(docs.columns)

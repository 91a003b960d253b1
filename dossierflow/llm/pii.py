"""Personal information in free text, found from anchors and replaced by typed placeholders.

One Aho-Corasick pass finds cues: at-signs and their disguises, schemes, street
words and words that announce an identifier or a telephone. Digits and the
letters that open an identifier are cues of their own. From each cue a
deterministic local parser expands to the left and right and validates the
boundaries, and check digits where the notation has them. Names are read from
the words of a name vocabulary, their misspellings, initials and the commas
between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import bounded
from ..session import ship_package
from .lexicon import TITLES, Names, roster_names

# Cues of e-mail addresses and of streets.
AT_SIGNS = ("@", "[at]", "(at)", "{at}", "<at>", " at ")
STREET_WORDS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "close", "crescent", "cres", "terrace", "way", "drive", "court", "square", "place", "gardens", "grove", "hill")
MORE_STREETS = ("boulevard", "blvd", "parade", "mews", "row", "walk", "quay", "highway", "circus", "wharf")
STREETS_FIRST = ("rue", "boulevard", "avenue", "chemin", "impasse", "via", "viale", "piazza", "calle", "avenida", "paseo", "plaza", "rua")
STREET_ENDS = ("straße", "strasse", "gasse", "allee", "weg", "platz", "damm", "ufer")
# Schemes, and words that announce an identifier or a telephone.
SCHEMES = {"tel:": "PHONE", "sms:": "PHONE", "callto:": "PHONE"}
ID_CUES = (
    "passport", "iban", "card", "account", "acct", "ssn", "social security", "national insurance", "nino", "nhs", "driving licence", "driver's license", "driving license", "tax id", "taxpayer", "identity",
    "id number", "id no", "id card", "steuer-id", "personalausweis", "reisepass", "konto", "pasaporte", "dni", "nif", "nie",
)
PHONE_CUES = ("phone", "telephone", "tel", "mobile", "cell", "fax", "call", "telefon", "handy", "teléfono", "móvil")

# Words after a name-like word that make it a street, place or organisation.
PLACE_WORDS = frozenset(STREET_WORDS) | frozenset("bridge yard arcade boathouse hotel car park footbridge warehouse clinic depot library market station harbour ltd limited company holdings security freight catering engineering motors recycling insurance property management school church house hospital constabulary central office".split())

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-%'")
_DOMAIN = re.compile(r"\s?([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:(?:\.|\s?[\[({]dot[\])}]\s?)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*(?:\.|\s?[\[({]dot[\])}]\s?)[A-Za-z]{2,})", re.I)
_SPOKEN = re.compile(r"([A-Za-z0-9][A-Za-z0-9-]*(?:\s+dot\s+[A-Za-z0-9-]+)*\s+dot\s+[A-Za-z]{2,})", re.I)

_HOUSE = re.compile(r"(?:\b(?:[Ff]lat|FLAT|[Aa]pt|APT|[Uu]nit|UNIT|[Ss]uite|SUITE)\.?\s+\d{1,4}[A-Za-z]?,?\s+)?\b\d{1,4}[A-Za-z]?,?\s+(?:[^\W\d_a-zß-ÿ][\w'’-]*\s+){1,4}$")
_REST = re.compile(r"\.?(?:,\s+(?:(?:[Aa]pt|APT|[Ff]lat|FLAT|[Uu]nit|UNIT|[Ss]uite|SUITE)\.?\s+\d{1,4}[A-Za-z]?|[A-ZÀ-Þ][^\W\d_]+(?:\s+(?!(?:Remarks|Contact)\b)[A-ZÀ-Þ][^\W\d_]{2,})?(?:\s+[A-Z]{1,2}\d{1,2}[A-Z]?\s+\d[A-Z]{2}\b)?))*", 0)

_PHONE = r"""
    (?:\+1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}(?:[-.\s]|\s/\s))\d{3}[-.\s]\d{4}
  | \d{3}-\d{4}
  | (?:(?:\+44|0044)\s?(?:\(0\)\s?)?|0)7\d{3}\s?\d{3}\s?\d{3}
  | (?:\+49|0049)\s?(?:\(0\)\s?)?\d{2,4}\s\d{3,8}(?:[-\s]\d{1,5})?
"""
_ID = r"""
    \d{3}(?P<sep>[-\s])\d{2}(?P=sep)\d{4}
  | \d{4}-\d{5}-\d{2}
  | [A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?![^\W_])
  | [A-Z]{2}\d{7}
  | [A-Z]{2}-[A-Z]\d{4}-\d{3}
"""
_NUMBERED = re.compile(rf"(?<![\w+])(?<!\d[-./:])(?<!\w-)(?=[+(\dA-Z])(?:(?P<phone>{_PHONE})|(?P<id>{_ID}))(?![^\W_])(?!-?\d)(?![./:]\d)", re.X)

# Numbers of any country, after a plus sign and a country code; national numbers that open with 0; payment cards; accounts.
_ABROAD = re.compile(r"(?<![\w+])\+[1-9]\d{0,2}(?:[\s.-]?\(0\))?(?:[\s.-]?\d{1,4}){2,6}(?![\w])(?!-\d)")
_NATIONAL = re.compile(r"(?<![\w+./-])(?:\(0\d{2,4}\)\s?|0\d{2,4}[\s-])\d{3,4}[\s-]\d{3,4}(?![\w])(?![-./:]\d)")
_CARD = re.compile(r"(?<![\w-])[2-6]\d{3}(?:([\s-])\d{4}\1\d{4}\1\d{1,7}|\d{11,15})(?![\w-])|(?<![\w-])3\d{3}([\s-])\d{6}\2\d{5}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)")
# What any of these holds, found much faster than they are.
_TRUNK, _LONG, _HEAD = re.compile(r"0\d{2,4}[\s)-]"), re.compile(r"\d[\d\s-]{11,}"), re.compile(r"[A-Z]{2}\d{2}")
_AFTER_CUE = re.compile(r"(?:'s)?(?:\s+(?:card|number|no|nr|num|nummer|número|id|code|account)\b\.?)*\s*(?:[:#=]|\bis\b|\bwas\b)?\s*(?=([A-Za-z0-9]))")
_ID_TOKEN = re.compile(r"[A-Z0-9]+(?:[-\s./]?[A-Z0-9]+)*(?![\w])")
_DIALLED = re.compile(r"\+?\(?\d[\d\s().-]{5,20}\d(?![\w])(?![-./:]\d)")
_STREET_FIRST = re.compile(r"(?:\s+(?:de|du|des|del|della|dei|la|le|les|los|las|da|do|dos|d'|l'))*\s+[A-ZÀ-Þ][\w'’-]*(?:[\s-]+(?:(?:de|du|des|del|della|la)\s+)?[A-ZÀ-Þ][\w'’-]*)*")
_NUMBER_BEFORE = re.compile(r"\b\d{1,4}(?:\s?(?:bis|ter|[a-zA-Z]))?,?\s+$")
_NUMBER_AFTER = re.compile(r",?\s+\d{1,4}\s?[a-zA-Z]?\b(?!\d)")
_TOWN_AFTER = re.compile(r",\s+(?:\d{4,5}\s+)?[A-ZÀ-Þ][\w'’-]+(?:[\s-][A-ZÀ-Þ][\w'’-]+)?")

_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑­]\s*\n\s*(?=[a-zß-ÿ])")
_FOLD = str.maketrans({"0": "o", "1": "l", "5": "s", "9": "g", "8": "b", "6": "b"})
# Ordinary words one letter from a name.
NOT_NAMES = frozenset("there these those where here when then they them their than that this with both other after never under merely nearly market marker corner owner".split())
# First names that are also ordinary words, and so need more than lower case.
ORDINARY = frozenset("will bill dick rich pat sue ant rob al ed jo kit sandy garden meg nat len ted mark hank tom sam drummond".split())

NONE, FIRST, SURNAME, TYPO, PLACE, MAYBE = 0, 1, 2, 3, 4, 5

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")


def _apart(items: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Items in order without those that overlap an earlier (or, from the same start, a longer) one."""
    kept: list[tuple[str, int, int]] = []
    for x in sorted(items, key=lambda x: (x[1], -x[2])):
        if not kept or x[1] >= kept[-1][2]:
            kept.append(x)
    return kept


def luhn(digits: str) -> bool:
    """Whether the check digit of a payment card's number is right."""
    return len(digits) >= 13 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether the check digits of an international account number are right."""
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


AT, STREET, FIRST_STREET, STREET_END, SCHEME, ID_CUE, PHONE_CUE = range(7)


class Finder:
    """Finds (kind, start, end) in a text; keeps what it learned about words."""

    def __init__(self, names: Names) -> None:
        import ahocorasick

        self.names = names
        self.cues = ahocorasick.Automaton()
        wanted: dict[str, list[tuple[int, int]]] = {}
        for what, cues in ((AT, AT_SIGNS), (STREET, (*STREET_WORDS, *MORE_STREETS)), (FIRST_STREET, STREETS_FIRST), (STREET_END, STREET_ENDS), (SCHEME, SCHEMES), (ID_CUE, ID_CUES), (PHONE_CUE, PHONE_CUES)):
            for cue in cues:
                wanted.setdefault(cue, []).append((what, len(cue)))
        for cue, uses in wanted.items():
            self.cues.add_word(cue, uses)
        self.cues.make_automaton()
        self.folded = {w.replace("rn", "m").replace("ri", "n").replace("cl", "d").replace("vv", "w").replace("o", "a").replace("e", "c") for w in names.firsts | names.surnames if len(w) >= 5}
        self.initials = {w[0] for w in names.firsts}
        self.kinds: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """What a word may be in a name; case matters."""
        k = self.kinds.get(word)
        if k is None:
            if len(self.kinds) > 300_000:
                self.kinds.clear()
            k = self.kinds[word] = self._kind(word)
        return k

    def _kind(self, word: str) -> int:
        low = word.lower()
        if low in PLACE_WORDS or word[0].isupper() and low.translate(_FOLD).replace("cl", "d") in PLACE_WORDS:
            return PLACE if word[0].isupper() else NONE
        if low in self.names.firsts:
            return FIRST if word[0].isupper() or low not in ORDINARY else MAYBE
        if low in self.names.surnames:
            return SURNAME if word[0].isupper() or low not in ORDINARY else NONE
        if len(low) < 4 or low in TITLES or low in NOT_NAMES:
            return NONE
        if word.isdigit() or (word.islower() and len(low) < 6):
            return NONE
        plain = low.translate(_FOLD)
        if plain in self.names.surnames or plain in self.names.firsts:
            return TYPO
        if not plain.isalpha():
            return NONE
        if len(low) < 5:
            return NONE
        if word[0].isupper() or len(low) >= 6:
            if self.names.corrected(plain):
                return TYPO
        if (word[0].isupper() or len(low) >= 6) and (self.names.composed(plain) or plain.replace("rn", "m").replace("ri", "n").replace("cl", "d").replace("vv", "w").replace("o", "a").replace("e", "c") in self.folded):
            return TYPO
        return NONE

    def anchored(self, text: str, found: list[tuple[str, int, int]]) -> None:
        """Append what local parsers read from the cues of a text."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        digits = _DIGIT.search(text) is not None
        ends = {"EMAIL": -1, "ADDRESS": -1}
        for last, uses in self.cues.iter(low):
            for what, size in uses:
                at = last + 1 - size
                if what == AT:
                    item = self._email(text, low, at, last, size) if at >= ends["EMAIL"] else None
                elif not digits:
                    continue
                elif what in (STREET, FIRST_STREET, STREET_END):
                    item = self._address(text, low, at, last, what) if at >= ends["ADDRESS"] else None
                else:
                    item = self._announced(text, low, at, last, what)
                if item:
                    found.append(item)
                    ends[item[0]] = item[2]

    def _email(self, text: str, low: str, at: int, last: int, size: int) -> tuple[str, int, int] | None:
        spoken = size == 4 and low[at] == " "
        tail = (_SPOKEN if spoken else _DOMAIN).match(text, last + 1)
        if not tail:
            return None
        start = at - 1 if not spoken and at and text[at - 1] == " " else at
        stop = start
        while start and text[start - 1] in _LOCAL:
            start -= 1
        while start < stop and text[start] in ".-'%":
            start += 1
        return ("EMAIL", start, tail.end(1)) if start < stop else None

    def _address(self, text: str, low: str, at: int, last: int, what: int) -> tuple[str, int, int] | None:
        if low[last + 1 : last + 2].isalnum():
            return None
        if what == STREET_END:  # "Lange Straße 5a, 10115 Berlin" and "Hauptstraße 12"
            start = at
            while start and not text[start - 1].isspace():
                start -= 1
            number = _NUMBER_AFTER.match(text, last + 1)
            if not number or not text[start].isupper() or low[start : last + 1] in STREET_ENDS and not text[at].isupper():
                return None
            if start == at:
                before = re.search(r"[A-ZÀ-Þ][\w'’-]*\s$", text[max(0, text.rfind(" ", 0, max(0, at - 1))) : at])
                if not before:
                    return None
                start = at - len(before[0])
            town = _TOWN_AFTER.match(text, number.end())
            return "ADDRESS", start, town.end() if town else number.end()
        if at and not text[at - 1].isspace():
            return None
        if what == FIRST_STREET:  # "14 Rue de Rivoli, Paris" and "Calle Mayor 5"
            name = _STREET_FIRST.match(text, last + 1) if text[at].isupper() else None
            if not name:
                return None
            number = _NUMBER_BEFORE.search(text, self._back(text, at, 2), at)
            after = None if number else _NUMBER_AFTER.match(text, name.end())
            if not number and (not after or low[at : last + 1] in ("avenue", "boulevard")):
                return None
            end = after.end() if after else name.end()
            town = _TOWN_AFTER.match(text, end)
            return "ADDRESS", number.start() if number else at, town.end() if town else end
        head = _HOUSE.search(text, self._back(text, at, 8), at) if at else None
        if low[at : last + 1] in MORE_STREETS and re.match(r"\s+[A-ZÀ-Þ]", text[last + 1 : last + 3]):
            return None  # "3 Brindle Quay District Office"
        return ("ADDRESS", head.start(), _REST.match(text, last + 1).end()) if head and text[at].isupper() else None

    @staticmethod
    def _back(text: str, at: int, words: int) -> int:
        """Where the so many blank-separated pieces before ``at`` begin, however long they are."""
        for _ in range(words):
            while at and text[at - 1].isspace():
                at -= 1
            while at and not text[at - 1].isspace():
                at -= 1
        return at

    @staticmethod
    def _announced(text: str, low: str, at: int, last: int, what: int) -> tuple[str, int, int] | None:
        """A telephone after a scheme or a word for one, an identifier after a word that announces it."""
        if at and (low[at - 1].isalnum() or low[at - 1] == "-") or what != SCHEME and low[last + 1 : last + 2].isalnum():
            return None
        if what == SCHEME:
            m = _DIALLED.match(text, last + 1)
            return ("PHONE", m.start(), m.end()) if m and 7 <= sum(map(str.isdigit, m[0])) <= 15 else None
        cue = _AFTER_CUE.match(text, last + 1)
        if not cue:
            return None
        begin = cue.end()
        if what == PHONE_CUE:
            if text[begin - 1] in "+(":
                begin -= 1
            m = _DIALLED.match(text, begin)
            # A year, a time or a short code is no telephone: it has a separator or a leading 0 or +.
            return ("PHONE", m.start(), m.end()) if m and 7 <= sum(map(str.isdigit, m[0])) <= 15 and (m[0][0] in "0+(" or re.search(r"\d[\s.-]\d", m[0])) else None
        m = _ID_TOKEN.match(text, begin)
        if not m:
            return None
        # The token goes on while its pieces hold digits: "AB 12 34 56 C" but not "123456789 The".
        end = begin
        for piece in re.finditer(r"[A-Z0-9]+(?:[-./][A-Z0-9]+)*", m[0]):
            if _DIGIT.search(piece[0]) or len(piece[0]) <= 2:
                end = begin + piece.end()
            else:
                break
        token = text[begin:end].rstrip(" ./-")
        bare = "".join(c for c in token if c.isalnum())
        return ("ID_NUMBER", begin, begin + len(token)) if 6 <= len(bare) <= 34 and sum(map(str.isdigit, bare)) >= max(5, len(bare) // 2) and not re.search(r"[/:]|\d\.\d", token) else None

    def numbers(self, text: str, found: list[tuple[str, int, int]]) -> None:
        """Append telephones and identifiers that their own form gives away."""
        found += [("PHONE" if m["phone"] else "ID_NUMBER", m.start(), m.end()) for m in _NUMBERED.finditer(text)]
        if "+" in text:
            found += [("PHONE", m.start(), m.end()) for m in _ABROAD.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
        if _TRUNK.search(text):
            found += [("PHONE", m.start(), m.end()) for m in _NATIONAL.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 11]
        runs = list(_LONG.finditer(text))  # one of them stands in every card and account
        for run in runs:
            if sum(map(str.isdigit, run[0])) >= 13:
                found += [("ID_NUMBER", m.start(), m.end()) for m in _CARD.finditer(text, run.start(), min(len(text), run.end() + 1)) if luhn("".join(filter(str.isdigit, m[0])))]
        for m in _IBAN.finditer(text) if runs and _HEAD.search(text) else ():
            parts, start = m[0].split(), m.start()
            while parts and not mod97("".join(parts)):  # capitals after it may have been taken for its end
                parts.pop()
            if parts:
                end = start
                for part in parts:
                    end = text.index(part, end) + len(part)
                found.append(("ID_NUMBER", start, end))

    def people(self, text: str, found: list[tuple[str, int, int]]) -> None:
        """Append the names: runs of name words and initials, joined by blanks or by one comma after a surname."""
        kind = self.kind
        words = [(m.start(), m.end(), k) for m in _WORD.finditer(text) if (k := kind(m[0])) or m.end() - m.start() == 1]
        n = len(words)
        i = before = 0
        while i < n:
            start, end, k = words[i]
            if not k or k == PLACE:
                i += 1
                continue
            if k == MAYBE and (i + 1 == n or words[i + 1][2] not in (SURNAME, TYPO) or text[end : words[i + 1][0]] != " " or text[words[i + 1][0]].isupper()):
                i += 1
                continue
            # Initials before: "I. A. Böskius", "A Fenthwaite".
            j = i - 1
            while j >= 0 and words[j][0] >= before and not words[j][2] and text[words[j][1] : start] in (". ", " ", ".", ".\n", "\n") and self._initial(text, words[j], text[words[i][0]].isupper()):
                if text[words[j][1]] != "." and start != words[i][0]:
                    break
                start = words[j][0]
                j -= 1
            head = k
            strong = k != TYPO or start != words[i][0]
            comma = False
            size = 1
            while i + 1 < n:
                a, b, kind_next = words[i + 1]
                gap = text[end:a]
                if kind_next in (PLACE, MAYBE):
                    break
                if gap == ", " or gap == ",\n":
                    # "Surname, First" and "Surname, F."
                    if comma or size > 1 or words[i][2] == FIRST or (kind_next not in (FIRST, TYPO) and not (b - a == 1 and text[b : b + 1] == ".")):
                        break
                    comma = True
                elif gap not in (" ", "\n", ". ", ".\n") or (gap[0] == "." and words[i][2]):
                    break
                if kind_next and not words[i][2] and size > 1 and head == SURNAME and not comma:
                    break  # "Paskeaux M." is over; what follows is another name
                if not kind_next:
                    if b - a != 1 or not self._initial(text, words[i + 1], text[words[i][0]].isupper()) or text[b : b + 1] != ".":
                        break
                    end = b + 1
                elif comma and size == 1 or not comma:
                    if words[i][2] in (SURNAME, TYPO) and kind_next == SURNAME and size > 1:
                        break
                    end = b
                else:
                    break
                strong = strong or kind_next in (FIRST, SURNAME)
                size += 1
                i += 1
                if comma and size > 1:
                    # Middle initials may follow the first name.
                    comma = True
            if text[start] in "QA" and text[start + 1 : start + 2] == "." and (start == 0 or text[start - 1].isspace() and text[:start].rstrip()[-1:] in ".?!)]>}-"):
                # "A. Margaret Pellova told me": the letter is a speaker's label if a whole name follows it
                rest = [w for w in words[j + 1 : i + 1] if w[0] > start]
                full = sum(w[1] - w[0] > 1 for w in rest)
                if full >= 2 or len(rest) >= 3 or (len(rest) == 2 and rest[1][1] - rest[1][0] == 1):
                    start = rest[0][0]
            before = end
            follows = words[i + 1] if i + 1 < n else None
            place = follows is not None and follows[2] == PLACE and text[end : follows[0]] in (" ", "\n")
            lone_typo = not strong and size == 1 and (start == 0 or text[start - 1 : start] == "\n" or text[max(0, start - 2) : start] in (". ", "? ", "! ")) and text[start].isupper()
            lower_typo = not strong and size == 1 and text[start].islower()
            if not place and not lower_typo and not lone_typo:
                found.append(("NAME", start, end))
            i += 1

    def _initial(self, text: str, word: tuple[int, int, int], upper: bool) -> bool:
        """Whether a single letter may stand for a first name: some known first name starts with it."""
        c = text[word[0]]
        return c.lower() in self.initials and (c.isupper() or not upper)

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """Items of a text in order, none inside another. Positions are code points."""
        where = None
        if "\n" in text and _BROKEN.search(text):
            # Read words cut at a line end as one, and remember where each letter stood.
            where, parts, at = [], [], 0
            for m in _BROKEN.finditer(text):
                where += range(at, m.start())
                parts.append(text[at : m.start()])
                at = m.end()
            where += range(at, len(text))
            text = "".join([*parts, text[at:]])
        kept: list[tuple[str, int, int]] = []
        self.anchored(text, kept)
        if _DIGIT.search(text):
            self.numbers(text, kept)
        if len(kept) > 1:
            kept = _apart(kept)
        people: list[tuple[str, int, int]] = []
        self.people(text, people)
        if kept:  # names inside addresses and the like don't count
            people = [x for x in people if all(x[2] <= y[1] or x[1] >= y[2] for y in kept)]
            kept = sorted(kept + people, key=lambda x: x[1])
        else:
            kept = people
        if where is not None:
            kept = [(k, where[a], where[b - 1] + 1) for k, a, b in kept]
        return kept


_FINDERS: dict[int, Finder] = {}


def _finder(names: Names) -> Finder:
    """One finder for each vocabulary of a worker's life."""
    key = hash((names.firsts, names.surnames))
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = Finder(names)
    return _FINDERS[key]


def _scan(batches: Iterator[pa.RecordBatch], names: Names, redact: bool) -> Iterator[pa.RecordBatch]:
    finder = _finder(names)
    for batch in bounded(batches):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        keys = [batch.column(i) for i in range(batch.num_columns - 1)]
        named = batch.schema.names[:-1]
        if redact:
            yield pa.RecordBatch.from_arrays([*keys, pa.array([replaced(t, finder.find(t)) if t else t for t in texts], pa.string())], names=[*named, "text"])
            continue
        offsets, kinds, starts, ends = [0], [], [], []
        for t in texts:
            if t:
                for k, a, b in finder.find(t):
                    kinds.append(k)
                    starts.append(a)
                    ends.append(b)
            offsets.append(len(kinds))
        items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["kind", "start_char", "end_char"])
        yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], names=[*named, "items"])


def replaced(text: str, items: list[tuple[str, int, int]]) -> str:
    """The text with every item replaced by ``[KIND]``."""
    out, at = [], 0
    for kind, a, b in items:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def _records(content_blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    both = content_blocks.select("document_id", F.col("block_id").alias("record_id"), F.lit("b").alias("kind_of"), "text").unionByName(chunks.select("document_id", F.col("chunk_id").alias("record_id"), F.lit("c").alias("kind_of"), "text"))
    return both


def personal_items(content_blocks: DataFrame, chunks: DataFrame, roster: DataFrame) -> DataFrame:
    """``document_id, record_id, kind, start_char, end_char`` of every item, positions in code points.

    Null and empty texts give no row; a record delivered twice gives its items
    once; texts of any length are read whole. Extra columns are ignored. The
    names of ``roster`` are the vocabulary; an empty roster leaves the short
    forms of first names.
    """
    spark = content_blocks.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(Names(*roster_names(roster)))
    shape = "document_id STRING, record_id STRING, kind_of STRING, items ARRAY<STRUCT<kind: STRING, start_char: INT, end_char: INT>>"
    found = _records(content_blocks, chunks).where(F.length("text") > 0).mapInArrow(lambda bs: _scan(bs, sent.value, False), shape).where(F.size("items") > 0)
    once = found.groupBy("document_id", "record_id", "kind_of").agg(F.first("items").alias("items"))
    return once.select("document_id", "record_id", F.inline("items"))


def redacted(content_blocks: DataFrame, chunks: DataFrame, roster: DataFrame) -> DataFrame:
    """``document_id, record_id, text`` with placeholders; null stays null, a record delivered twice comes once."""
    spark = content_blocks.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(Names(*roster_names(roster)))
    shape = "document_id STRING, record_id STRING, kind_of STRING, text STRING"
    return _records(content_blocks, chunks).mapInArrow(lambda bs: _scan(bs, sent.value, True), shape).dropDuplicates(["document_id", "record_id", "kind_of"]).drop("kind_of")

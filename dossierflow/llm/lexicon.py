"""Person-name vocabulary shared by the operators on text."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Short forms of first names.
NICKNAMES = {
    "alex": "alexander", "al": "alexander", "sandy": "alexander", "tony": "anthony", "ant": "anthony", "chris": "christopher", "kit": "christopher",
    "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "theodore", "theo": "theodore", "teddy": "theodore", "liz": "elizabeth", "beth": "elizabeth",
    "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "fred": "frederick", "freddie": "frederick", "gabe": "gabriel", "jen": "jennifer",
    "jenny": "jennifer", "jo": "josephine", "josie": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine",
    "leo": "leonard", "len": "leonard", "lenny": "leonard", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "mike": "michael", "mick": "michael",
    "mickey": "michael", "nate": "nathaniel", "nat": "nathaniel", "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia",
    "becky": "rebecca", "becca": "rebecca", "dick": "richard", "rick": "richard", "rich": "richard", "richie": "richard", "rob": "robert", "bob": "robert",
    "bobby": "robert", "bert": "robert", "sam": "samantha", "sammy": "samantha", "sue": "susannah", "suzie": "susannah", "susie": "susannah", "tom": "thomas",
    "tommy": "thomas", "vicky": "victoria", "vic": "victoria", "tori": "victoria", "bill": "william", "will": "william", "billy": "william", "willy": "william",
    "dima": "dmitri", "mitya": "dmitri", "hank": "henrik", "gabi": "gabriel",
}

# Titles and forms of address.
TITLES = frozenset("mr mrs ms miss dr prof professor sir dame det detective sgt sergeant officer inspector insp const constable pc dc ds di supt counsel attorney atty solicitor barrister judge lady lord rev".split())

#: Most distinct words a name vocabulary may have before it is refused (about 100 MB).
MOST_WORDS = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")


def roster_names(roster: DataFrame, most: int = MOST_WORDS) -> tuple[frozenset[str], frozenset[str]]:
    """Lower-cased first names and surnames of a roster: its first word, and the words after it.

    Distinct words are found on the executors; the vocabulary of names hardly
    grows with the roster and is refused above ``most`` words.
    """
    parts = F.split(F.lower(F.trim("full_name")), r"\s+")
    rows = roster.where("full_name is not null").select(F.posexplode(parts).alias("i", "word")).select((F.col("i") == 0).alias("first"), "word").where("word <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct name words")
    return frozenset(r["word"] for r in rows if r["first"]), frozenset(r["word"] for r in rows if not r["first"])


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours makes ``a`` into ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def deletes(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Names:
    """First names, surnames and their misspellings."""

    def __init__(self, firsts: frozenset[str], surnames: frozenset[str]) -> None:
        self.firsts = firsts | frozenset(NICKNAMES) | frozenset(NICKNAMES.values())
        self.surnames = surnames
        self.index: dict[str, set[str]] = {}
        for w in firsts | surnames:  # a short form that is misspelt is too close to ordinary words
            if len(w) >= 4 and w not in NICKNAMES:
                for d in deletes(w):
                    self.index.setdefault(d, set()).add(w)
        heads: dict[str, set[str]] = {}
        tails: dict[str, set[str]] = {}
        for w in surnames:
            for i in range(2, len(w) - 2):
                heads.setdefault(w[:i], set()).add(w)
                tails.setdefault(w[i:], set()).add(w)
        # Parts that many different surnames share: what a surname that no roster names is made of.
        self.heads = {h for h, ws in heads.items() if len(ws) >= 4}
        self.tails = {t for t, ws in tails.items() if len(ws) >= 6 and len(t) >= 3}

    def composed(self, word: str) -> bool:
        return any(word[:i] in self.heads and word[i:] in self.tails for i in range(2, len(word) - 2))

    @lru_cache(maxsize=200_000)  # noqa: B019
    def corrected(self, word: str) -> str | None:
        """The name that a misspelt lower-case word stands for, or None."""
        if len(word) < 4:
            return None
        found = {w for d in deletes(word) for w in self.index.get(d, ()) if near(word, w)}
        return min(found, key=lambda w: (w[0] != word[0], w)) if found else None

    def __getstate__(self) -> tuple[frozenset[str], frozenset[str]]:
        return self.firsts, self.surnames

    def __setstate__(self, state: tuple[frozenset[str], frozenset[str]]) -> None:
        self.__init__(*state)

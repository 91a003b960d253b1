"""Spellings of one person or organisation, linked by merge-and-rematch.

Every distinct reading of a case's spellings becomes a profile. Profiles with a
first name (and organisations) meet in blocks of surnames that are equal but for
one letter and merge; once they have settled, initials and bare surnames join the
one person they can mean. Merged profiles pool their spellings and initials, and
only they enter blocking again, until a round merges nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import bounded
from ..session import discard, materialize, ship_package
from .cooccurrence import clean_item
from .lexicon import NICKNAMES, TITLES, deletes, near

PERSON, ORGANISATION = "person", "organisation"

# Lines of business in names of organisations, with their short forms.
SECTORS = {
    "catering": "catering", "cat": "catering", "engineering": "engineering", "eng": "engineering", "engrg": "engineering", "freight": "freight", "frt": "freight",
    "holdings": "holdings", "hldgs": "holdings", "insurance": "insurance", "ins": "insurance", "motors": "motors", "mtrs": "motors", "recycling": "recycling", "recycl": "recycling",
    "security": "security", "sec": "security", "property": "property", "prop": "property", "management": "management", "mgmt": "management", "mgt": "management",
    "services": "services", "svcs": "services", "logistics": "logistics", "transport": "transport", "consulting": "consulting", "industries": "industries", "group": "group",
}
# Legal forms and words around them.
LEGAL = frozenset("ltd limited llc inc plc gmbh co company corp corporation the and of".split())

#: Profiles that a block holds at most before first names divide it.
LARGE = 200

_TOKENS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """Lower case without accents and with the usual transcriptions of letters undone."""
    return plain(word).replace("oe", "o").replace("aa", "a").replace("ae", "a").replace("ue", "u")


@lru_cache(maxsize=200_000)
def plain(word: str) -> str:
    """Lower case without accents."""
    word = unicodedata.normalize("NFKD", word.lower().replace("ø", "o").replace("æ", "a").replace("ß", "ss").replace("ł", "l"))
    return "".join(c for c in word if not unicodedata.combining(c))


#: A profile: first names, initials of first names, middle initials, surnames (or for organisations: line of business and name).
Profile = tuple[frozenset[str], frozenset[str], frozenset[str], frozenset[str]]


def person(spelling: str) -> Profile | None:
    """Profile of a person's name; None if it has no surname."""
    text = spelling.strip()
    turned = None
    if "," in text:
        head, _, tail = text.partition(",")
        turned, text = head, tail
    words = [plain(w) for w in _TOKENS.findall(text)]
    while words and words[0] in TITLES and len(words[0]) > 1:
        words.pop(0)
    if turned is not None:
        surname = [plain(w) for w in _TOKENS.findall(turned)]
        while len(surname) > 1 and surname[0] in TITLES:
            surname.pop(0)
        words += surname[-1:] if surname else []
    elif len(words) >= 2 and len(words[-1]) == 1 and len(words[0]) > 1:
        # "Paskeaux M." and "Paskeaux M. A.": initials after the surname
        cut = next(i for i, w in enumerate(words) if len(w) == 1)
        words = words[cut:] + words[cut - 1 : cut]
    if not words or len(words[-1]) == 1:
        return None
    *given, surname = words
    firsts, initials, middles = set(), set(), set()
    for k, w in enumerate(given):
        if k == 0:
            if len(w) > 1:
                firsts.add(NICKNAMES.get(w, w))
            initials |= {w[0], NICKNAMES.get(w, w)[0]}
        else:
            middles.add(w[0])
    return frozenset(map(fold, firsts)), frozenset(initials), frozenset(middles), frozenset((fold(surname), surname))


def organisation(spelling: str, certain: bool = False) -> Profile | None:
    """Profile of an organisation's name; None if nothing marks it as one."""
    words = [fold(w) for w in _TOKENS.findall(spelling)]
    kept = [w for w in words if w not in LEGAL]
    sectors = sorted({SECTORS[w] for w in kept if w in SECTORS})
    if not kept or not (sectors or certain or any(w in ("ltd", "limited", "company", "plc", "inc", "gmbh", "llc") for w in words)):
        return None
    name = "".join(w for w in kept if w not in SECTORS)
    if not name:
        return None
    return frozenset((" ".join(sectors),)), frozenset(), frozenset(), frozenset((name,))


def keys(kind: str, profile: Profile) -> set[str]:
    """Blocking keys: each surname with up to one letter left out; organisations only meet in their line of business."""
    firsts, _, _, names = profile
    out = {d for n in names for d in (deletes(n) if len(n) >= 4 else {n})}
    return out if kind == PERSON else {f"{s}|{d}" for s in firsts for d in out}


def same_name(a: frozenset[str], b: frozenset[str], support: dict[str, int]) -> int:
    """2: a name in common; 1: names one letter apart that aren't both established; 0: neither."""
    if a & b:
        return 2
    for x in a:
        for y in b:
            if min(len(x), len(y)) >= 4 and near(x, y):
                p, q = sorted((support.get(x, 1), support.get(y, 1)))
                if p < max(3, 0.3 * q):
                    return 1
    return 0


def _first_alike(a: frozenset[str], b: frozenset[str]) -> bool:
    return bool(a & b) or any(min(len(x), len(y)) >= 4 and near(x, y) for x in a for y in b)


def _join(a: Profile, b: Profile) -> Profile:
    return tuple(x | y for x, y in zip(a, b))


def full_groups(kind: str, members: list[tuple[str, Profile]], support: dict[str, int]) -> list[list]:
    """Groups [ids, profile] of organisations, or of people with a first name, within one block."""
    groups: list[list] = []

    def fits(g: Profile, p: Profile) -> bool:
        if kind == ORGANISATION:
            return bool(g[0] & p[0]) and same_name(g[3], p[3], support) > 0
        return _first_alike(g[0], p[0]) and same_name(g[3], p[3], support) > 0 and _middle_fits(g[2], p[2])

    for i, p in sorted(members, key=lambda m: m[0]):
        hits = [g for g in groups if fits(g[1], p)]
        if hits:
            hits[0][0].append(i)
            hits[0][1] = _join(hits[0][1], p)
            for g in hits[1:]:
                hits[0][0] += g[0]
                hits[0][1] = _join(hits[0][1], g[1])
                groups.remove(g)
        else:
            groups.append([[i], p])
    return groups


def _middle_fits(a: frozenset[str], b: frozenset[str]) -> bool:
    return not a or not b or bool(a & b)


def short_groups(people: list[tuple[str, int, Profile]], short: list[tuple[str, Profile]], support: dict[str, int]) -> list[list[str]]:
    """Groups of ids that mean one person: initials and bare surnames with the person they can only mean, or with each other.

    ``people``: id, number of people who look alike, profile. Where several
    equally good ones fit, a short form is in no group; one that nobody else fits
    is a group of its own.
    """

    def choose(p: Profile, among: list[list], initials: bool) -> list | None:
        scored = []
        for g in among:
            q = g[1]
            s = same_name(q[3], p[3], support)
            if not s or initials and (not (q[1] & p[1]) or not _middle_fits(q[2], p[2])):
                continue
            scored.append((2 * s + (1 if initials and q[2] & p[2] else 0), g))
        top = max((s for s, _ in scored), default=0)
        best = [g for s, g in scored if s == top]
        return best[0] if sum(g[2] for g in best) == 1 else None

    known = [[[i], p, n] for i, n, p in sorted(people, key=lambda x: x[0])]
    short = sorted(short, key=lambda x: x[0])
    alone: list[list] = []
    for i, p in (x for x in short if x[1][1]):
        target = choose(p, known, True)
        if target:
            target[0].append(i)
            continue
        if any(same_name(g[1][3], p[3], support) == 2 and g[1][1] & p[1] for g in known):
            continue  # it may mean several people
        mates = [g for g in alone if g[1][1] & p[1] and same_name(g[1][3], p[3], support) and _middle_fits(g[1][2], p[2])]
        mate = max(mates, key=lambda g: (same_name(g[1][3], p[3], support), len(g[1][2] & p[2])), default=None)
        if mate:
            mate[0].append(i)
            mate[1] = _join(mate[1], p)
        else:
            alone.append([[i], p, 1])
    loose: list[list] = []
    for i, p in (x for x in short if not x[1][1]):
        target = choose(p, known + alone, False)
        if target:
            target[0].append(i)
        elif not any(same_name(g[1][3], p[3], support) == 2 for g in known + alone):
            mate = max((g for g in loose if same_name(g[1][3], p[3], support)), key=lambda g: same_name(g[1][3], p[3], support), default=None)
            if mate:
                mate[0].append(i)
            else:
                loose.append([[i], p, 1])
    return [ids for ids, _, _ in known if len(ids) > 1] + [ids for ids, _, _ in alone + loose]


def resolve(kind: str, members: list[tuple[str, Profile]], support: dict[str, int]) -> list[tuple[str, str]]:
    """Links (id, id of its group) of one block in a single round: first those with first names, then the short forms."""
    full = [m for m in members if m[1][0]]
    groups = full_groups(kind, full, support)
    ids = {min(g[0]): g[0] for g in groups}
    short = short_groups([(min(g[0]), 1, g[1]) for g in groups], [m for m in members if not m[1][0]], support)
    for g in short:
        ids[g[0]] = ids.get(g[0], [g[0]]) + g[1:]
    return [(i, min(g)) for g in ids.values() for i in g if len(g) > 1]


_NAMES = "ARRAY<STRUCT<name: STRING, n: INT>>"
SPELLED = "grp STRING, kind STRING, spelling STRING, firsts ARRAY<STRING>, initials ARRAY<STRING>, middles ARRAY<STRING>, names ARRAY<STRING>"
#: ``keys`` are surnames but for a letter, ``parts`` first names but for a letter, ``stamp`` is the round that made the profile.
PROFILE = f"grp STRING, kind STRING, id STRING, spellings ARRAY<STRING>, firsts ARRAY<STRING>, initials ARRAY<STRING>, middles ARRAY<STRING>, names {_NAMES}, stamp INT, keys ARRAY<STRING>, parts ARRAY<STRING>"


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings of spellings that can be read as a name."""
    names = ["grp", "kind", "spelling", "firsts", "initials", "middles", "names"]
    for batch in bounded(batches):
        cols: list[list] = [[] for _ in names]
        for grp, kind, spelling in zip(*(batch.column(i).to_pylist() for i in range(3))):
            p = person(spelling) if kind == PERSON else organisation(spelling)
            if p:
                for c, v in zip(cols, (grp, kind, spelling, *(sorted(x) for x in p))):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.list_(pa.string())) for i, c in enumerate(cols)], names=names)


def _profile(row: dict) -> Profile:
    return frozenset(row["firsts"] or ()), frozenset(row["initials"] or ()), frozenset(row["middles"] or ()), frozenset(x["name"] for x in row["names"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocking keys of profiles."""
    for batch in bounded(batches):
        own, parts = [], []
        for r in batch.select(["kind", "firsts", "initials", "middles", "names"]).to_pylist():
            p = _profile(r)
            own.append(sorted(keys(r["kind"], p)))
            parts.append(sorted({d for f in p[0] for d in (deletes(f) if len(f) >= 4 else {f})}))
        lists = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, lists), pa.array(parts, lists)], names=[*batch.schema.names, "keys", "parts"])


def _support(rows: list[dict]) -> dict[str, int]:
    return {x["name"]: x["n"] for r in rows for x in r["names"]}


def _full_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        out: list[tuple[str, str, str, str]] = []
        for r in batch.to_pylist():
            groups = full_groups(r["kind"], [(m["id"], _profile(m)) for m in r["members"]], _support(r["members"]))
            out += [(r["grp"], r["kind"], i, min(ids)) for ids, _ in groups for i in ids if i != min(ids)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(4)], names=["grp", "kind", "a", "b"])


def _short_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the ids of looks, as the smallest id that looks so, with the id they are linked to."""
    for batch in bounded(batches):
        out: list[tuple[str, str, str, str]] = []
        for r in batch.to_pylist():
            looks = r["members"]
            people = [(m["id"], m["n"], _profile(m)) for m in looks if m["full"]]
            short = [(m["id"], _profile(m)) for m in looks if not m["full"]]
            people_ids = {i for i, _, _ in people}
            for ids in short_groups(people, short, _support(looks)):
                root = next((i for i in ids if i in people_ids), min(ids))
                out += [(r["grp"], r["kind"], i, root) for i in ids if i not in people_ids]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(4)], names=["grp", "kind", "a", "b"])


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``grp, kind, id, root`` (and ``changed``) of every node of undirected edges ``grp, kind, a, b``: the smallest id of its component.

    Smallest labels travel along edges and, by pointer jumping, along labels, so
    that even long chains end after few rounds. Each round is written to the
    shared folder.
    """
    both = materialize(edges.unionByName(edges.select("grp", "kind", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "name-edges")
    roots = materialize(both.groupBy("grp", "kind", F.col("a").alias("id")).agg(F.min("b").alias("m")).select("grp", "kind", "id", F.least("id", "m").alias("root")), "name-roots")
    for _ in range(most_rounds):
        near_by = both.join(roots.select("grp", "kind", F.col("id").alias("b"), F.col("root").alias("m")), ["grp", "kind", "b"]).groupBy("grp", "kind", F.col("a").alias("id")).agg(F.min("m").alias("m"))
        jump = roots.select("grp", "kind", F.col("id").alias("root"), F.col("root").alias("far"))
        moved = roots.select("grp", "kind", "id", "root").join(near_by, ["grp", "kind", "id"]).join(jump, ["grp", "kind", "root"], "left")
        new = materialize(moved.select("grp", "kind", "id", F.least("root", "m", F.coalesce("far", "root")).alias("root"), (F.least("root", "m", F.coalesce("far", "root")) != F.col("root")).alias("changed")), "name-roots")
        discard(roots)
        roots = new
        if roots.where("changed").isEmpty():
            discard(both)
            return roots
    raise RuntimeError("components did not settle")


_LINK = "grp STRING, kind STRING, a STRING, b STRING"
_LOOK = ("initials", "middles", "names")


def _blocked(profiles: DataFrame, since: int) -> DataFrame:
    """Profiles by each of their keys, as far as a profile made after round ``since`` has the key."""
    each = profiles.select("*", F.explode("keys").alias("key"))
    if not since:
        return each
    changed = profiles.where(F.col("stamp") > since).select("grp", "kind", F.explode("keys").alias("key")).distinct()
    return each.join(changed, ["grp", "kind", "key"], "left_semi")


def _meet_full(profiles: DataFrame, since: int, large: int) -> DataFrame:
    """Links between profiles with first names, and between organisations. Blocks of more than ``large`` are divided by first names but for a letter."""
    full = _blocked(profiles.where(F.size("firsts") > 0), since)
    hot = full.where(F.col("kind") == PERSON).groupBy("grp", "kind", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > large).select("grp", "kind", "key", F.lit(True).alias("hot"))
    member = F.struct("id", "firsts", "initials", "middles", "names")
    part = F.explode(F.when(F.col("hot"), F.col("parts")).otherwise(F.array(F.lit("")))).alias("part")
    placed = full.join(hot, ["grp", "kind", "key"], "left").select("grp", "kind", "key", part, member.alias("member"))
    blocks = placed.groupBy("grp", "kind", "key", "part").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)
    return blocks.select("grp", "kind", "members").mapInArrow(_full_links, _LINK).distinct()


def _meet_short(profiles: DataFrame, since: int) -> DataFrame:
    """Links of initials and bare surnames. A block holds each look (initials, middle initials, surnames) once, with the number of people who have it."""
    people = _blocked(profiles.where(F.col("kind") == PERSON), since).withColumn("full", F.size("firsts") > 0)
    looks = people.groupBy("grp", "kind", "key", "full", *_LOOK).agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("int").alias("n"))
    member = F.struct("id", "n", "full", F.array().cast("array<string>").alias("firsts"), *_LOOK)
    blocks = looks.groupBy("grp", "kind", "key").agg(F.collect_list(member).alias("members")).where(F.exists("members", lambda m: ~m["full"]))
    links = blocks.select("grp", "kind", "members").mapInArrow(_short_links, _LINK).distinct()
    # Every profile of a look goes where its first one goes.
    first = profiles.where((F.col("kind") == PERSON) & (F.size("firsts") == 0)).groupBy("grp", "kind", *_LOOK).agg(F.min("id").alias("a"), F.collect_list("id").alias("ids"))
    return links.join(first.select("grp", "kind", "a", "ids"), ["grp", "kind", "a"]).select("grp", "kind", F.explode("ids").alias("a"), "b").where("a <> b").distinct()


def resolve_names(spellings: DataFrame, large: int = LARGE) -> DataFrame:
    """``grp, kind, spelling, entity`` for distinct spellings ``grp, kind, spelling`` that can be read as a name.

    ``entity`` is the smallest spelling of a group. Null and unreadable spellings
    give no row. Rounds go on until nothing merges any more, which must come as
    each leaves fewer profiles; ``large`` changes nothing but how work is spread.
    """
    spark = spellings.sparkSession
    ship_package(spark)
    clean = spellings.where("grp is not null and spelling is not null and spelling <> ''").select("grp", "kind", "spelling").distinct()
    spelled = materialize(clean.mapInArrow(_spelled, SPELLED), "name-spellings")
    # How many first names (or cases, for organisations) a name stands with: a misspelling stands with few.
    beside = spelled.select("kind", F.explode("names").alias("name"), F.explode_outer(F.when(F.col("kind") == PERSON, F.col("firsts")).otherwise(F.array("grp"))).alias("beside"))
    support = beside.distinct().groupBy("kind", "name").agg(F.count("beside").cast("int").alias("n"))
    # People with a first name, and organisations, that read alike are one profile from the start.
    read = ["grp", "kind", "firsts", "initials", "middles", "names"]
    alone = F.when(F.size("firsts") == 0, F.col("spelling"))
    alike = spelled.groupBy(*read, alone.alias("alone")).agg(F.sort_array(F.collect_set("spelling")).alias("spellings")).withColumn("id", F.col("spellings")[0])
    named = alike.select("grp", "kind", "id", F.explode("names").alias("name")).join(support, ["kind", "name"]).groupBy("grp", "kind", "id").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("names"))
    first = alike.drop("names", "alone").join(named, ["grp", "kind", "id"]).select("grp", "kind", "id", "spellings", "firsts", "initials", "middles", "names", F.lit(1).alias("stamp"))
    profiles = materialize(first.mapInArrow(_keyed, PROFILE), "name-profiles")
    discard(spelled)
    full_until = short_until = number = 0
    while True:
        number += 1
        edges = materialize(_meet_full(profiles, full_until, large), "name-links")
        full_until = number
        if edges.isEmpty():
            discard(edges)
            edges = materialize(_meet_short(profiles, short_until), "name-links")
            short_until = number
            if edges.isEmpty():
                discard(edges)
                break
        roots = components(edges)
        rooted = profiles.drop("keys", "parts").join(roots.select("grp", "kind", "id", "root"), ["grp", "kind", "id"])
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        merged = rooted.groupBy("grp", "kind", F.col("root").alias("id")).agg(*[union(c) for c in ("spellings", "firsts", "initials", "middles", "names")], F.lit(number + 1).alias("stamp"))
        kept = profiles.join(roots.select("grp", "kind", "id"), ["grp", "kind", "id"], "left_anti")
        richer = materialize(kept.unionByName(merged.mapInArrow(_keyed, PROFILE)), "name-profiles")
        discard(profiles, edges, roots)
        profiles = richer
    return profiles.select("grp", "kind", F.explode("spellings").alias("spelling"), F.col("id").alias("entity"))


def case_spellings(ner_results: DataFrame, graph_nodes: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Distinct ``grp, kind, spelling`` of people and possible organisations of all three tables."""
    entities = ner_results.select(F.col("case_id").alias("grp"), F.explode("entities").alias("e")).select("grp", F.col("e.entity_type").alias("t"), clean_item(F.col("e.text")).alias("spelling"))
    found = entities.select("grp", F.when(F.col("t").isin("PERSON", "WITNESS", "SUSPECT"), PERSON).when(F.col("t").isin("LOCATION", "ORGANISATION", "ORGANIZATION"), ORGANISATION).alias("kind"), "spelling")
    nodes = node_spellings(graph_nodes).select("grp", "kind", "spelling")
    speakers = contradictions.select(F.col("case_id").alias("grp"), F.explode(F.array("chunk_a.speaker", "chunk_b.speaker")).alias("s")).select("grp", F.lit(PERSON).alias("kind"), clean_item(F.col("s")).alias("spelling"))
    return found.unionByName(nodes).unionByName(speakers).where("kind is not null").distinct()


def node_spellings(graph_nodes: DataFrame) -> DataFrame:
    """``node_id, grp, kind, spelling`` of person and location nodes; the spelling stands between type and case in node_id."""
    kind = F.when(F.col("node_type").isin("Person", "Witness", "Suspect"), PERSON).when(F.col("node_type").isin("Location", "Organisation", "Organization"), ORGANISATION)
    inner = F.regexp_extract("node_id", r"(?s)^[^:]*:(.*):[^:]*$", 1)
    return graph_nodes.select("node_id", F.col("case_id").alias("grp"), kind.alias("kind"), clean_item(inner).alias("spelling")).where("node_id is not null and grp is not null and kind is not null").distinct()


def entities(ner_results: DataFrame, graph_nodes: DataFrame, contradictions: DataFrame) -> DataFrame:
    """``case_id, kind, spelling, entity`` of all spellings of people and organisations."""
    return resolve_names(case_spellings(ner_results, graph_nodes, contradictions)).withColumnRenamed("grp", "case_id")


def same_nodes(ner_results: DataFrame, graph_nodes: DataFrame, contradictions: DataFrame) -> DataFrame:
    """``node_a, node_b``: pairs of nodes of one case that name the same person or organisation, smaller id first.

    Nodes that repeat with other provenance count once; null ids, cases and texts
    give no row; spellings of all tables help to decide. Extra columns are
    ignored.
    """
    resolved = resolve_names(case_spellings(ner_results, graph_nodes, contradictions))
    nodes = node_spellings(graph_nodes).join(resolved, ["grp", "kind", "spelling"])
    # The pairs of an entity are the result itself; their nodes are its few spellings.
    gathered = nodes.groupBy("grp", "kind", "entity").agg(F.array_sort(F.collect_set("node_id")).alias("ids")).where(F.size("ids") > 1)
    firsts = gathered.select(F.posexplode("ids").alias("i", "node_a"), "ids")
    return firsts.select("node_a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("node_b")).distinct()

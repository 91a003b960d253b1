"""Operators against brute force, round trips and small cases."""

import collections
import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from dossierflow.llm import cooccurrence, leakage, names, packing, pii, scans, subjects, tokenize, turns
from dossierflow.llm.lexicon import Names


# 1. pairs


def baskets(spark, rows):
    return spark.createDataFrame([(g, sorted(set(i))) for g, i in rows], "grp STRING, items ARRAY<STRING>")


def brute_pairs(rows, least, lift):
    n, single, both = collections.Counter(), collections.Counter(), collections.Counter()
    for g, items in rows:
        items = sorted(set(items))
        n[g] += 1
        single.update((g, i) for i in items)
        both.update((g, a, b) for a, b in itertools.combinations(items, 2))
    return {(g, a, b, k) for (g, a, b), k in both.items() if k >= least and k * n[g] >= lift * single[g, a] * single[g, b]}


def test_incremental_updates_equal_counting_anew(spark):
    rng = random.Random(1)
    draw = lambda: (rng.choice("xy"), rng.sample("abcdefgh", rng.randint(1, 5)))
    first = [draw() for _ in range(60)]
    gone, kept = first[:15], first[15:]
    new = [draw() for _ in range(30)]
    pairs = cooccurrence.PairTable(spark, buckets=4)
    pairs.update(None, baskets(spark, first))
    touched = pairs.update(baskets(spark, gone), baskets(spark, new))
    assert {r["grp"] for r in touched.collect()} == {"x", "y"}
    got = {(r["grp"], r["item_a"], r["item_b"], r["n_ab"]) for r in pairs.associations(2, 1).collect()}
    assert got == brute_pairs(kept + new, 2, 1)
    pairs.update(baskets(spark, kept + new), None)
    assert pairs.counts().count() == 0


def test_only_touched_groups_are_scored(spark):
    pairs = cooccurrence.PairTable(spark, buckets=2)
    pairs.update(None, baskets(spark, [("x", "ab")] * 5 + [("y", "ab")] * 5))
    touched = pairs.update(None, baskets(spark, [("y", "ab")]))
    assert {r["grp"] for r in pairs.associations(1, 1, touched).collect()} == {"y"}


def test_a_merge_rewrites_only_the_buckets_it_touches(spark):
    pairs = cooccurrence.PairTable(spark, buckets=64)
    pairs.update(None, baskets(spark, [("x", rng_items) for rng_items in itertools.combinations("abcdefghijkl", 4)]))
    first = dict(pairs.written["counts"])
    pairs.update(baskets(spark, [("x", "ab")]), baskets(spark, [("x", "ac")]))
    moved = {k for k, v in pairs.written["counts"].items() if v == 2}
    assert 0 < len(moved) <= 7 and all(pairs.written["counts"].get(k) == v for k, v in first.items() if k not in moved)
    total = {(r["a"], r["b"]): r["n"] for r in pairs.counts().collect()}
    pairs.update(baskets(spark, [("x", "ac")]), baskets(spark, [("x", "ab")]))
    assert len(total) == pairs.counts().count() == 1 + 12 + 66


def test_pairs_of_a_huge_basket_are_emitted_block_by_block(spark):
    items = [f"{i:03}" for i in range(150)]
    rows = cooccurrence.deltas(baskets(spark, [("x", items), ("x", items[:3])]), block=7)
    assert rows.where("b is null").count() == 151 + 4
    assert rows.where("b is not null").groupBy("a", "b").count().groupBy("count").count().sort("count").collect() == [(1, 150 * 149 // 2 - 3), (2, 3)]


@pytest.mark.parametrize("late", [0, 1, 400])
def test_pairs_of_late_deliveries_equal_those_of_all_rows(spark, make, late):
    rng, start = random.Random(late), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(80):
        row = {"case_id": rng.choice("xy"), "document_id": f"D{i % 9}", "chunk_id": f"c{i // 9}", "ingested_at": start + dt.timedelta(days=rng.randint(0, 60)) if rng.random() < 0.9 else None}
        row["entities"] = [{"entity_type": "PERSON", "text": t} for t in rng.sample("ABCDE", rng.randint(0, 4))]
        rows += [row, row | {"ingested_at": dt.datetime(2024, 6, 1), "entities": row["entities"][1:]}] if rng.random() < 0.2 else [row]
    now = {}
    for r in sorted(rows, key=lambda r: r["ingested_at"] or dt.datetime.min):
        now[r["case_id"], r["document_id"], r["chunk_id"]] = [e["text"].lower() for e in r["entities"]]
    want = {x[:3] for x in brute_pairs([(k[0], v) for k, v in now.items() if v], 2, 1)}
    entity = make("ner_results").schema["entities"].dataType.elementType.fieldNames()
    filled = [r | {"entities": [{f: e.get(f) for f in entity} for e in r["entities"]]} for r in rows]
    assert {tuple(r) for r in cooccurrence.frequent_pairs(make("ner_results", *filled), make("contradictions"), 2, 1, late).collect()} == want


def test_items_that_share_an_id_ask_for_another_seed(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "_id", lambda seed, grp, item=None: F.lit(1).cast("long") if seed == 0 else F.xxhash64(F.lit(seed), grp, item if item is not None else F.lit("")))
    with pytest.raises(cooccurrence.SharedId):
        cooccurrence.PairTable(spark).update(None, baskets(spark, [("x", "ab")]))
    cooccurrence.PairTable(spark, seed=1).update(None, baskets(spark, [("x", "ab")]))


# 2. turns


def turn_rows(make, roster, *blocks):
    b = make("parsed_blocks", *[{"document_id": "D", "block_id": f"b{i}", "ord": i, "speaker": s, "text": t} for i, (s, t) in enumerate(blocks)])
    r = make("speaker_roster", *[{"document_id": "D", "speaker_id": i, "full_name": n, "role": role} for i, n, role in roster])
    return [tuple(x) for x in turns.speaker_turns(b, r, run=3).orderBy("turn_no").drop("document_id").collect()]


ROSTER = [("S1", "Edward Zellrand", "interviewer"), ("S2", "Ingrid Yarmond", "suspect")]


def test_turns_of_mixed_labels(make):
    got = turn_rows(
        make, ROSTER, (None, "TRAN_1 PAGE 1"), (None, "[00:00:33] DET. ZELLRAND : Where were ermmm… you?"), (None, "Think."), (None, "(laughs)"),
        ("Ms Yamond", "At home. Q: Alone at 7:05 PM? A: Yes [coughs] alone."), (None, "<04m19s> THE SUSPECT: um, I was."), (None, None), ("", ""),
    )
    assert got == [(1, "S1", 1, 2, 4), (2, "S2", 4, 4, 2), (3, "S1", 4, 4, 4), (4, "S2", 4, 5, 4)]


def test_label_that_fits_two_people_is_decided_by_the_model():
    roster = [("S1", "Ann Hall", "interviewer"), ("S2", "Bo Hall", "witness")]
    hall = turns.Roster(roster)
    assert set(hall.resolve("Hall")) == {"S1", "S2"} and hall.resolve("B. Hall") == ("S2",)
    certain = [(("S1",), ["where", "when", "who"]), (("S2",), ["home", "bed", "sleep"])] * 4
    assert turns.decide([*certain, (("S1", "S2"), ["where"]), (("S2",), ["home"])])[-2] == "S1"


def test_a_long_utterance_is_judged_by_all_its_words():
    certain = [(("S1",), ["where", "when", "who"]), (("S2",), ["home", "bed", "sleep"])] * 4
    assert turns.decide([*certain, (("S1", "S2"), ["so"] * 200 + ["home"] * 9800)])[-1] == "S2"


def test_speech_before_any_label_has_no_turn(make):
    assert turn_rows(make, ROSTER, (None, "Hello there."), ("Q", "Yes?")) == [(1, "S1", 1, 1, 1)]


@pytest.mark.parametrize(("seed", "run", "first"), [(0, 7, ""), (1, 7, ""), (2, 1, ""), (3, 45, "Ann "), (4, 60, "Ann ")])
def test_runs_of_a_long_transcript_are_stitched(make, seed, run, first):
    rng = random.Random(seed)
    roster = [("S1", "Ann Hall", "interviewer"), ("S2", "Bo Hall", "witness"), ("S3", "Zoe Kerr", "counsel")]
    speech = {"S1": "where when who did you", "S2": "home bed i slept well", "S3": "objection my client will not"}
    blocks = []
    for i in range(90):
        who = rng.choice(sorted(speech))
        label = rng.choice([{"S1": "Ann Hall", "S2": "Bo Hall", "S3": "Kerr"}[who], None, None, "", {"S1": "Hall" if first else "A. Hall", "S2": "Hall" if first else "B Hall", "S3": "Kerr"}[who]])
        text = rng.choice([" ".join(rng.sample(speech[who].split(), 3)), " ".join(rng.sample(speech[who].split(), 4)), "(coughs)", None])
        blocks += [{"document_id": "D", "block_id": f"b{i}", "ord": i, "speaker": label, "text": text}] * rng.choice([1, 1, 2])
    people = [{"document_id": "D", "speaker_id": i, "full_name": n, "role": r} for i, n, r in roster]
    whole, cut = ([tuple(r) for r in turns.speaker_turns(make("parsed_blocks", *blocks), make("speaker_roster", *people), with_text=True, run=n).orderBy("turn_no").collect()] for n in (turns.RUN, run))
    assert whole == cut and len(whole) > 10


def test_profiles_are_those_of_the_whole_document(make):
    roster = [("S1", "Ann Hall", "interviewer"), ("S2", "Bo Hall", "witness")]
    said = [("Ann Hall", "where when who"), ("Bo Hall", "home bed sleep")] * 6 + [(None, "(pause)")] * 40 + [("Hall", "home sleep"), ("Hall", "where who")]
    blocks = [{"document_id": "D", "block_id": f"b{i}", "ord": i, "speaker": s, "text": t} for i, (s, t) in enumerate(said)]
    people = [{"document_id": "D", "speaker_id": i, "full_name": n, "role": r} for i, n, r in roster]
    got = [r["speaker_id"] for r in turns.speaker_turns(make("parsed_blocks", *blocks), make("speaker_roster", *people), run=4).orderBy("turn_no").collect()]
    assert got == ["S1", "S2"] * 6 + ["S1"] or got[-1] == "S1" and got[-2] == "S2"


# 4. names


def linked(*spellings):
    groups = collections.defaultdict(set)
    members = [(s, names.person(s)) for s in spellings]
    for i, g in names.resolve(names.PERSON, members, {}):
        groups[g].add(i)
    return sorted(map(sorted, groups.values()))


def test_variants_of_a_person():
    same = ["dmitri dorman", "dmitri dorrman", "dorman, dmitri", "d. dorman", "dorman d.", "dorman", "dr. dorman", "dima dorman"]
    assert linked(*same, "jennifer alneaux") == [sorted(same)]


def test_ambiguous_variants_stay_alone():
    assert linked("frederick alneaux", "jennifer alneaux", "alneaux") == []
    assert linked("mary hall", "martin hall", "m. hall") == []
    assert linked("priya e. ilmrand", "priya a. ilmrand") == []


def test_variants_of_an_organisation():
    one = names.organisation("Isenhold Motors Ltd")
    for s in ("isenhold mtrs ltd", "motors isenhold limited", "The Isenhold Motors Company", "isenhold-motors ltd"):
        assert names.organisation(s) == one, s
    assert names.organisation("isenhold holdings ltd") != one and names.organisation("heron depot") is None


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([("g", "k", f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("h", "k", "a", "b")], "grp STRING, kind STRING, a STRING, b STRING")
    roots = names.components(edges)
    assert {(r["grp"], r["root"]) for r in roots.collect()} == {("g", "000"), ("h", "a")} and roots.count() == 63


def spelled(spark, *spellings, grp="g"):
    return spark.createDataFrame([(grp, names.PERSON, s) for s in spellings], "grp STRING, kind STRING, spelling STRING")


def entity_groups(rows):
    groups = collections.defaultdict(set)
    for r in rows.collect():
        groups[r["grp"], r["entity"]].add(r["spelling"])
    return {frozenset(v) for v in groups.values()}


def test_short_forms_meet_without_a_person(spark):
    assert entity_groups(names.resolve_names(spelled(spark, "m. hall", "hall m.", "kerr", "KERR", "mr kerr"))) == {frozenset({"m. hall", "hall m."}), frozenset({"kerr", "KERR", "mr kerr"})}


def test_rounds_go_on_until_nothing_merges(spark):
    # Each name is one letter from the next, and all are rare: pooled spellings link the whole chain.
    chain = ["abbbbbbb", "aabbbbbb", "aaabbbbb", "aaaabbbb", "aaaaabbb", "aaaaaabb", "aaaaaaab", "aaaaaaaa", "caaaaaaa", "ccaaaaaa", "cccaaaaa"]
    assert entity_groups(names.resolve_names(spelled(spark, *[f"dmitri {w}" for w in chain]))) == {frozenset(f"dmitri {w}" for w in chain)}


def test_divided_blocks_change_nothing(spark):
    rng = random.Random(2)
    firsts = ["margaret", "margeret", "meg", "martin", "mary", "dmitri", "dima", "zoe", "m.", "d.", "z."]
    rows = {f"{rng.choice(firsts)} {rng.choice(['', 'a. ', 'e. '])}{rng.choice(['hallmark', 'halmark', 'hallmork', 'dorman', 'dormann'])}" for _ in range(150)} | {"hallmark", "dorman", "hallmark m."}
    whole, divided = (entity_groups(names.resolve_names(spelled(spark, *rows), large=n)) for n in (1000, 2))
    assert whole == divided and 5 < len(whole) < len(rows)


# 5. scans


def speller():
    return scans.Speller({w: 100 for w in "the of a was staircase nervous before nobody building two-storey blood-stained entered and described figure witness recording clear".split()})


@pytest.mark.parametrize(("seen", "meant"), [("bef0re", "before"), ("riobody", "nobody"), ("biii1ding", "building"), ("nervoiis", "nervous"), ("entcrcd", "entered"), ("6lood-stoined", "blood-stained"), ("figure", "figure"), ("zzz", None)])
def test_confusions_are_undone(seen, meant):
    assert speller().correct(seen) == meant


def test_words_cut_torn_and_misread():
    bodies = [(0, "A witness described the figure as ne-\nrvous and the two-\nstorey bui lding was clear. No6ody ent¬"), (1, "ered the stair case before.")]
    found, stream = scans.repairs(bodies, speller())
    assert found == [(0, "nervous"), (0, "two-storey"), (0, "building"), (0, "nobody"), (0, "entered"), (1, "staircase")]
    assert stream[-1] == "before." and "building" in stream


def test_page_furniture():
    page = [("Sheet 2  Caldermoor District Office", "", True), ("SCENE LOG PELLWORTH", "", False), ("He went home because it was late.", "", False), ("14", "", False), ("- 2 -", "", True)]
    assert [scans.STATES[s] for s in scans.label_page(page, 2)] == ["header", "break", "body", "break", "footer"]


def test_runs_do_not_change_findings(spark, table):
    one, many = (scans.scan_findings(table("content_blocks"), table("parsed_blocks"), size=n).collect() for n in (scans.RUN, 64))
    assert len(set(one) ^ set(many)) <= 0.005 * len(one)


@pytest.mark.parametrize("held", [0, 40, 400])
def test_words_that_no_task_holds_are_asked_for(spark, table, held):
    every, few = (scans.scan_findings(table("content_blocks"), table("parsed_blocks"), most_held=n) for n in (scans.MOST_HELD, held))
    assert sorted(few.collect()) == sorted(every.collect())


def test_corrections_of_endless_words_end():
    assert speller().correct("l" * 20_000) is None and speller().correct("rn" * 5000) is None and speller().correct("0c1" * 3000) is None


def test_long_running_headers(make):
    title = "Caldermoor and Northern Marches District Constabulary Joint Investigation Unit Records Office"
    rows = []
    for page in range(1, 5):
        for text in (f"{title} {page}", f"On page {page} the landlord said that nobody had entered the building before noon, and that the door was locked.", f"Later on page {page} a neighbour confirmed this in writing."):
            rows.append({"document_id": "D", "block_id": f"b{len(rows)}", "ord": len(rows), "page": page, "text": text})
    got = {r["block_id"] for r in scans.scan_findings(make("content_blocks", *rows), make("parsed_blocks")).where("kind = 'header'").collect()}
    assert got == {"b0", "b3", "b6", "b9"}


def test_words_are_repaired_wherever_a_scanned_document_breaks_its_lines(make):
    plain = [{"document_id": "W", "block_id": f"w{i}", "ord": i, "page": 1, "text": "Nobody entered the building before noon."} for i in range(40)]
    rows = [{"document_id": "D", "block_id": f"b{i}", "ord": i, "page": i // 5, "text": "N0body entered the building before noon."} for i in range(100)]
    rows.append({"document_id": "D", "block_id": "b100", "ord": 100, "page": 20, "text": "Nobody entered the buil-\nding before noon."})
    words = [r["word"] for r in scans.scan_findings(make("content_blocks", *plain, *rows), make("parsed_blocks"), size=40).where("kind = 'word' and document_id = 'D'").collect()]
    assert sorted(words) == ["building"] + ["nobody"] * 100


def test_the_page_model_is_learned_from_counts():
    seen = {("form", "digits", scans.HEADER): 10_000, ("place", "first", scans.HEADER): 10_000, ("open", "", scans.HEADER): 10_000, ("move", str(scans.HEADER), scans.BODY): 10_000}
    guess, learned = scans.Layout(), scans.Layout().learned(seen)
    assert learned.forms["digits"][scans.HEADER] > guess.forms["digits"][scans.HEADER] and learned.opens[scans.HEADER] > guess.opens[scans.HEADER]
    assert abs(sum(map(math.exp, (*learned.moves[scans.HEADER], learned.closes[scans.HEADER]))) - 1) < 0.1


# 6. personal information

FINDER = pii.Finder(Names(frozenset({"dmitri", "zoë", "margaret"}), frozenset({"dorman", "halden", "lévova", "paskeaux", "garden", "wexley"})))


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("Mail dmitri.dorman@inbox.test or o.ulm [at] team-mail.example.", [("EMAIL", "dmitri.dorman@inbox.test"), ("EMAIL", "o.ulm [at] team-mail.example")]),
        ("reach zoe at mailhub dot example now, at home", [("EMAIL", "zoe at mailhub dot example")]),
        ("call +1-982-555-0177, (785) 555-0165 or 0049 (0)30 23125-038; sheet 555-0142-07", [("PHONE", "+1-982-555-0177"), ("PHONE", "(785) 555-0165"), ("PHONE", "0049 (0)30 23125-038")]),
        ("ids 906-07-5520 and QQ 47 61 10 C and DL-K9132-993, file 24-0002-D", [("ID_NUMBER", "906-07-5520"), ("ID_NUMBER", "QQ 47 61 10 C"), ("ID_NUMBER", "DL-K9132-993")]),
        ("The tenant of Flat 3, 42 Old Kiln Ave gave", [("ADDRESS", "Flat 3, 42 Old Kiln Ave")]),
        ("to 69b Drovers Avenue, Marlow Sands NK8 9EX and signed", [("ADDRESS", "69b Drovers Avenue, Marlow Sands NK8 9EX")]),
        ("The Halden Bridge and 5 Wexley Lane but Dr. Halden's key", [("ADDRESS", "5 Wexley Lane"), ("NAME", "Halden")]),
        ("PASKEAUX, MARGARET met Z. Lévova, Dorman D. and dmitri dormann in the garden.", [("NAME", "PASKEAUX, MARGARET"), ("NAME", "Z. Lévova"), ("NAME", "Dorman D."), ("NAME", "dmitri dormann")]),
        ("A. Margaret Dorman told me. Q. Z. Lévova and A. B. Dorman and Dorman D. Zoë", [("NAME", "Margaret Dorman"), ("NAME", "Z. Lévova"), ("NAME", "A. B. Dorman"), ("NAME", "Dorman D."), ("NAME", "Zoë")]),
        ("12 Worthingtonchesterfieldham Upperbridgewater Northamptonshiregate Kingsbridgemouth Road, Leeds", [("ADDRESS", "12 Worthingtonchesterfieldham Upperbridgewater Northamptonshiregate Kingsbridgemouth Road, Leeds")]),
        ("ring 020 7946 0958 or +33 1 42 68 53 00 or tel:+442079460958, not 2024-01-05 10:11", [("PHONE", "020 7946 0958"), ("PHONE", "+33 1 42 68 53 00"), ("PHONE", "+442079460958")]),
        ("card 4111 1111 1111 1111 and 4111-1111-1111-1112, order 1234567890123", [("ID_NUMBER", "4111 1111 1111 1111")]),
        ("to DE89 3704 0044 0532 0130 00 THE BANK, not DE89 3704 0044 0532 0130 01", [("ID_NUMBER", "DE89 3704 0044 0532 0130 00")]),
        ("passport 123456789 and passport no. X12345678; the account was closed in 2023, account number: 00123456", [("ID_NUMBER", "123456789"), ("ID_NUMBER", "X12345678"), ("ID_NUMBER", "00123456")]),
        ("5 Elm Boulevard, York; 14 Rue de Rivoli, Paris; Lange Straße 5a, 10115 Berlin; Calle Mayor 5", [("ADDRESS", "5 Elm Boulevard, York"), ("ADDRESS", "14 Rue de Rivoli, Paris"), ("ADDRESS", "Lange Straße 5a, 10115 Berlin"), ("ADDRESS", "Calle Mayor 5")]),
        ("Mobile: 07700 900123, phone 555 2024", [("PHONE", "07700 900123"), ("PHONE", "555 2024")]),
        ("Nothing here at all.", []),
    ],
)
def test_personal_items(text, items):
    assert [(k, text[a:b]) for k, a, b in FINDER.find(text)] == items


def test_redaction_keeps_the_rest():
    text = "Dmitri Dor-\nman lives at 5 Wexley Lane 😀 with two relatives."
    assert pii.replaced(text, FINDER.find(text)) == "[NAME] lives at [ADDRESS] 😀 with two relatives."


def test_very_long_text():
    text = "Dmitri Dorman was here. " * 20_000
    assert len(FINDER.find(text)) == 20_000


# 7. packing


@pytest.mark.parametrize("seed", range(40))
def test_packing_is_optimal_on_small_documents(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]

    def fewest(left, free):
        if not left:
            return len(free)
        best = len(items)
        for k in sorted(set(range(len(free)))):
            if free[k] >= left[0]:
                best = min(best, fewest(left[1:], (*free[:k], free[k] - left[0], *free[k + 1 :])))
        return min(best, fewest(left[1:], (*free, 20 - left[0])))

    bound = packing.lower_bound(items, 20)
    bins = packing.evolve(items, 20, bound, seed)
    assert sorted(n for b in bins for n in b) == sorted(items) and all(sum(b) <= 20 for b in bins)
    assert packing.exact_count(items, 20, bound, len(bins)) == fewest(tuple(items), ())
    assert bound <= fewest(tuple(items), ())


@pytest.mark.parametrize("seed", range(10))
def test_closing_pairs_keeps_the_optimum(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 20) for _ in range(10)]
    lengths = dict(collections.Counter(items))
    closed = packing.close_pairs(lengths, 20)
    rest = [n for n, k in lengths.items() for _ in range(k)]
    count = lambda x: packing.exact_count(x, 20, packing.lower_bound(x, 20), len(packing.best_fit(x, 20))) if x else 0
    assert closed + count(rest) == count(items) and closed * 20 + sum(rest) == sum(items)


def test_genetic_operators_keep_all_items():
    rng = random.Random(3)
    items = [rng.randint(20, 90) for _ in range(60)]
    a, b = packing.best_fit(items, 200), packing.slack_fit(items, 200, rng)
    for child in (packing.crossover(a, b, 200, rng), packing.mutate(a, 200, rng)):
        assert sorted(n for x in child for n in x) == sorted(items) and max(map(sum, child)) <= 200


def test_long_blocks_fill_gaps_and_islands_agree(make):
    words = lambda n: " ".join(["w"] * n)
    rows = [{"document_id": d, "block_id": f"{i}", "clean_text": words(n) if n else None} for d, ns in {"A": [150, 150, 300], "B": [0], "C": [72, 74, 78, 83, 86, 87, 88, 89, 93], "D": [100] * 9, "E": [401]}.items() for i, n in enumerate(ns)]
    got = {r["document_id"]: r["n_containers"] for r in packing.pack(make("cleaned_blocks", *rows, rows[0]), islands=3).collect()}
    assert got == {"A": 3, "B": 0, "C": 5, "D": 5, "E": 3}


def test_one_huge_document(spark):
    rng = random.Random(5)
    lengths = [rng.randint(5, 190) for _ in range(5000)] + [50] * 5000
    blocks = spark.createDataFrame([("D", str(i), n) for i, n in enumerate(lengths)], "document_id STRING, block_id STRING, n INT").select("document_id", "block_id", F.repeat(F.lit("w "), F.col("n")).alias("clean_text"))
    got = packing.pack(blocks).collect()[0]["n_containers"]
    assert -(-sum(lengths) // 200) <= got <= -(-sum(lengths) // 200) * 1.01


def test_huge_groups_of_equal_lengths_share_containers(spark):
    lengths = [("A", 50)] * 1000 + [("A", 149)] * 1000 + [("B", n) for n in (61, 67, 71, 73, 59, 83) for _ in range(300)]
    blocks = spark.createDataFrame([(d, str(i), n) for i, (d, n) in enumerate(lengths)], "document_id STRING, block_id STRING, n INT").select("document_id", "block_id", F.repeat(F.lit("w "), F.col("n")).alias("clean_text"))
    got = {r["document_id"]: r["n_containers"] for r in packing.pack(blocks).collect()}
    assert got["A"] == 1000
    assert got["B"] == packing.relaxed(collections.Counter(n for d, n in lengths if d == "B"), 200)[0]


@pytest.mark.parametrize("seed", range(10))
def test_histograms_pack_as_single_items_do(seed):
    rng = random.Random(seed)
    counts = collections.Counter({n: rng.randint(1, 40) for n in rng.sample(range(1, 200), 15)})
    a, b = packing.best_fit_counts(counts, 200), packing.slack_fit_counts(counts, 200, rng)
    assert a.total() == len(packing.best_fit(counts.elements(), 200))
    bound, c = packing.relaxed(counts, 200)
    assert packing.lower_bound(counts, 200) <= c.total() and bound <= min(a.total(), b.total(), c.total())
    for packed in (a, b, c, packing.crossover_counts(a, b, 200, rng), packing.mutate_counts(a, 200, rng)):
        held = collections.Counter()
        for x, k in packed.items():
            assert sum(x) <= 200 and k > 0
            held.update({n: m * k for n, m in collections.Counter(x).items()})
        assert held == counts


# 8. tokens


@pytest.mark.parametrize("common", [0, 200, 200_000])
def test_ids_equal_the_library(spark, table, common):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    odd = ["", None, " ", "\r\n\t x", "１２ 👩‍🔬 é", "a" * 3000, "<|endoftext|> don't", "\x00\x07", "東京 ẞ", "  two  spaces  "]
    own = spark.createDataFrame(list(enumerate(odd)), "doc_id BIGINT, text STRING")
    docs = table("documents").select("doc_id", "text").union(own.withColumn("doc_id", F.col("doc_id") - 100))
    texts = dict(docs.collect())
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_corpus(docs, most_common=common).collect()}
    assert got == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}


def test_repeated_and_null_document_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "zwei"), (2, None)], "doc_id BIGINT, text STRING")
    got = tokenize.encode_corpus(docs, most_common=1).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in got) == [(0, 2), (1, 2), (1, 2), (2, 0)]


def test_a_piece_is_replayed_once_for_the_corpus(spark, table):
    rows = tokenize.piece_ids(table("documents").select("doc_id", "text").repartition(5), most_held=50)
    texts = [r["text"] for r in table("documents").collect() if r["text"]]
    want = collections.Counter(p for t in texts for p in tokenize._cutter()(t))
    assert {r["piece"]: r["n"] for r in rows.collect()} == want and rows.count() == len(want)


# 9. leaks


def windows(text):
    w = leakage.words(text or "")
    return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}


def test_leaks_equal_brute_force_both_ways(spark, table):
    items = {r["item_id"]: windows(r["text"]) for r in table("eval_items").collect()}
    want = {(r["doc_id"], i) for r in table("documents").collect() for i, w in items.items() if w & windows(r["text"])}
    for size in (leakage.PASS_WORDS, 2000):  # one pass, and several
        got = leakage.leaks(table("documents"), table("eval_items").union(table("eval_items")), pass_words=size).where("copied > 0")
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_reparameterised_item(spark):
    item = spark.createDataFrame([(1, "Explain why falconer number 48 preferred the walnut festival over the glass negotiation.")], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame([(1, "explain WHY falconer number 77 preferred -- the walnut festival over the glass negotiation!"), (2, "Explain why falconer number 48 preferred the walnut.")], "doc_id BIGINT, text STRING")
    rows = leakage.leaks(docs, item).collect()
    assert [(r["doc_id"], r["copied"], r["renamed"]) for r in rows] == [(1, 0, 2)]


@pytest.mark.parametrize("size", [leakage.PASS_WORDS, 5])
def test_names_that_no_item_holds_are_renamed(spark, size):
    item = "Explain why Madame Okavell preferred the walnut festival over the glass negotiation."
    items = spark.createDataFrame([(1, item), (2, "We hope that at least twelve plain words of a second item stand here.")], "item_id BIGINT, text STRING")
    texts = [
        item.replace("Madame Okavell", "Signora Élodie"), item.replace("Okavell", "Hope"), item.replace("Okavell", "hopper"), item.replace("Explain why Madame", "EXPLAIN WHY MADAME"),
        item.replace("Madame Okavell", "Brunelli Brunelli"), item.replace("Explain why Madame Okavell", "EXPLAIN Why Madame Hope"),
    ]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id BIGINT, text STRING")
    rows = leakage.leaks(docs, items, pass_words=size).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["item_id"], r["copied"], r["renamed"]) for r in rows] == [(1, 1, 0, 1), (2, 1, 0, 1), (4, 1, 1, 0), (6, 1, 0, 1)]


FRESH = ["Quenby", "Vantongeren", "Oyelaran", "Zsófia", "Brannigan", "Ferreira", "Thackeray", "Ngugi", "Lindqvist", "Mbeki"]


def test_passes_change_nothing(spark, table):
    rows = [sorted(map(tuple, leakage.leaks(table("documents"), table("eval_items"), pass_words=n).collect())) for n in (leakage.PASS_WORDS, 1500)]
    assert rows[0] == rows[1]


def test_recall_of_reparameterised_items(spark, table):
    """Every number and every name of each item is replaced by one that no item holds; the rest stays."""
    rng = random.Random(4)
    planted, expected = [], set()
    for r in table("eval_items").collect():
        item, fresh = leakage.Item(r["item_id"], r["text"]), {}
        if len(item.words) < 12 or not any(k in (leakage.NUMBER, leakage.NAME) for k in item.slots.values()):
            continue
        numbers, people = iter(rng.sample(range(100, 9999), 200)), iter(rng.sample(FRESH, len(FRESH)))
        for w, kind in item.slots.items():
            fresh[w] = str(next(numbers)) if kind == leakage.NUMBER else next(people, None) if kind == leakage.NAME else None
        text = leakage.WORD.sub(lambda m: fresh.get(m[0].lower()) or m[0], r["text"])
        planted.append((r["item_id"], f"Seen before. {text} Seen after."))
        expected.add((r["item_id"], r["item_id"]))
    docs = spark.createDataFrame(planted, "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, table("eval_items")).collect()}
    assert len(expected) >= 30 and len(got & expected) >= 0.95 * len(expected), (len(expected), len(got & expected))
    print("recall of re-parameterised items", len(got & expected), len(expected))


# 10. subjects


def test_inflected_words_count_by_their_letter_groups(spark):
    trades = {"fire": ["smoke", "blaze", "arson"], "ships": ["anchor", "harbour", "sailor"], "law": ["verdict", "appeal", "lawyer"]}
    kinds = sorted(trades)
    rows = [(d, " ".join(f"The {w} was noted." for w in trades[kinds[d % 3]])) for d in range(90)]
    labels = spark.createDataFrame([(d, kinds[d % 3]) for d in range(90)], "doc_id BIGINT, subject STRING")
    docs = spark.createDataFrame([*rows, (100, "Many harbours were noted."), (101, "Both verdicts were noted."), (102, "Unrelated people were noted.")], "doc_id BIGINT, text STRING")
    areas = spark.createDataFrame([(k, None) for k in kinds], "subject STRING, description STRING")
    got = {tuple(r) for r in subjects.document_subjects(docs, labels, areas, steps=40).collect() if r["doc_id"] >= 100}
    assert got == {(100, "ships"), (101, "law")}


def test_held_out_subjects(spark):
    rng = random.Random(0)
    trades = {"fire": ["smoke", "blaze", "arson"], "ships": ["anchor", "hull", "harbour"], "law": ["jury", "verdict", "appeal"]}
    rows, labels = [], []
    for d in range(400):
        kind = rng.sample(sorted(trades), rng.choice([1, 1, 2]))
        text = [f"The {rng.choice(trades[k])} was {rng.choice(['noted', 'seen', 'listed'])} by {rng.choice('ABCDEFGH')}arl." for k in kind for _ in range(3)] + ["Nothing else was recorded."] * 3
        rng.shuffle(text)
        rows.append((d, " ".join(text)))
        labels += [(d, k) for k in kind]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    known = spark.createDataFrame([x for x in labels if x[0] < 250], "doc_id BIGINT, subject STRING")
    areas = spark.createDataFrame([(k, None) for k in trades], "subject STRING, description STRING")
    got = {tuple(r) for r in subjects.document_subjects(docs, known, areas, steps=40).collect()}
    want = {x for x in labels if x[0] >= 250}
    assert {x for x in got if x[0] >= 250} == want


def test_passing_mention(spark):
    model = subjects.sentences("One. Two\nThree! 4 5. Six?")
    assert model == [["one"], ["two"], ["three"], ["six"]]

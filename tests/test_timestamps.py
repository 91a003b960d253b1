import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from dossierflow.operators.timestamps import normalize_timestamps

DAY = dt.date(2024, 5, 6)


def run(make, entries, office="OF-BER", day=DAY):
    blocks = make("cleaned_blocks", {"document_id": "D", "block_id": "b", "office_code": office, "reference_date": day, "raw_timestamps": entries})
    offices = make(
        "offices",
        {"office_code": "OF-BER", "time_zone": "Europe/Berlin", "date_order": "DMY"},
        {"office_code": "OF-NYC", "time_zone": "America/New_York", "date_order": "MDY"},
        {"office_code": "OF-SYD", "time_zone": "Australia/Sydney", "date_order": "DMY"},
    )
    return {r["pos"]: r["utc"] for r in normalize_timestamps(blocks, offices).collect()}


@pytest.mark.parametrize(
    ("entry", "office", "utc"),
    [
        ("2024-07-11T13:46:29.641925+02:00", "OF-NYC", "2024-07-11T11:46:29.641Z"),
        ("20221226 1258", "OF-SYD", "2022-12-26T01:58:00.000Z"),
        ("1701632337", "OF-NYC", "2023-12-03T19:38:57.000Z"),
        ("1648231366687", "OF-SYD", "2022-03-25T18:02:46.687Z"),
        ("2024-148 00:13", "OF-BER", "2024-05-26T22:13:00.000Z"),
        ("03/04/24 1.05 p.m.", "OF-BER", "2024-04-03T11:05:00.000Z"),
        ("03/04/24 1.05 p.m.", "OF-NYC", "2024-03-04T18:05:00.000Z"),
        ("12:00 am", "OF-BER", "2024-05-05T22:00:00.000Z"),
        ("yesterday at 05:26", "OF-NYC", "2024-05-05T09:26:00.000Z"),
        ("1103 hours", "OF-BER", "2024-05-06T09:03:00.000Z"),
        ("2023-09-04 20:53 EST", "OF-NYC", "2023-09-05T01:53:00.000Z"),
        ("2023-09-04 20:53 EST", "OF-SYD", "2023-09-04T10:53:00.000Z"),
        ("30 Oct 2022 02:15 (CEST)", "OF-BER", "2022-10-30T00:15:00.000Z"),
        ("Sat, 7 May 2022 02:09:13 -0330", "OF-NYC", "2022-05-07T05:39:13.000Z"),
        ("1st October 2024, 15:07", "OF-SYD", "2024-10-01T05:07:00.000Z"),
    ],
)
def test_notations(make, entry, office, utc):
    assert run(make, [entry], office) == {0: utc}


@pytest.mark.parametrize("blanks", [" " * 60, "\t" * 400, "\u00a0 " * 20_000])
def test_entries_of_any_length(make, blanks):
    assert run(make, [f"{blanks}2024-03-05{blanks}10:11:12{blanks}UTC{blanks}", f"2024-03-05 10:11{blanks}x{blanks}y"]) == {0: "2024-03-05T10:11:12.000Z"}


@pytest.mark.parametrize(
    "entry",
    [
        "2024-02-30 10:00", "25:61", "13:00 pm", "2023-366 10:00", "Mon, 7 May 2022 02:09:13 +0000", "2024-05-06", "5 March 2024", "March 12", "around 8 PM", "unknown",
        "", "   ", "30/10/2022 02:15", "27/03/2022 02:30", "2023-09-04 20:53 XYZ", "0000-00-00", "123456789", "x" * 5000, "\u00012024\u0002",
    ],
)
def test_no_instant(make, entry):
    assert run(make, [entry]) == {}


def test_positions_nulls_and_repeats(make, clash):
    row = {"document_id": "D", "block_id": "b", "office_code": "OF-BER", "reference_date": DAY, "raw_timestamps": [None, "10:00", "", "10:00"]}
    blocks = make("cleaned_blocks", row, row | {"ingested_at": dt.datetime(2025, 1, 1)}, row | {"block_id": "c", "raw_timestamps": None}, row | {"block_id": "d", "raw_timestamps": []}, row | {"block_id": "e", "office_code": None, "raw_timestamps": ["10:00", "1701632337"]}, row | {"block_id": "f", "reference_date": None, "raw_timestamps": ["10:00", "2024-01-01 10:00"]})
    offices = make("offices", {"office_code": "OF-BER", "time_zone": "Europe/Berlin", "date_order": "DMY"})
    got = sorted((r["block_id"], r["pos"], r["utc"]) for r in normalize_timestamps(clash(blocks), clash(offices)).collect())
    assert got == [("b", 1, "2024-05-06T08:00:00.000Z"), ("b", 3, "2024-05-06T08:00:00.000Z"), ("e", 1, "2023-12-03T19:38:57.000Z"), ("f", 1, "2024-01-01T09:00:00.000Z")]


def test_empty_tables(make):
    assert normalize_timestamps(make("cleaned_blocks"), make("offices")).count() == 0


@pytest.mark.parametrize(("zone", "office"), [("Europe/Berlin", "OF-BER"), ("America/New_York", "OF-NYC"), ("Australia/Sydney", "OF-SYD")])
def test_every_quarter_hour_of_a_year_against_zoneinfo(make, zone, office):
    """Local times that occur twice or never are left out, all others agree."""
    start = dt.datetime(2022, 1, 1)
    times = [start + dt.timedelta(minutes=15 * i) for i in range(4 * 24 * 365)]
    got = run(make, [f"{t:%Y-%m-%d %H:%M}" for t in times], office)
    tz = ZoneInfo(zone)
    for i, t in enumerate(times):
        real = {t.replace(tzinfo=tz, fold=f).astimezone(dt.UTC) for f in (0, 1)}
        real = {u for u in real if u.astimezone(tz).replace(tzinfo=None) == t}
        assert got.get(i) == (f"{real.pop():%Y-%m-%dT%H:%M:%S}.000Z" if len(real) == 1 else None), t

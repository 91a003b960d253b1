"""DuckDB SQL for the timestamp query: each notation by its own expression, time zones by DuckDB."""

from __future__ import annotations

_CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\b\.?)?"
_CLOCK_NAMES = ["h", "mi", "s", "f", "ap"]
_ZONE = r"(?:\s*(?:([+-]\d{2}:?(?:\d{2})?)|\(?([a-z]{1,4})\)?))?"
_ZONE_NAMES = ["o", "z"]
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?"
_DAY = r"(?:(mon|tue|wed|thu|fri|sat|sun)(?:day|sday|nesday|rsday|urday)?,?\s+)?"

_NOTATIONS = (
    (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:t|,?\s+)" + _CLOCK + _ZONE, ["y", "mo", "d", *_CLOCK_NAMES, *_ZONE_NAMES]),
    (r"(\d{4})(\d{2})(\d{2})(?:t|\s+)(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?" + _ZONE, ["y", "mo", "d", "h", "mi", "s", "f", *_ZONE_NAMES]),
    (r"(\d{4})-(\d{3})(?:t|\s+)" + _CLOCK + _ZONE, ["y", "j", *_CLOCK_NAMES, *_ZONE_NAMES]),
    (_DAY + r"(\d{1,2})(?:st|nd|rd|th)?\s+" + _MONTH + r"\.?,?\s+(\d{4})(?:,\s*|\s+(?:at\s+)?)" + _CLOCK + _ZONE, ["w", "d", "mn", "y", *_CLOCK_NAMES, *_ZONE_NAMES]),
    (_DAY + _MONTH + r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:,\s*|\s+(?:at\s+)?)" + _CLOCK + _ZONE, ["w", "mn", "d", "y", *_CLOCK_NAMES, *_ZONE_NAMES]),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2}),?\s+(?:at\s+)?" + _CLOCK + _ZONE, ["a", "b", "y", *_CLOCK_NAMES, *_ZONE_NAMES]),
    (r"(\d{2})(\d{2})\s*(?:hours|hrs|h)(?:\s*\(?([a-z]{1,4})\)?)?", ["h", "mi", "z"]),
    (r"(?:(today|yesterday|tomorrow),?\s+(?:at\s+)?)?" + _CLOCK + _ZONE, ["dw", *_CLOCK_NAMES, *_ZONE_NAMES]),
    (r"(\d{13}|\d{10})", ["u"]),
)

# Fixed values, written out apart from the operator's tables: zone letters with their minutes east of UTC by country, and the country of each zone.
_LETTERS = """
    ('', 'utc', 0), ('', 'gmt', 0), ('', 'z', 0), ('', 'ut', 0), ('GB', 'bst', 60), ('IE', 'ist', 60), ('IN', 'ist', 330), ('JP', 'jst', 540),
    ('DE', 'cet', 60), ('DE', 'mez', 60), ('DE', 'cest', 120), ('DE', 'mesz', 120),
    ('US', 'est', -300), ('US', 'cst', -360), ('US', 'mst', -420), ('US', 'pst', -480), ('US', 'edt', -240), ('US', 'cdt', -300), ('US', 'mdt', -360), ('US', 'pdt', -420),
    ('AU', 'aest', 600), ('AU', 'est', 600), ('AU', 'acst', 570), ('AU', 'cst', 570), ('AU', 'awst', 480), ('AU', 'wst', 480), ('AU', 'aedt', 660), ('AU', 'edt', 660), ('AU', 'acdt', 630), ('AU', 'cdt', 630)
"""
_COUNTRY = "CASE WHEN time_zone LIKE 'Australia/%' THEN 'AU' WHEN time_zone = 'Europe/Berlin' THEN 'DE' WHEN time_zone = 'Europe/London' THEN 'GB' WHEN time_zone = 'Europe/Dublin' THEN 'IE' WHEN time_zone = 'Asia/Kolkata' THEN 'IN' WHEN time_zone = 'Asia/Tokyo' THEN 'JP' WHEN time_zone LIKE 'America/%' THEN 'US' END"


def build() -> str:
    """SQL of ``document_id, block_id, pos, utc`` over cleaned_blocks and offices."""
    structs = ", ".join("regexp_extract(r, '^\\s*(?:{})\\s*$', [{}]) AS n{}".format(p, ", ".join(f"'{x}'" for x in names), i) for i, (p, names) in enumerate(_NOTATIONS))
    fields = sorted({x for _, names in _NOTATIONS for x in names})
    parts = ", ".join("coalesce({}) AS {}".format(", ".join(f"nullif(n{i}.{f}, '')" for i, (_, names) in enumerate(_NOTATIONS) if f in names), f) for f in fields)
    return f"""
        WITH zones(country, letters, east) AS (VALUES {_LETTERS}), lands AS (SELECT DISTINCT time_zone, {_COUNTRY} AS country FROM offices),
        entries AS (
            SELECT document_id, block_id, reference_date, time_zone, date_order, pos - 1 AS pos, lower(raw) AS r
            FROM (SELECT document_id, block_id, office_code, reference_date, unnest(raw_timestamps) AS raw, generate_subscripts(raw_timestamps, 1) AS pos FROM (SELECT DISTINCT document_id, block_id, office_code, reference_date, raw_timestamps FROM cleaned_blocks))
            LEFT JOIN offices USING (office_code) WHERE raw IS NOT NULL
        ),
        cut AS (SELECT *, {structs} FROM entries), part AS (SELECT document_id, block_id, pos, reference_date, time_zone, date_order, {parts} FROM cut),
        dated AS (
            SELECT *, CASE WHEN length(y) = 2 THEN '20' || y ELSE y END AS yy,
                   coalesce(mo, CASE date_order WHEN 'DMY' THEN b WHEN 'MDY' THEN a END, (list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], mn))::VARCHAR) AS mm,
                   coalesce(d, CASE date_order WHEN 'DMY' THEN a WHEN 'MDY' THEN b END) AS dd FROM part
        ),
        placed AS (
            SELECT *, CASE WHEN j IS NOT NULL THEN CASE WHEN j::INT BETWEEN 1 AND 366 AND year(make_date(yy::INT, 1, 1) + (j::INT - 1)) = yy::INT THEN make_date(yy::INT, 1, 1) + (j::INT - 1) END
                           WHEN y IS NOT NULL THEN try_cast(yy || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE)
                           ELSE reference_date + CASE dw WHEN 'yesterday' THEN -1 WHEN 'tomorrow' THEN 1 ELSE 0 END END::DATE AS day,
                   CASE WHEN ap IS NULL THEN CASE WHEN h::INT <= 23 THEN h::INT END WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + CASE ap WHEN 'p' THEN 12 ELSE 0 END END AS hour FROM dated
        ),
        local AS (
            SELECT *, CASE WHEN mi::INT <= 59 AND coalesce(s, '0')::INT <= 59 AND (w IS NULL OR lower(dayname(day))[1:3] = w) THEN day::TIMESTAMP + to_hours(hour) + to_minutes(mi::INT) + to_seconds(coalesce(s, '0')::INT) + to_microseconds(rpad(coalesce(f, '0'), 6, '0')[1:6]::BIGINT) END AS moment FROM placed
        ),
        fixed AS (
            SELECT l.*, CASE WHEN o IS NOT NULL THEN CASE WHEN o[2:3]::INT <= 14 THEN (CASE o[1:1] WHEN '-' THEN -1 ELSE 1 END) * (o[2:3]::INT * 60 + coalesce(nullif(replace(o[4:], ':', ''), ''), '0')::INT) END ELSE coalesce(e.east, c.east) END AS east,
                   timezone(l.time_zone, moment) AS guess
            FROM local l LEFT JOIN lands ON lands.time_zone = l.time_zone LEFT JOIN zones e ON e.country = '' AND e.letters = z LEFT JOIN zones c ON c.country = lands.country AND c.letters = z
        ),
        instants AS (
            SELECT document_id, block_id, pos, CASE WHEN u IS NOT NULL THEN epoch_ms(CASE length(u) WHEN 10 THEN u::BIGINT * 1000 ELSE u::BIGINT END)::TIMESTAMP WHEN o IS NOT NULL OR z IS NOT NULL THEN moment - to_minutes(east)
                WHEN timezone(time_zone, guess) = moment AND timezone(time_zone, guess + INTERVAL 1 HOUR) <> moment AND timezone(time_zone, guess - INTERVAL 1 HOUR) <> moment THEN timezone('UTC', guess) END AS utc FROM fixed
        )
        SELECT DISTINCT document_id, block_id, pos::INT AS pos, strftime(utc, '%Y-%m-%dT%H:%M:%S.%gZ') AS utc FROM instants WHERE utc IS NOT NULL"""

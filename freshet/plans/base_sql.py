"""SQL of the common base: stamps of every written form as instants, values in mg/L, each reading once.

Written from the statement of the problems, form by form and spelling by spelling, and not from the operators: zones come
from the database's own zone rules, units from a plain list of the spellings in use.
"""

from __future__ import annotations

_ZONE = r"Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{3,4}|[A-Za-z]+(?:/[A-Za-z_]+)+"
_TIME = rf"(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)?(?:\s*([AaPp][Mm])\b)?(?:\s*({_ZONE}))?"
_HMS = ("hh", "mi", "ss", "half", "zone")
_PARTS = ("yy", "mo", "dd", "one", "two", "word", "hh", "mi", "ss", "half", "zone", "epoch")

# The written forms, each with the names of its groups in order.
FORMS: tuple[tuple[str, tuple[str, ...]], ...] = (
    *((rf"(\d{{4}}){m}(\d{{1,2}}){m}(\d{{1,2}})(?:(?:T|\s+){_TIME})?", ("yy", "mo", "dd", *_HMS)) for m in ("-", "/", r"\.")),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:\s+{_TIME})?", ("one", "two", "yy", *_HMS)),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:\s+{_TIME})?", ("dd", "mo", "yy", *_HMS)),
    (rf"((?:19|20)\d{{2}})(\d{{2}})(\d{{2}})(?:[T ]?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}}))?(?:\s*({_ZONE}))?)?", ("yy", "mo", "dd", "hh", "mi", "ss", "zone")),
    (r"(\d{9,10}|\d{12,13}|\d{16})", ("epoch",)),
    (rf"(\d{{1,2}})-(\p{{L}}{{3,9}})-(\d{{4}}|\d{{2}})(?:\s+{_TIME})?", ("dd", "word", "yy", *_HMS)),
    (rf"(?:\p{{L}}{{3,9}},\s*)?(\d{{1,2}})\s+(\p{{L}}{{3,9}})\.?\s+(\d{{4}})(?:\s+{_TIME})?", ("dd", "word", "yy", *_HMS)),
    (r"(\d{1,2})\s+(\p{L}{3,9})\.?\s+(\d{4})\s+(\d{1,2})\s*h\s*(\d{2})?", ("dd", "word", "yy", "hh", "mi")),
    (rf"(\p{{L}}{{3,9}})\.?\s+(\d{{1,2}})(?:,\s*|\s+)(\d{{4}})(?:\s+{_TIME})?", ("word", "dd", "yy", *_HMS)),
)
# First letters that tell the month, English and French, without accents; juin and juil before the rest.
_MONTHS = (("jan", 1), ("fe", 2), ("mar", 3), ("av", 4), ("ap", 4), ("may", 5), ("mai", 5), ("juin", 6), ("jun", 6), ("juil", 7), ("jul", 7), ("ao", 8), ("aug", 8), ("se", 9), ("oct", 10), ("nov", 11), ("dec", 12))
# Offsets of the zone abbreviations in hours.
_ABBREVIATIONS = (("Z", 0), ("UTC", 0), ("GMT", 0), ("NST", -3.5), ("NDT", -2.5), ("AST", -4), ("ADT", -3), ("EST", -5), ("EDT", -4), ("CST", -6), ("CDT", -5), ("MST", -7), ("MDT", -6), ("PST", -8), ("PDT", -7), ("AKST", -9), ("AKDT", -8), ("HST", -10))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form(k: int) -> str:
    """Components of the stamps that have form ``k`` and none before it."""
    pattern, names = FORMS[k]
    cells = ", ".join(f"x.{p} AS {p}" if p in names else f"'' AS {p}" for p in _PARTS)
    earlier = "".join(f" AND NOT regexp_full_match(txt, {_quoted(FORMS[j][0])})" for j in range(k) if {j, k} <= {5, 6} or {j, k} <= {8, 9})
    return f"SELECT rec_id, {cells} FROM (SELECT rec_id, regexp_extract(txt, {_quoted('^(?:' + pattern + ')$')}, [{', '.join(map(_quoted, names))}]) AS x FROM said WHERE regexp_full_match(txt, {_quoted(pattern)}){earlier})"


_MONTH = "CASE " + " ".join(f"WHEN strip_accents(lower(word)) LIKE '{a}%' THEN {n}" for a, n in _MONTHS) + " END"
_FIXED = "CASE zone " + " ".join(f"WHEN '{a}' THEN {int(h * 3600)}" for a, h in _ABBREVIATIONS) + " END"
_AT = lambda utc: f"timezone(region, timezone('UTC', {utc}))"  # wall clock of the region at a UTC reading

#: ``stamp``: rec_id, utc (null unless ok), status (null for a null text).
STAMPS = f"""said AS (SELECT rec_id, source, state_prov, regexp_replace(trim(datetime), '^''', '') AS txt FROM harmonize WHERE datetime IS NOT NULL),
parts AS ({' UNION ALL '.join(_form(k) for k in range(len(FORMS)))}),
votes AS (SELECT source, CASE WHEN sum((one::INT > 12 AND two::INT BETWEEN 1 AND 12)::INT) > sum((two::INT > 12 AND one::INT BETWEEN 1 AND 12)::INT) THEN 'dmy' ELSE 'mdy' END AS day_first
          FROM parts JOIN said USING (rec_id) WHERE one <> '' GROUP BY source),
nums AS (SELECT p.rec_id, s.state_prov, CASE WHEN length(yy) = 2 THEN try_cast(yy AS INT) + CASE WHEN yy >= '70' THEN 1900 ELSE 2000 END ELSE try_cast(yy AS INT) END AS y,
  CASE WHEN one <> '' THEN CASE WHEN day_first = 'dmy' THEN two::INT ELSE one::INT END WHEN word <> '' THEN {_MONTH} ELSE try_cast(mo AS INT) END AS m,
  CASE WHEN one <> '' THEN CASE WHEN day_first = 'dmy' THEN one::INT ELSE two::INT END ELSE try_cast(dd AS INT) END AS d,
  coalesce(try_cast(hh AS INT), 0) AS h0, coalesce(try_cast(mi AS INT), 0) AS n, coalesce(try_cast(ss AS INT), 0) AS s, lower(half) AS half, zone, try_cast(epoch AS BIGINT) AS epoch
  FROM parts p JOIN said s USING (rec_id) LEFT JOIN votes v ON v.source IS NOT DISTINCT FROM s.source),
wall AS (SELECT *, CASE WHEN epoch IS NULL AND n < 60 AND s < 60 AND CASE WHEN half = '' THEN h0 < 24 ELSE h0 BETWEEN 1 AND 12 END
   THEN try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', y, m, d, CASE WHEN half = '' THEN h0 ELSE h0 % 12 + CASE half WHEN 'pm' THEN 12 ELSE 0 END END, n, s), '%Y-%m-%d %H:%M:%S') END AS clock,
   CASE WHEN regexp_matches(zone, '^[+-]') THEN (CASE zone[1] WHEN '-' THEN -1 ELSE 1 END) * (zone[2:3]::INT * 3600 + coalesce(try_cast(nullif(replace(zone[4:], ':', ''), '') AS INT), 0) * 60) ELSE {_FIXED} END AS fixed FROM nums),
zoned AS (SELECT w.*, CASE WHEN contains(w.zone, '/') THEN t.name WHEN w.zone = '' THEN z.zone END AS region FROM wall w LEFT JOIN zone_ref z ON w.state_prov = z.state_prov LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names()) t ON w.zone = t.name),
tried AS (SELECT *, CASE WHEN region IS NOT NULL AND clock IS NOT NULL THEN list_filter(list_distinct([clock - ({_AT("clock - INTERVAL 1 DAY")} - (clock - INTERVAL 1 DAY)), clock - ({_AT("clock + INTERVAL 1 DAY")} - (clock + INTERVAL 1 DAY))]), lambda u: {_AT("u")} = clock) END AS fits FROM zoned),
judged AS (SELECT rec_id, CASE WHEN epoch IS NOT NULL THEN make_timestamp(CASE WHEN epoch >= 1000000000000000 THEN epoch // 1000000 WHEN epoch >= 100000000000 THEN epoch // 1000 ELSE epoch END * 1000000)
   WHEN fixed IS NOT NULL THEN clock - to_seconds(fixed) WHEN len(fits) = 1 THEN fits[1] END AS utc,
   CASE WHEN epoch IS NOT NULL THEN 'ok' WHEN clock IS NULL OR (zone <> '' AND fixed IS NULL AND region IS NULL) THEN 'unreadable' WHEN fixed IS NOT NULL THEN 'ok' WHEN region IS NULL THEN 'no_zone' WHEN len(fits) = 2 THEN 'ambiguous' WHEN len(fits) = 0 THEN 'nonexistent' ELSE 'ok' END AS status FROM tried),
stamp AS (SELECT rec_id, CASE WHEN status = 'ok' THEN utc END AS utc, coalesce(status, 'unreadable') AS status FROM said LEFT JOIN judged USING (rec_id))"""

# Unit spellings in lower case, micro as u, with their basis and their factor to ug/L (charge: ueq/L, molar: umol/L).
SPELLINGS: tuple[tuple[str, float, str], ...] = (
    ("mg/L", 1000.0, "mg/l; mg/ l; mg / l; mg l-1; mg l^-1; ppm; milligram per liter; milligrams per liter; milligram per litre; milligrams per litre; mg/l caco3; mg/l as caco3"),
    ("mass", 1.0, "ug/l; ug / l; ug l-1; mcg/l; ppb; mg/m3; mg m-3; ng/ml; microgram per liter; micrograms per liter; microgram per litre; micrograms per litre"),
    ("mass", 0.001, "ng/l; ng l-1"),
    ("mass", 1000000.0, "g/l; g l-1; grams per liter; grams per litre; gram per liter; gram per litre"),
    ("mass", 10000.0, "mg/dl; mg/100ml; mg/100 ml"),
    ("charge", 1000.0, "meq/l; meq l-1; me/l; milliequivalent per liter; milliequivalents per liter; milliequivalents per litre"),
    ("charge", 1.0, "ueq/l; ueq l-1; microeq/l; microequivalents per liter; microequivalents per litre"),
    ("molar", 1000.0, "mmol/l; mmol l-1; mmole/l; mm; millimole per liter; millimoles per liter; millimoles per litre; mol/m3; mol/m^3; mol m-3"),
    ("molar", 1.0, "umol/l; umol l-1; um; micromol/l; micromoles per liter; micromoles per litre"),
    ("molar", 1000000.0, "mol/l; mol l-1; moles per liter; moles per litre"),
)
_LIST = ", ".join(f"('{t.strip()}', '{basis}', {factor!r}::DOUBLE)" for basis, factor, line in SPELLINGS for t in line.split(";"))
_LOWER = lambda c: f"translate(lower(trim({c})), 'µμ', 'uu')"

#: ``unit_of``: rec_id, basis, factor of the unit that a row's unit column or, where that is null, its name states.
UNITS = f"""spelled(text, basis, factor) AS (VALUES {_LIST}),
own AS (SELECT u.unit_source, s.basis, s.factor FROM (SELECT DISTINCT unit_source FROM harmonize WHERE unit_source IS NOT NULL) u JOIN spelled s ON s.text = {_LOWER('u.unit_source')}),
inner_unit AS (SELECT c.characteristic_source, arg_max(s.basis, length(s.text)) AS basis, arg_max(s.factor, length(s.text)) AS factor FROM (SELECT DISTINCT characteristic_source FROM harmonize WHERE unit_source IS NULL AND characteristic_source IS NOT NULL) c
  JOIN spelled s ON contains(' ' || regexp_replace({_LOWER('c.characteristic_source')}, '[][(),; ]+', ' ', 'g') || ' ', ' ' || s.text || ' ') GROUP BY ALL),
unit_of AS (SELECT h.rec_id, coalesce(a.basis, b.basis, 'none') AS basis, coalesce(a.factor, b.factor) AS factor, r.molar_mass, r.equiv_weight FROM harmonize h
  LEFT JOIN own a ON h.unit_source = a.unit_source LEFT JOIN inner_unit b ON h.unit_source IS NULL AND h.characteristic_source = b.characteristic_source LEFT JOIN ion_ref r ON h.ion = r.ion)"""
SCALE = "CASE basis WHEN 'charge' THEN equiv_weight WHEN 'molar' THEN molar_mass WHEN 'none' THEN NULL ELSE 1.0::DOUBLE END"

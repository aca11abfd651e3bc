"""Problem 4: one UTC moment for every readable value of main_texts.published and of the date headers of fetch_results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatrix.operators.sizing import join_measured
from verbatrix.operators.timestamps import header_values, utc_moments
from verbatrix.plans.registry import query
from verbatrix.sources.tables import table

_TIME = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?"
_HALF = r"(?: ?([AaPp]\.?[Mm]\.?))?"
_ZONE = r"(?: ?((?:UTC|GMT)?[+−-][0-9]{1,2}:?(?:[0-9]{2})?|[A-Za-z]{1,5}))?(?:\[([A-Za-z]+(?:/[A-Za-z_+0-9-]+)+)\])?"
_WORD = r"\p{L}+"
_NAMED_DAY = rf"(?:{_WORD}\.?,? )?"
# the forms of a date, each with the names of its groups: y, m, d, h, i, s, p (half of the day), z (zone as said), n (zone by name), w (month's name), a and b (numbers parted by slashes)
_FORMS = [
    (rf"([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:[Tt ,]+{_TIME}{_HALF}{_ZONE})?", "ymdhispzn"),
    (rf"([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[Tt]([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})?{_ZONE}", "ymdhiszn"),
    (rf"{_NAMED_DAY}([0-9]{{1,2}})(?:st|nd|rd|th|\.)?[ -](?:de )?({_WORD})\.?[ ,-](?:de )?([0-9]{{4}}|[0-9]{{2}})(?:,? (?:at |um |à )?{_TIME}(?: Uhr| h)?{_HALF}{_ZONE})?", "dwyhispzn"),
    (rf"{_NAMED_DAY}({_WORD})\.? ([0-9]{{1,2}})(?:st|nd|rd|th)? {_TIME}{_ZONE} ([0-9]{{4}})", "wdhiszny"),
    (rf"{_NAMED_DAY}({_WORD})\.? ([0-9]{{1,2}})(?:st|nd|rd|th)?,? ([0-9]{{4}})(?:,?(?: at)? {_TIME}{_HALF}{_ZONE})?", "wdyhispzn"),
    (rf"([0-9]{{4}})[/.]([0-9]{{1,2}})[/.]([0-9]{{1,2}})(?:,? {_TIME}{_HALF}{_ZONE})?", "ymdhispzn"),
    (rf"([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}|[0-9]{{2}})(?:,? {_TIME}{_HALF}{_ZONE})?", "abyhispzn"),
    (rf"([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}|[0-9]{{2}})(?:,? {_TIME}{_HALF}{_ZONE})?", "dmyhispzn"),
    (r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日(?: ?([0-9]{1,2})[時时:]([0-9]{1,2})分?(?:([0-9]{1,2})秒)?)?", "ymdhis"),
]
# Names of months, and minutes east of UTC of zone abbreviations.
_MONTHS = {
    name: i
    for names in (
        "january february march april may june july august september october november december", "jan feb mar apr may jun jul aug sep oct nov dec", "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
        "januar februar märz april mai juni juli august september oktober november dezember", "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    )
    for i, name in enumerate(names.split(), 1)
} | {"sept": 9, "setiembre": 9, "jänner": 1}
_EAST = (
    "z 0 utc 0 gmt 0 ut 0 wet 0 west 60 bst 60 cet 60 mez 60 cest 120 mesz 120 eet 120 eest 180 msk 180 ist 330 jst 540 kst 540 aest 600 aedt 660 nzst 720 nzdt 780"
    " ast -240 adt -180 est -300 edt -240 cst -360 cdt -300 mst -420 mdt -360 pst -480 pdt -420 akst -540 akdt -480 hst -600"
).split()


def _map(pairs: dict[str, object]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pairs.items()) + "}"


def _read(pattern: str, groups: str, rank: int) -> str:
    """SQL of the parts of the values that one form takes."""
    quoted = pattern.replace("'", "''")
    parts = [f"regexp_extract(v, '^{quoted}$', {groups.index(g) + 1}) AS {g}" if g in groups else f"'' AS {g}" for g in "ymdhispznwab"]
    return f"SELECT k, {rank} AS rank, {', '.join(parts)} FROM said WHERE regexp_full_match(v, '{quoted}')"


_SQL = f"""
WITH raw AS (
  SELECT m.page_id, 'published' AS field, published AS v, timezone AS zone FROM main_texts m LEFT JOIN publications p ON p.id = m.publication_id UNION ALL
  SELECT page_id, lower(trim(h.key)), h.value, 'UTC' FROM (SELECT page_id, unnest(map_entries(headers)) AS h FROM fetch_results) WHERE lower(trim(h.key)) IN ('date', 'last-modified')),
said AS (SELECT row_number() OVER () AS k, page_id, field, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS v, zone FROM raw WHERE trim(v) <> ''),
forms AS ({' UNION ALL '.join(_read(p, g, i) for i, (p, g) in enumerate(_FORMS))}),
first AS (SELECT * FROM forms QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank) = 1),
parts AS (SELECT page_id, field, coalesce(nullif(n, ''), zone) AS zone, CASE WHEN length(y) = 2 THEN 2000 + CAST(y AS INTEGER) ELSE CAST(y AS INTEGER) END AS y, lower(replace(z, '−', '-')) AS z, p,
  CASE WHEN w <> '' THEN coalesce({_map(_MONTHS)}[lower(w)], 0) WHEN a <> '' THEN CASE WHEN mf THEN CAST(a AS INTEGER) ELSE CAST(b AS INTEGER) END ELSE CAST(m AS INTEGER) END AS m,
  CASE WHEN a <> '' THEN CASE WHEN mf THEN CAST(b AS INTEGER) ELSE CAST(a AS INTEGER) END ELSE CAST(d AS INTEGER) END AS d,
  coalesce(try_cast(h AS INTEGER), 0) AS h0, coalesce(try_cast(i AS INTEGER), 0) AS mi, coalesce(try_cast(s AS INTEGER), 0) AS s
  FROM (SELECT *, coalesce(zone LIKE 'America%', false) OR (coalesce(try_cast(b AS INTEGER), 0) > 12 AND coalesce(try_cast(a AS INTEGER), 0) <= 12 AND NOT coalesce(zone LIKE 'Europe%', false)) AS mf FROM first JOIN said USING (k))),
clock AS (SELECT *, CASE WHEN p = '' THEN h0 ELSE h0 % 12 + CASE WHEN lower(p[1]) = 'p' THEN 12 ELSE 0 END END AS h FROM parts WHERE h0 < 24 AND mi < 60 AND s < 60 AND (p = '' OR h0 BETWEEN 1 AND 12)),
wall AS (SELECT page_id, field, zone, z, try_cast(format('{{:04d}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', y, m, d, h, mi, s) AS TIMESTAMP) AS t FROM clock WHERE m BETWEEN 1 AND 12),
east AS (SELECT *, CASE WHEN z IN ('', 'et', 'ct', 'mt', 'pt', 'at', 'local') THEN NULL WHEN {_map(dict(zip(_EAST[::2], _EAST[1::2])))}[z] IS NOT NULL THEN {_map(dict(zip(_EAST[::2], _EAST[1::2])))}[z]
  WHEN regexp_full_match(z, '(?:utc|gmt)?[+-][0-9]{{1,2}}:?(?:[0-9]{{2}})?') THEN (CASE WHEN contains(z, '-') THEN -1 ELSE 1 END) * (60 * CAST(regexp_extract(z, '[+-]([0-9]{{1,2}})', 1) AS INTEGER) + coalesce(try_cast(regexp_extract(z, '[+-][0-9]{{1,2}}:?([0-9]{{2}})$', 1) AS INTEGER), 0))
  ELSE 99999 END AS e FROM wall WHERE t IS NOT NULL),
late AS (SELECT *, CASE WHEN e IS NULL THEN timezone('UTC', timezone(zone, t)) ELSE t - to_minutes(e) END AS u FROM east WHERE coalesce(e, 0) <> 99999 AND (e IS NOT NULL OR zone IS NOT NULL)),
moments AS (SELECT page_id, field, CASE WHEN e IS NULL AND timezone(zone, timezone('UTC', u - INTERVAL 1 HOUR)) = t THEN u - INTERVAL 1 HOUR ELSE u END AS u FROM late),
bare AS (SELECT page_id, field, make_timestamp(CAST(left(v, 10) AS BIGINT) * 1000000) AS u FROM said WHERE regexp_full_match(v, '[0-9]{{10}}|[0-9]{{13}}'))
SELECT DISTINCT page_id, field, strftime(u, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM (SELECT * FROM moments UNION ALL SELECT * FROM bare)
"""


@query(_SQL)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One UTC moment per readable published value or date header; equal rows of one page and field are given once."""
    zones = table(spark, folder, "publications").select(F.col("id").alias("publication_id"), F.col("timezone").alias("zone"))
    pages = table(spark, folder, "main_texts").select("page_id", "publication_id", F.col("published").alias("value")).filter(F.col("value").isNotNull())
    published = join_measured(pages, zones, ["publication_id"], "left").select("page_id", F.lit("published").alias("field"), "value", "zone")
    headers = header_values(table(spark, folder, "fetch_results"), ["date", "last-modified"]).withColumn("zone", F.lit("UTC"))
    return utc_moments(published.unionByName(headers)).select("page_id", "field", "utc").distinct()

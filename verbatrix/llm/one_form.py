"""Problem 3: texts that look the same in different characters, brought to one form by DuckDB inside Arrow partitions.

Every Arrow batch is handed to an embedded DuckDB as a table and comes back through one SQL statement: invisible
characters go, every kind of space and hyphen becomes the plain one (runs of spaces one space, none at the ends),
compatibility forms are spelt out by a table of all of Unicode's single-character mappings, look-alike letters are
translated and the result is composed with nfc_normalize. Case, accents, punctuation and words stay as they are.
Superscripts, subscripts, circled forms and fractions don't read like the plain characters: they are spelt out in the
form and kept in the look by which texts are compared. Look-alikes are also mapped in texts that are wholly Cyrillic or
Greek: both texts of a pair go the same way, so comparisons hold, but such a form is not for showing; `readable_form` is.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.operators.sizing import join_measured

# Letters that share a glyph with a Latin one.
CYRILLIC = "АВЕЅІЈКМНОРСТХҮаеорсухіѕјһԁԛԝҮёЁїЇ"
CYRILLIC_AS = "ABESIJKMHOPCTXYaeopcyxisjhdqwYëËïÏ"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXovcj"
# Characters without a glyph; kinds of space; kinds of hyphen.
INVISIBLE = r"[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]"
SPACES = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
HYPHENS = r"[\x{2010}-\x{2012}\x{2043}\x{2212}\x{fe63}\x{ff0d}]"
#: Kinds of compatibility form that don't read like what they stand for.
DISTINCT = ("<super>", "<sub>", "<circle>", "<fraction>")


@lru_cache(maxsize=2)
def compatibility(distinct: bool) -> dict[str, str]:
    """Character to what it is spelt out as, for every compatibility form; without the DISTINCT kinds unless asked for."""
    out = {}
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.decomposition(c).partition(" ")[0]
        # precomposed syllables and accents have no kind: composing settles them
        if kind.startswith("<") and (distinct or kind not in DISTINCT) and (t := unicodedata.normalize("NFKC", c)) != c:
            out[c] = t
    return out


def _class_of(chars: dict[str, str]) -> str:
    """A regular-expression class of the characters, as ranges."""
    codes, parts, k = sorted(map(ord, chars)), [], 0
    while k < len(codes):
        end = k
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        parts.append(rf"\x{{{codes[k]:x}}}-\x{{{codes[end]:x}}}" if end > k else rf"\x{{{codes[k]:x}}}")
        k = end + 1
    return "[" + "".join(parts) + "]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain_sql(column: str) -> str:
    """The DuckDB expression of a text without invisible characters, with plain spaces and hyphens."""
    sql = f"regexp_replace({column}, {_quoted(INVISIBLE)}, '', 'g')"
    sql = f"regexp_replace({sql}, {_quoted(SPACES)}, ' ', 'g')"
    return f"regexp_replace({sql}, {_quoted(HYPHENS)}, '-', 'g')"


def composed_sql(column: str, lookalikes: bool = True) -> str:
    """The DuckDB expression of a spelt-out text with its look-alikes translated, composed, with single spaces."""
    if lookalikes:
        swap = f"{_quoted(CYRILLIC + GREEK)}, {_quoted(CYRILLIC_AS + GREEK_AS)}"
        # before composing, for a look-alike that carries a combining accent; after, for a composed one
        sql = f"translate(nfc_normalize(translate({column}, {swap})), {swap})"
    else:
        sql = f"nfc_normalize({column})"
    return f"trim(regexp_replace({sql}, ' +', ' ', 'g'))"


def _spelt(view: str, held: str, forms: str) -> str:
    """A query (n, t) of view's texts, those that hold any of the class of characters spelt out by the table forms."""
    return f"""SELECT n, string_agg(coalesce(f.spelt, x.c), '' ORDER BY x.k) AS t FROM (
          SELECT n, unnest(string_split(t, '')) AS c, unnest(range(length(t) + 1)) AS k FROM {view} WHERE regexp_matches(t, {_quoted(held)})) x
        LEFT JOIN {forms} f ON x.c = f.c WHERE x.c IS NOT NULL GROUP BY n"""


def forms_sql(lookalikes: bool = True) -> str:
    """The statement that gives (id, raw md5, form, look md5) of the table part (id, text)."""
    full, alike = compatibility(True), compatibility(False)
    apart = _class_of({c: t for c, t in full.items() if c not in alike})
    return f"""
      WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS n, id, text, {plain_sql('text')} AS t FROM part),
      spelt AS MATERIALIZED ({_spelt('numbered', _class_of(full), 'compatible')}), apart AS MATERIALIZED ({_spelt('numbered', apart, 'alike')}),
      formed AS (SELECT id, text, apart.t AS apart, {composed_sql('coalesce(spelt.t, numbered.t)', lookalikes)} AS form
        FROM numbered LEFT JOIN spelt USING (n) LEFT JOIN apart USING (n))
      SELECT id, md5(text) AS raw, form, md5(CASE WHEN apart IS NULL THEN form ELSE {composed_sql('apart', lookalikes)} END) AS look FROM formed"""


def _through_duckdb(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for name, distinct in (("compatible", True), ("alike", False)):
            forms = compatibility(distinct)
            con.register("f", pa.table({"c": list(forms), "spelt": list(forms.values())}))
            con.sql(f"CREATE TABLE {name} AS SELECT * FROM f")
        for batch in batches:
            if batch.num_rows:
                con.register("part", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().to_batches()
        con.close()

    return run


def with_forms(df: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """(id, raw md5, form, look md5) of each non-null text. Empty texts have an empty form; texts of any length are taken whole."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(_through_duckdb(forms_sql()), f"id {kind}, raw string, form string, look string")


def readable_form(df: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """(id, text) with the text in one form but look-alike letters of other scripts left alone; null texts are left out."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(_through_duckdb(f"SELECT id, form AS text FROM ({forms_sql(False)})"), f"id {kind}, text string")


def look_alikes(forms: DataFrame, *keys: str) -> DataFrame:
    """Pairs (keys, id_a, id_b), id_a < id_b, whose forms agree and whose texts don't.

    forms has id, raw, look and the key columns. Only looks with more than one raw text are joined, so exact copies of a
    text add nothing by themselves; a repeated id pairs once; nulls pair with nothing.
    """
    on = [*keys, "look"]
    mixed = forms.groupBy(*on).agg(F.min("raw").alias("__lo"), F.max("raw").alias("__hi")).filter(F.col("__lo") < F.col("__hi")).select(*on)
    rows = join_measured(forms.select(*on, "id", "raw"), mixed, on, "left_semi")
    a, b = rows.withColumnsRenamed({"id": "id_a", "raw": "raw_a"}), rows.withColumnsRenamed({"id": "id_b", "raw": "raw_b"})
    pairs = a.join(b, on).filter((F.col("id_a") < F.col("id_b")) & (F.col("raw_a") != F.col("raw_b")))
    return pairs.select(*keys, "id_a", "id_b").dropDuplicates([*keys, "id_a", "id_b"])


def look_classes(forms: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, class_id, links) of every text: the least id of the texts that look the same, and how many of them differ from it.

    Copies are not expanded into pairs: texts are counted by (look, raw) before looks are. A repeated id counts as often as
    it stands there and comes out once; nulls have no row.
    """
    on = [*keys, "look"]
    by_raw = forms.groupBy(*on, "raw").agg(F.count(F.lit(1)).alias("same"), F.min("id").alias("least"))
    by_look = by_raw.groupBy(*on).agg(F.sum("same").alias("all"), F.min("least").alias("class_id"))
    told = by_raw.drop("least").join(by_look, on).select(*on, "raw", "class_id", (F.col("all") - F.col("same")).alias("links"))
    return forms.select(*on, "raw", "id").distinct().join(told, [*on, "raw"]).select(*keys, "id", "class_id", "links")

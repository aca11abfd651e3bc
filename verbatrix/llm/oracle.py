"""SQL twins of the training-data queries that SQL can express over the whole tables."""

import unicodedata

ORACLE: dict[str, str] = {}

#: White space of any kind, as a character class.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_LINES = rf"""
raw AS (
  SELECT page_id, publication_id, unnest(string_split(full_text, chr(10))) AS line, unnest(range(1, len(string_split(full_text, chr(10))) + 1)) AS line_no
  FROM main_texts WHERE full_text IS NOT NULL AND publication_id IS NOT NULL),
norm AS (
  SELECT page_id, publication_id AS site, line_no, line,
    regexp_replace(trim(regexp_replace(lower(replace(line, 'ß', 'ss')), '{SPACE}+', ' ', 'g')), '\p{{Nd}}+', '0', 'g') AS n FROM raw),
often AS (SELECT site, n FROM norm WHERE n <> '' GROUP BY site, n HAVING count(DISTINCT page_id) >= 10)
"""

ORACLE["p1_found"] = f"WITH {_LINES} SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM norm SEMI JOIN often USING (site, n)"

ORACLE["p1_cleaned"] = f"""
WITH {_LINES},
marked AS (SELECT norm.page_id, norm.line_no, norm.line, often.n IS NOT NULL AS gone FROM norm LEFT JOIN often ON norm.site = often.site AND norm.n = often.n),
done AS (SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS full_text, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS lines_removed FROM marked GROUP BY page_id)
SELECT m.page_id, CASE WHEN m.full_text IS NULL THEN NULL WHEN done.page_id IS NULL THEN m.full_text ELSE done.full_text END AS full_text, coalesce(done.lines_removed, 0) AS lines_removed
FROM main_texts m LEFT JOIN done USING (page_id)
"""


def _characters(distinct: bool) -> str:
    """Rows (c, t) of a table from a character to what it reads like, each one stated once: what has no glyph, white space,
    hyphens, Unicode's compatibility forms and letters of one glyph."""
    rows = {}
    for code in range(0xA0, 0x110000):
        c, kind = chr(code), unicodedata.decomposition(chr(code)).split(" ")[0]
        if kind.startswith("<") and (distinct or kind not in ("<super>", "<sub>", "<circle>", "<fraction>")):
            rows[c] = unicodedata.normalize("NFKC", c)
    blank = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
    hidden = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
    rows |= {chr(c): " " for c in blank} | {chr(c): "" for c in hidden} | {c: "-" for c in "‐‑‒⁃−﹣－"}
    # Letters that share a glyph with a Latin one.
    rows |= dict(zip("АВЕЅІЈКМНОРСТХҮаеорсухіѕјһԁԛԝёЁїЇΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABESIJKMHOPCTXYaeopcyxisjhdqwëËïÏABEZHIKMNOPTYXovcj"))
    quote = lambda x: x.replace("'", "''")
    return ", ".join(f"('{quote(c)}', '{quote(t)}')" for c, t in rows.items() if c != t)


_CHARACTERS = f"known AS (SELECT * FROM (VALUES {_characters(True)}) v(c, t)), alike AS (SELECT * FROM (VALUES {_characters(False)}) v(c, t))"


def _looks(table: str) -> str:
    """SQL of (field, id, raw, t): every text character by character through a table, composed, and through it again."""
    texts = "SELECT 'excerpt' AS field, id, excerpt AS raw FROM evidence_items WHERE excerpt IS NOT NULL UNION ALL SELECT 'quote', id, quote FROM voices WHERE quote IS NOT NULL"

    def step(source: str) -> str:
        return f"""SELECT field, id, raw, nfc_normalize(coalesce(string_agg(coalesce({table}.t, s.c), '' ORDER BY s.k), '')) AS text
          FROM (SELECT field, id, raw, unnest(string_split(text, '')) AS c, unnest(range(length(text) + 1)) AS k FROM ({source})) s LEFT JOIN {table} USING (c) GROUP BY field, id, raw"""

    return f"SELECT field, id, raw, trim(regexp_replace(text, ' +', ' ', 'g')) AS t FROM ({step(step(f'SELECT field, id, raw, raw AS text FROM ({texts})'))})"


ORACLE["p3_found"] = f"""
WITH {_CHARACTERS}, forms AS MATERIALIZED ({_looks('alike')})
SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.field = b.field AND a.t = b.t AND a.raw <> b.raw AND a.id < b.id
"""
ORACLE["p3_classes"] = f"""
WITH {_CHARACTERS}, forms AS MATERIALIZED ({_looks('alike')})
SELECT field, id, min(id) OVER look AS class_id, count(*) OVER look - count(*) OVER (PARTITION BY field, t, raw) AS links
FROM forms WINDOW look AS (PARTITION BY field, t)
"""
ORACLE["p3_forms"] = f"WITH {_CHARACTERS} SELECT field, id, t AS form FROM ({_looks('known')})"

ORACLE["p1_templates"] = f"""
WITH {_LINES},
t AS (SELECT page_id, site, n, string_split(n, ' ') AS w FROM norm WHERE n <> ''),
path AS (SELECT *, len(w) AS k, CASE WHEN len(w) <= 8 THEN w ELSE list_concat(w[1:4], w[-4:]) END AS p FROM t),
node AS (SELECT site, k, i, p[i] AS token FROM (SELECT site, k, p, unnest(range(1, len(p) + 1)) AS i FROM path)),
common AS (SELECT site, k, i, token, true AS c FROM node GROUP BY site, k, i, token HAVING count(*) >= 10),
each AS (SELECT DISTINCT page_id, site, n, k, p FROM path),
marked AS (SELECT e.page_id, e.site, e.n, e.k, e.p, list(coalesce(c, false) ORDER BY e.i) AS f
  FROM (SELECT page_id, site, n, k, p, unnest(range(1, len(p) + 1)) AS i FROM each) e LEFT JOIN common x ON x.site = e.site AND x.k = e.k AND x.i = e.i AND x.token = e.p[e.i] GROUP BY ALL),
shown AS (SELECT page_id, site, k, f, list_transform(p, lambda x, i: CASE WHEN f[i] THEN x ELSE '<*>' END) AS q, n FROM marked WHERE NOT list_contains(f, false) OR len(list_filter(f, lambda x: x)) >= greatest(2, 0.5 * len(f))),
named AS (SELECT page_id, site, k || chr(9) || CASE WHEN NOT list_contains(f, false) THEN n WHEN k <= 8 THEN array_to_string(q, ' ') ELSE array_to_string(list_concat(q[1:4], ['…'], q[5:8]), ' ') END AS template FROM shown)
SELECT site AS publication_id, template, count(DISTINCT page_id) AS pages FROM named GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 10
"""

#: Windows of 12 words, as text, of a table's rows.
_GRAMS = r"""
SELECT {id} AS id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) AS k FROM (
  SELECT {id}, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\p{{L}}\p{{Nd}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12)
"""

ORACLE["p9_found"] = f"""
WITH items AS ({_GRAMS.format(id='item_id', table='eval_items')}), docs AS ({_GRAMS.format(id='doc_id', table='documents')})
SELECT DISTINCT docs.id AS doc_id, items.id AS item_id FROM docs JOIN items USING (g)
"""

#: Sentence marks and what may follow them at the end of a line; marks and rules that are no symbols.
_ENDS = r"[.!?…。！？｡۔؟।॥][\"'”’»」』）)\]›“]*"
_KNOWN = r"[\p{L}\p{M}\p{N}\t-\r\x{1c}-\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.,:;!?'\"\-–—’‘“”„()«»。、，！？「」：；…¿¡।؟،|<>=]"

ORACLE["p10_counts"] = f"""
WITH split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x{{a0}}\\x{{3000}}]')) AS lines FROM documents)
SELECT doc_id, CAST(CASE WHEN lines IS NULL OR len(lines) = 0 THEN 0 ELSE len(w) END AS BIGINT) AS words,
  CASE WHEN len(lines) > 0 THEN CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) ELSE 0.0 END END AS mean_word_length,
  CASE WHEN len(lines) > 0 THEN (length(regexp_replace(text, '{_KNOWN.replace("'", "''")}', '', 'g')) + length(regexp_replace(text, '[^ª²³µ¹º¼½¾]', '', 'g')))::DOUBLE / length(text) END AS symbol_ratio,
  CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '{_ENDS.replace("'", "''")}[\\s\\x{{a0}}\\x{{3000}}]*$')))::DOUBLE / len(lines) END AS punctuated_lines
FROM split
"""

# words and what stands between them are put together again without the words of a leaked window, and without what stands
# between two words of one item's windows
ORACLE["p9_cleaned"] = f"""
WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') AS gaps FROM documents WHERE text IS NOT NULL),
items AS (SELECT DISTINCT id, g FROM ({_GRAMS.format(id='item_id', table='eval_items')})),
docs AS (SELECT doc_id AS id, array_to_string(list_transform(w[k : k + 11], lambda x: lower(replace(x, 'ß', 'ss'))), ' ') AS g, k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM cut WHERE len(w) >= 12)),
hits AS (SELECT DISTINCT docs.id AS doc_id, items.id AS item_id, k FROM docs JOIN items USING (g)),
held AS (SELECT DISTINCT doc_id, item_id, unnest(range(k, k + 12)) AS i FROM hits),
gone AS (SELECT DISTINCT doc_id, i FROM held),
joined AS (SELECT DISTINCT a.doc_id, a.i FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.i = a.i + 1),
leaked AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM hits GROUP BY 1),
words AS (SELECT doc_id, w, gaps, unnest(range(0, len(w) + 1)) AS i FROM cut SEMI JOIN leaked USING (doc_id)),
kept AS (SELECT x.doc_id, string_agg(CASE WHEN x.i = 0 OR g.i IS NOT NULL THEN '' ELSE w[x.i] END || CASE WHEN j.i IS NOT NULL THEN '' ELSE gaps[x.i + 1] END, '' ORDER BY x.i) AS text
  FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i LEFT JOIN joined j ON j.doc_id = x.doc_id AND j.i = x.i GROUP BY 1)
SELECT d.doc_id, CASE WHEN kept.doc_id IS NULL THEN d.text ELSE kept.text END AS text, coalesce(n, 0) AS leaked_items FROM documents d LEFT JOIN leaked USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# what any right packing gives, whichever it is
ORACLE["p8_checked"] = "SELECT container, (SELECT count(*) FROM documents) AS documents, true AS whole, true AS within, true AS tight FROM container_sizes WHERE capacity_tokens >= 1"

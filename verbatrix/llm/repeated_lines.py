"""Problem 1: lines repeated across one site's pages, found with fixed-depth token trees with learnt wildcard slots.

A line is normalised (white space runs to one space, ends trimmed, case folded, digit runs to one digit) and walks a tree of
fixed depth: site, number of tokens, its first HEAD and its last TAIL tokens. One pass reads every text, grows the tree of
its partition and keeps the lines' paths; the trees merge by adding the counts of equal nodes. A node that too few lines
share is a wildcard slot: where a byline's name varies, no name is common, so slots are learnt and not given. A path without
a slot ends in a leaf of its own line, as nothing in it varies; a path with slots in the leaf of its template, if enough of
it is fixed. Leaves are counted by distinct page; lines that a slot keeps from being whole never meet a count as lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm.arrow import map_batches, pa, pc
from verbatrix.operators.sizing import BROADCAST_BYTES, join_measured, materialise

DIGITS = re.compile(r"\d+")
#: Depth of the tree: tokens of a line's beginning and end that its path has.
HEAD, TAIL = 4, 4
#: A template with slots has so many fixed tokens, and this share of its path.
FIXED, FIXED_SHARE = 2, 0.5
#: Nodes a partition's tree may hold before it is handed on; the rest of the partition starts a new tree to merge.
TREE_NODES = 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def normal_line(line: str) -> str:
    return DIGITS.sub("0", " ".join(line.split()).casefold())


def path_of(tokens: list[str]) -> list[str]:
    """The tokens of a line that its path has."""
    return tokens if len(tokens) <= HEAD + TAIL else tokens[:HEAD] + tokens[-TAIL:]


def template_path(line: str, slots: int = 0) -> str:
    """A normalised line as a template: token count and tokens; bit k of slots makes the path's k-th token a <*>, and with any slot what the path leaves out an …."""
    tokens = line.split(" ")
    if not slots:
        return f"{len(tokens)}\t{line}"
    shown = ["<*>" if slots >> k & 1 else t for k, t in enumerate(path_of(tokens))]
    if len(tokens) > HEAD + TAIL:
        shown.insert(HEAD, "…")
    return f"{len(tokens)}\t" + " ".join(shown)


class _Hashes(dict):
    """Token to 64-bit hash, emptied when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * _B
        return x ^ (x >> np.uint64(32))


def _grow(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per text a row of its lines' numbers, hashes, token counts and paths; per tree rows without a page of nodes and counts."""
    tokens_of = _Hashes()
    nodes, counts = [], []

    def tree() -> pa.RecordBatch:
        flat, back = np.unique(np.concatenate(nodes), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(counts)).astype("int32")
        nodes[:], counts[:] = [flat], [total]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(0).type), pa.nulls(1, schema.field(1).type), one(total), none, none.cast(pa.list_(pa.int32())), one(flat.view("int64"))], schema=schema)

    for b in batches:
        kept, no, lines, ks, sizes, flat, lengths, widths, sites = [], [], [], [], [], [], [], [], []
        for row, (page, site, text) in enumerate(zip(b.column("page").to_pylist(), b.column("site").to_pylist(), b.column("text").to_pylist())):
            if text is None or site is None or page is None:
                continue
            first, start = len(no), len(flat)
            for i, line in enumerate(text.split("\n"), 1):
                if n := normal_line(line):
                    tokens = n.split(" ")
                    path = path_of(tokens)
                    no.append(i)
                    lines.append(xxhash.xxh3_64_intdigest(n))
                    ks.append(len(tokens))
                    sizes.append(len(path))
                    flat.extend([tokens_of[t] for t in path])
            if len(no) > first:
                kept.append(row)
                lengths.append(len(no) - first)
                widths.append(len(flat) - start)
                sites.append(xxhash.xxh3_64_intdigest(str(site)))
        if not kept:
            continue
        size = np.array(sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        with np.errstate(over="ignore"):
            where = _mixed(np.repeat(np.repeat(np.array(sites, dtype="uint64"), lengths) + np.array(ks, dtype="uint64") * _C, size) + (place + 1).astype("uint64") * _A)
        node = _mixed(np.array(flat, dtype="uint64") ^ where)
        found, times = np.unique(node, return_counts=True)
        nodes.append(found)
        counts.append(times)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        each = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(no, pa.int32()), pa.array(np.array(lines, dtype="uint64").view("int64")), pa.array(ks, pa.int32()))]
        path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32()), pa.array(node.view("int64")))
        yield pa.RecordBatch.from_arrays([b.column("page").take(pa.array(kept)), b.column("site").take(pa.array(kept)), *each, path], schema=schema)
        if sum(map(len, nodes)) > TREE_NODES:
            yield tree()
            nodes.clear()
            counts.clear()
    if nodes:
        yield tree()


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _leaves(common):
    """Every line's leaf and slots, out of its path and which nodes are common: a broadcast sorted array, or the column common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.list_value_length(b.column("no")).to_numpy(zero_copy_only=False)
            k, line, nodes = _flat(b.column("k")), _flat(b.column("line")), _flat(b.column("path"))
            size = np.minimum(k, HEAD + TAIL)
            if common is None:
                fixed = _flat(b.column("common"))
            else:
                fixed = common.value[np.minimum(np.searchsorted(common.value, nodes), len(common.value) - 1)] == nodes
            start = np.cumsum(size) - size
            held = np.add.reduceat(fixed.astype("int64"), start)
            place = np.arange(len(nodes)) - np.repeat(start, size)
            slots = np.add.reduceat(np.where(fixed, 0, 1 << place), start)
            with np.errstate(over="ignore"):
                leaf = np.add.reduceat(np.where(fixed, _mixed(nodes.view("uint64")), np.uint64(0)), start) + k.astype("uint64") * _C + _A
            leaf = np.where(slots == 0, line, _mixed(leaf).view("int64"))
            kept = (slots == 0) | (held >= FIXED) & (held >= FIXED_SHARE * size)
            row = np.repeat(np.arange(b.num_rows), lengths)[kept]
            page, site = (b.column(c).take(pa.array(row)) for c in ("page", "site"))
            yield pa.RecordBatch.from_arrays([page, site, pa.array(_flat(b.column("no"))[kept], pa.int32()), pa.array(leaf[kept]), pa.array(slots[kept], pa.int32())], names=["page", "site", "line_no", "leaf", "slots"])

    return run


def template_lines(pages: DataFrame, page_col: str = "page_id", site_col: str = "publication_id", text_col: str = "full_text", min_pages: int = 10) -> DataFrame:
    """(page, site, line_no, leaf, slots) of every line that no rare token keeps out of a leaf; slots are bits of the path.

    The common nodes travel as one sorted array while their measured size allows; beyond, paths and nodes are joined and
    each text's lines put together again. The result is the same.
    """
    rows = pages.select(F.col(page_col).alias("page"), F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    arrays = "no array<int>, line array<bigint>, k array<int>, path array<bigint>"
    grown = rows.mapInArrow(_growing(f"page {kinds['page']}, site {kinds['site']}, {arrays}"), f"page {kinds['page']}, site {kinds['site']}, {arrays}")
    grown = materialise(grown)
    trees = grown.filter("page IS NULL").select(F.explode(F.arrays_zip("path", "no")).alias("t")).groupBy(F.col("t.path").alias("node")).agg(F.sum("t.no").alias("lines"))
    common = materialise(trees.filter(F.col("lines") >= min_pages).select("node"))
    texts = grown.filter("page IS NOT NULL")
    schema = f"page {kinds['page']}, site {kinds['site']}, line_no int, leaf bigint, slots int"
    if common.count() * 8 <= BROADCAST_BYTES // 4:
        known = np.sort(np.array([r[0] for r in common.collect()] or [0], dtype="int64"))
        return texts.mapInArrow(_leaves(pages.sparkSession.sparkContext.broadcast(known)), schema)
    keyed = materialise(texts.withColumn("text", F.monotonically_increasing_id()))
    each = join_measured(keyed.select("text", F.posexplode("path").alias("at", "node")), common.withColumn("hit", F.lit(True)), ["node"], "left")
    flags = each.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("x"))
    return keyed.join(flags.select("text", F.col("x.hit").alias("common")), "text").drop("text").mapInArrow(_leaves(None), schema)


def _growing(ddl: str):
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return lambda batches: _grow(batches, schema)


def covering(lines: DataFrame, min_pages: int = 10) -> DataFrame:
    """(site, leaf, slots, pages, page, line_no) of the leaves on at least min_pages distinct pages, the last two of one of its lines."""
    # distinct (leaf, page) first: a hot leaf is spread over its pages, and only one row a task is left for the count
    by_page = lines.groupBy("site", "leaf", "slots", "page").agg(F.min("line_no").alias("line_no"))
    counted = by_page.groupBy("site", "leaf", "slots").agg(F.count(F.lit(1)).alias("pages"), F.min(F.struct("page", "line_no")).alias("first"))
    return counted.filter(F.col("pages") >= min_pages).select("site", "leaf", "slots", "pages", "first.page", "first.line_no")


def line_templates(pages: DataFrame, page_col: str = "page_id", site_col: str = "publication_id", text_col: str = "full_text", min_pages: int = 10) -> DataFrame:
    """Templates (site, leaf, template, pages) that cover at least min_pages distinct pages of a site; `template` shows token count and tokens, with <*> slots.

    Nulls in page, site or text, and empty texts, add nothing; an empty table gives an empty result.
    """
    found = covering(template_lines(pages, page_col, site_col, text_col, min_pages), min_pages)
    rows = pages.select(F.col(page_col).alias("page"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    # the few templates are shown by one line each, which is read again
    shown = rows.join(F.broadcast(found) if found.count() * 64 <= BROADCAST_BYTES else found, "page").select("site", "leaf", "slots", "pages", F.element_at("lines", F.col("line_no")).alias("line"))
    kind = found.schema["site"].dataType.simpleString()

    def show(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {"site": b["site"], "leaf": b["leaf"], "template": [template_path(normal_line(x), s) for x, s in zip(b["line"], b["slots"])], "pages": b["pages"]}

    return map_batches(shown, show, f"site {kind}, leaf bigint, template string, pages bigint").dropDuplicates(["site", "leaf", "template"])


def repeated_lines(pages: DataFrame, page_col: str = "page_id", site_col: str = "publication_id", text_col: str = "full_text", min_pages: int = 10, slots: bool = False) -> DataFrame:
    """(page, line_no) of every non-blank line whose template stands on at least min_pages distinct pages of its site.

    Templates without slots are whole lines; with `slots` those with slots count too. line_no counts from 1 at `\\n`. Rows
    with a null page, site or text give nothing; repeated rows of one page count once and give their lines once; long texts
    are taken whole; further columns are ignored. Leaves are keyed by 64-bit hashes within sites.
    """
    lines = template_lines(pages, page_col, site_col, text_col, min_pages)
    lines = lines if slots else lines.filter("slots = 0")
    often = covering(lines, min_pages).select("site", "leaf", "slots")
    return join_measured(lines, often, ["site", "leaf", "slots"], "left_semi").select("page", "line_no").dropDuplicates(["page", "line_no"])


def without_repeated_lines(pages: DataFrame, page_col: str = "page_id", site_col: str = "publication_id", text_col: str = "full_text", min_pages: int = 10, slots: bool = False) -> DataFrame:
    """pages with text_col freed of its repeated lines, with `slots` of those of templates too, and a column `lines_removed`; every other column is kept.

    A null text stays null with 0 removed; a text of which every line goes becomes empty.
    """
    found = repeated_lines(pages, page_col, site_col, text_col, min_pages, slots)
    # names of its own, so that no column of pages clashes; a `lines_removed` of an earlier run is replaced
    hidden, key = "__repeated_line_numbers", "__repeated_line_page"
    gone = found.groupBy("page").agg(F.collect_set("line_no").alias(hidden)).withColumnRenamed("page", key)
    joined = pages.drop("lines_removed").join(gone, F.col(page_col) == F.col(key), "left")
    none = F.array().cast("array<int>")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.coalesce(F.col(hidden), none), i + 1))
    return joined.withColumn(text_col, F.array_join(kept, "\n")).withColumn("lines_removed", F.coalesce(F.size(hidden), F.lit(0))).drop(hidden, key)

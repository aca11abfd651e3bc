"""Problem 9: passages of evaluation items inside training documents.

The items' normalised word n-grams become a set of rolling 64-bit hashes that is broadcast; documents are scanned
partition by partition with numpy over the same rolling hash, hits are verified word by word, and runs of windows are
merged into character spans that can be cut out. An item set above `block_chars` characters isn't broadcast: a bitmap of
fixed size of its hashes is, and the windows that pass it meet the n-grams in a join. Documents are scanned once either way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm.arrow import map_batches
from verbatrix.operators.sizing import materialise

WORDS = re.compile(r"[^\W_]+")
#: Characters of item text whose n-grams are broadcast: about 40 bytes of table for each.
BLOCK_CHARS = 2_000_000
#: Bits of the bitmap of a larger item set (16 MB), and of each of the parts it is put together from.
BITMAP_BITS, PART_BITS = 1 << 27, 1 << 16
#: Words scanned in one numpy step.
STEP_WORDS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Word to 64-bit hash, emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[str]:
    return [w.casefold() for w in WORDS.findall(text)]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every window of n word hashes (wraps modulo 2**64)."""
    out = np.zeros(max(0, len(words) - n + 1), dtype="uint64")
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + words[k : k + len(out)]
    return out


def item_index(items: list[tuple[object, str]], n: int) -> tuple[np.ndarray, list[tuple[int, int]], list[list[str]], list]:
    """Sorted window hashes, (row of the item, first word) beside each, the words of the rows and their ids: rows may share an id."""
    hashes, places, words = [], [], []
    cache = _WordHashes()
    for row, (_, text) in enumerate(items):
        w = words_of(text)
        words.append(w)
        h = window_hashes(np.fromiter((cache[x] for x in w), dtype="uint64", count=len(w)), n)
        hashes.append(h)
        places.extend((row, k) for k in range(len(h)))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype="uint64")
    order = np.argsort(flat, kind="stable")
    return flat[order], [places[i] for i in order], words, [item for item, _ in items]


def merged(windows: list[tuple[int, int]]) -> list[list[int]]:
    """Runs (first, last) of overlapping or touching sorted windows."""
    runs: list[list[int]] = []
    for first, last in windows:
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(last, runs[-1][1])
        else:
            runs.append([first, last])
    return runs


def _scan(index, n: int):
    hashes, places, item_words, item_ids = index.value

    def hits(docs: list[tuple[object, list[str], np.ndarray]]) -> Iterator[tuple[object, int, int, int]]:
        flat = np.concatenate([h for _, _, h in docs])
        windows = window_hashes(flat, n)
        left = np.searchsorted(hashes, windows)
        found = np.flatnonzero(hashes[np.minimum(left, len(hashes) - 1)] == windows)
        if not len(found):
            return
        starts = np.cumsum([0, *(len(h) for _, _, h in docs)])
        for at in found:
            d = int(np.searchsorted(starts, at, side="right")) - 1
            doc, words, _ = docs[d]
            first = int(at - starts[d])
            if first + n > len(words):
                continue  # the window runs into the next document
            k = int(left[at])
            while k < len(hashes) and hashes[k] == windows[at]:
                item, place = places[k]
                if item_words[item][place : place + n] == words[first : first + n]:
                    yield doc, item, first, first + n
                k += 1

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        cache = _WordHashes()
        for b in batches:
            out: dict[str, list] = {"doc": [], "item": [], "start_char": [], "end_char": [], "words": []}
            docs: list = []
            texts: dict = {}
            size = 0

            def flush() -> None:
                found: dict[tuple, list[tuple[int, int]]] = {}
                for row, item, first, last in sorted(set(hits(docs))):
                    found.setdefault((row, item), []).append((first, last))
                for (row, item), windows in found.items():
                    doc, text = texts[row]
                    bounds = [m.span() for m in WORDS.finditer(text)]
                    for first, last in merged(windows):
                        out["doc"].append(doc)
                        out["item"].append(item_ids[item])
                        out["start_char"].append(bounds[first][0])
                        out["end_char"].append(bounds[last - 1][1])
                        out["words"].append(last - first)
                docs.clear()
                texts.clear()

            for row, (doc, text) in enumerate(zip(b["doc"], b["text"])):
                if not text or doc is None:
                    continue
                w = words_of(text)
                if len(w) >= n:
                    docs.append((row, w, np.fromiter((cache[x] for x in w), dtype="uint64", count=len(w))))
                    texts[row] = (doc, text)
                    size += len(w)
                    if size > STEP_WORDS:
                        flush()
                        size = 0
            if docs:
                flush()
            yield out

    return run


def _grams(n: int):
    """Every window of the items, with its words."""
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        cache = _WordHashes()
        for b in batches:
            out: dict[str, list] = {"h": [], "item_row": [], "item": [], "gram": []}
            for row, item, text in zip(b["item_row"], b["item"], b["text"]):
                w = words_of(text)
                h = window_hashes(np.fromiter((cache[x] for x in w), dtype="uint64", count=len(w)), n).view("int64").tolist()
                out["h"].extend(h)
                out["item_row"].extend([row] * len(h))
                out["item"].extend([item] * len(h))
                out["gram"].extend(" ".join(w[k : k + n]) for k in range(len(h)))
            yield out

    return run


def _pack(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for b in batches:
        bits = []
        for places in b["bits"]:
            part = np.zeros(PART_BITS, dtype=bool)
            part[places] = True
            bits.append(np.packbits(part).tobytes())
        yield {"part": b["part"], "bits": bits}


def _bitmap(grams: DataFrame) -> np.ndarray:
    """The bits that the n-grams' hashes set, put together from parts of fixed size; never more than BITMAP_BITS travel."""
    at = F.pmod(F.col("h"), F.lit(BITMAP_BITS))
    parts = grams.select(at.alias("at")).distinct().groupBy((F.col("at") / PART_BITS).cast("int").alias("part")).agg(F.collect_list((F.col("at") % PART_BITS).cast("int")).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, dtype="uint8")
    for r in map_batches(parts, _pack, "part int, bits binary").collect():
        out[r["part"] * PART_BITS // 8 : (r["part"] + 1) * PART_BITS // 8] = np.frombuffer(r["bits"], dtype="uint8")
    return out


def _passing(bitmap, n: int):
    """The windows of documents whose bit is set."""
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        cache = _WordHashes()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("h", "doc_row", "doc", "first", "start_char", "end_char", "gram")}
            for row, doc, text in zip(b["doc_row"], b["doc"], b["text"]):
                if not text or doc is None:
                    continue
                w = words_of(text)
                windows = window_hashes(np.fromiter((cache[x] for x in w), dtype="uint64", count=len(w)), n).view("int64")
                at = np.mod(windows, BITMAP_BITS)
                passed = np.flatnonzero(bitmap.value[at >> 3] >> (7 - (at & 7)).astype("uint8") & 1)
                if not len(passed):
                    continue
                bounds = [m.span() for m in WORDS.finditer(text)]
                for k in passed.tolist():
                    for column, value in zip(out, (int(windows[k]), row, doc, k, bounds[k][0], bounds[k + n - 1][1], " ".join(w[k : k + n]))):
                        out[column].append(value)
            yield out

    return run


def _spans(n: int):
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc", "item", "start_char", "end_char", "words")}
            for doc, item, found in zip(b["doc"], b["item"], b["found"]):
                starts, ends = {w["first"]: w["start_char"] for w in found}, {w["first"] + n: w["end_char"] for w in found}
                for first, last in merged([(w, w + n) for w in sorted(starts)]):
                    for column, value in zip(out, (doc, item, starts[first], ends[last], last - first)):
                        out[column].append(value)
            yield out

    return run


def leaked_spans(docs: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, item, start_char, end_char, words) of every maximal run of at least n words that an item shares with a document.

    Words are runs of letters and digits, case folded. Null or short texts on either side match nothing; repeated items
    or documents give their rows each, whether their texts agree or not; an empty side gives an empty result. Texts are
    scanned whole and once, whatever the size of the item set.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    wanted = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull() & F.col("item").isNotNull())
    total = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    kinds = rows.schema["doc"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, start_char int, end_char int, words int"
    if total <= block_chars:
        index = item_index([(r["item"], r["text"]) for r in wanted.collect()], n)
        return map_batches(rows, _scan(spark.sparkContext.broadcast(index), n), schema) if len(index[0]) else spark.createDataFrame([], schema)
    grams = materialise(map_batches(wanted.withColumn("item_row", F.monotonically_increasing_id()), _grams(n), f"h bigint, item_row bigint, item {kinds[1]}, gram string"))
    bitmap = spark.sparkContext.broadcast(_bitmap(grams))
    passed = map_batches(rows.withColumn("doc_row", F.monotonically_increasing_id()), _passing(bitmap, n), f"h bigint, doc_row bigint, doc {kinds[0]}, first int, start_char int, end_char int, gram string")
    met = passed.join(grams, ["h", "gram"]).groupBy("doc_row", "doc", "item_row", "item").agg(F.collect_list(F.struct("first", "start_char", "end_char")).alias("found"))
    return map_batches(met.select("doc", "item", "found"), _spans(n), schema)


def without_leaks(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the leaked character spans cut out of text and a column `leaked_items`; other columns are kept.

    The spans of one document are few, so they travel as one array to its row; overlapping spans count once.
    """
    cut = spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start_char", "end_char"))).alias("__leaked_spans"), F.count_distinct("item").alias("leaked_items")).withColumnRenamed("doc", "__leaked_doc")
    joined = docs.drop("leaked_items").join(cut, F.col(doc_id) == F.col("__leaked_doc"), "left")
    t = F.col(text)
    state = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    step = F.aggregate(
        "__leaked_spans",
        state,
        lambda acc, s: F.struct(
            F.concat(acc["kept"], t.substr(acc["at"] + 1, F.greatest(s["start_char"] - acc["at"], F.lit(0)))).alias("kept"),
            F.greatest(acc["at"], s["end_char"]).alias("at"),
        ),
        lambda acc: F.concat(acc["kept"], t.substr(acc["at"] + 1, F.length(t))),
    )
    return joined.withColumn(text, F.when(F.col("__leaked_spans").isNull(), t).otherwise(step)).withColumn("leaked_items", F.coalesce("leaked_items", F.lit(0))).drop("__leaked_spans", "__leaked_doc")

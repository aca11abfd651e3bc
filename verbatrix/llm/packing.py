"""Problem 8: documents into containers of fixed capacity, measured in tokens of a public tokenizer.

Sizes are counted where the texts are read; only ids and sizes go on, dealt out evenly into blocks of about `block`
documents whatever their ids, so no group of documents can outgrow a task, and what packing across blocks could save is
less than a container or two a block. Within a block, documents above a third of the capacity are matched first, two to a container at most: the
largest takes the largest other one that still fits. The smaller ones, largest first, go each into the fullest container
that has room. Only a document larger than a container is cut, into full containers and a rest that is packed on.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm.arrow import map_batches
from verbatrix.operators.sizing import materialise

#: Folder of the public vocabularies and the file used; both are parameters of token_counts and packed.
TOKENIZERS = os.environ.get("VERBATRIX_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents packed together.
BLOCK = 50_000


@lru_cache(maxsize=4)
def encoding(folder: str, vocabulary: str):
    import base64

    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers as lists of (item, first token, tokens). Every item is in one container, or cut if it exceeds one."""
    bins: list[list[tuple[int, int, int]]] = []
    room: list[int] = []
    rest: list[tuple[int, int, int]] = []  # (size, item, first token)
    for item, size in enumerate(sizes):
        first = 0
        while size - first > capacity:
            bins.append([(item, first, capacity)])
            room.append(0)
            first += capacity
        rest.append((size - first, item, first))
    rest.sort(key=lambda r: (r[0], r[1]))
    small_to = bisect_right(rest, (capacity // 3, float("inf"), 0))
    large = rest[small_to:]
    # the largest left with the largest other one that fits beside it: one pointer from either end, and a stack between
    waiting: list[tuple[int, int, int]] = []
    low = 0
    for high in range(len(large) - 1, -1, -1):
        if high < low:
            break
        size, item, first = large[high]
        while low < high and large[low][0] <= capacity - size:
            waiting.append(large[low])
            low += 1
        bins.append([(item, first, size)])
        if waiting:
            other, item2, first2 = waiting.pop()
            bins[-1].append((item2, first2, other))
            room.append(capacity - size - other)
        else:
            room.append(capacity - size)
    # what still waits is small enough to pair among itself, the largest with the smallest
    while waiting:
        size, item, first = waiting.pop()
        bins.append([(item, first, size)])
        if waiting and size + waiting[-1][0] <= capacity:
            other, item2, first2 = waiting.pop()
            bins[-1].append((item2, first2, other))
            size += other
        room.append(capacity - size)
    # containers by room, and the rooms that have any as the bits of one number: best fit in one step
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        by_room.setdefault(r, []).append(b)
        mask |= 1 << r
    for size, item, first in reversed(rest[:small_to]):
        at = mask >> size
        if at:
            r = size + (at & -at).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(bins), capacity
            bins.append([])
        bins[b].append((item, first, size))
        by_room.setdefault(r - size, []).append(b)
        mask |= 1 << (r - size)
    return bins


def _sizes(vocabulary: str):
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        encode = encoding(SparkFiles.getRootDirectory(), vocabulary).encode_ordinary
        for b in batches:
            yield {"id": b["id"], "tokens": [len(encode(t)) if t else 0 for t in b["text"]]}

    return run


def _pack(containers: list[tuple[str, int]]):
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        ids: list = []
        sizes: list[int] = []
        for b in batches:
            ids.extend(b["id"])
            sizes.extend(b["tokens"])
        count = 0
        for name, capacity in containers:
            out: dict[str, list] = {k: [] for k in ("container", "capacity", "bin", "id", "first_token", "tokens")}
            for content in pack(sizes, capacity):
                for item, first, size in content:
                    for key, value in zip(out, (name, capacity, (task << 40) | count, ids[item], first, size)):
                        out[key].append(value)
                count += 1
            yield out

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens) of every row; null and empty texts have 0. The vocabulary is shipped with the job, so only the driver needs the folder."""
    docs.sparkSession.sparkContext.addFile(os.path.join(folder, vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, _sizes(vocabulary), f"id {rows.schema['id'].dataType.simpleString()}, tokens bigint")


def packed(docs: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(container, capacity, bin, id, first_token, tokens): every document's place in the containers of every size.

    containers (container, capacity_tokens) is a short list of sizes, read to the driver; sizes that are null or below 1
    are left out. Null and empty texts have no tokens and lie in any container; repeated rows are packed each; a document
    larger than the capacity has one row a piece, of which all but the last fill a container.
    """
    sizes = [(r[0], r[1]) for r in containers.select("container", "capacity_tokens").filter(F.col("capacity_tokens") >= 1).distinct().orderBy("container", "capacity_tokens").collect()]
    counts = materialise(token_counts(docs, id_col, text_col, folder, vocabulary))
    kind = counts.schema["id"].dataType.simpleString()
    blocks = counts.repartition(max(1, -(-counts.count() // block)))
    return map_batches(blocks, _pack(sizes), f"container string, capacity bigint, bin bigint, id {kind}, first_token bigint, tokens bigint")


def checked(packing: DataFrame, counts: DataFrame, slack: float = 1.02) -> DataFrame:
    """(container, documents, whole, within, tight) of a packing of documents with these token counts.

    whole: every document's pieces follow each other from its first to its last token; within: no bin holds more than its
    capacity; tight: there are at most `slack` times the bins that the tokens' volume alone needs, and one.
    """
    pieces = packing.groupBy("container", "capacity").agg(F.count_if(F.col("first_token") == 0).alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("first_token") > 0, F.col("first_token") % F.col("capacity")).otherwise(0)).alias("odd"))
    bins = packing.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t")).groupBy("container", "capacity").agg(F.max("t").alias("fullest"), F.count(F.lit(1)).alias("bins"))
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))  # one row
    c = F.col
    return (
        pieces.join(bins, ["container", "capacity"])
        .join(F.broadcast(total), F.lit(True))
        .select("container", "documents", ((c("documents") == c("n")) & (c("tokens") == c("all")) & (c("odd") == 0)).alias("whole"), (c("fullest") <= c("capacity")).alias("within"), (c("bins") <= slack * F.ceil(c("all") / c("capacity")) + 1).alias("tight"))
    )


def fill(packing: DataFrame) -> DataFrame:
    """(container, capacity, documents, bins, tokens, fill) of a packing; fill is tokens over the room of all bins."""
    bins = packing.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("first_token") == 0).alias("documents"))
    total = bins.groupBy("container", "capacity").agg(F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"))
    return total.withColumn("fill", F.round(F.try_divide(F.col("tokens"), F.col("bins") * F.col("capacity")), 6))

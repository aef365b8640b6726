"""Filling fixed-capacity containers: Martello-Toth dominance reduction, then best fit for the remainder.

Documents of one size are interchangeable, so the plan is made on the histogram of sizes (at most one entry
for each size up to the capacity, whatever the number of documents) as a list of patterns with
multiplicities; documents are then numbered within their size and put into the plan's places.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.session import materialized

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _encoder(name: str, vocabulary: bytes):
    import tiktoken

    #: Fixed value: the pattern that splits text before the merges of this kind of vocabulary.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document with an id; null texts have none.

    The vocabulary file (a megabyte or so) is read from the path on the driver and sent to the executors, which needn't have it.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((os.path.basename(tokenizer), f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*shared.value).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    return slim.mapInArrow(run, "doc_id bigint, tokens bigint")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int, str]]:
    """(sizes of a container, how many containers, how found) until no item is left; sizes are 1 to capacity.

    Reduction, largest size w first, r its free space. Alone where nothing fits beside it. With the largest
    item that fits, where that fills the container, or no two items fit beside w, or no three do and none of
    the pairs is larger: every other feasible set with w is dominated, so the choice is fixed for good.
    Every pass begins again as long as one fixed something, since what is left has become less.
    Remainder: each container takes the largest item left, then again and again the best-fitting item, and
    for its last two places the best-fitting pair.
    """
    left = np.zeros(capacity + 1, np.int64)
    for w, n in counts.items():
        if not 1 <= w <= capacity:
            raise ValueError(f"size {w} outside 1..{capacity}")
        left[w] += n
    out: list[tuple[tuple[int, ...], int, str]] = []

    def take(sizes: tuple[int, ...], how: str) -> None:
        need: dict[int, int] = {}
        for s in sizes:
            need[s] = need.get(s, 0) + 1
        m = min(int(left[s]) // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= m * k
        out.append((sizes, m, how))

    def largest(limit: int, used: int = 0) -> int:
        """The largest size up to limit that is left (used: a size of which one is taken already)."""
        while limit > 0:
            at = np.flatnonzero(left[1 : limit + 1])
            if not len(at):
                return 0
            s = int(at[-1]) + 1
            if s != used or left[s] > 1:
                return s
            limit = s - 1
        return 0

    changed = True
    while changed:
        changed = False
        for w in map(int, np.flatnonzero(left)[::-1]):
            while left[w] > 0:
                r = capacity - w
                small = _smallest(left, w)
                if not small or small[0] > r:
                    out.append(((w,), int(left[w]), "alone"))
                    left[w] = 0
                    changed = True
                    break
                k = largest(r, w)
                only_one = len(small) < 2 or small[0] + small[1] > r
                only_two = len(small) < 3 or sum(small[:3]) > r
                if w + k == capacity or only_one or (only_two and k >= _best_pair(left, r, w)[0]):
                    take((w, k), "dominant")
                    changed = True
                else:
                    break
    while True:
        w = largest(capacity)
        if not w:
            return out
        sizes, r = [w], capacity - w
        left[w] -= 1
        while r > 0 and (k := largest(r)):
            total, a, b = _best_pair(left, r, 0) if r <= 2 * k else (0, 0, 0)
            chosen = [a, b] if total > k else [k]
            for s in chosen:
                left[s] -= 1
                sizes.append(s)
                r -= s
        for s in sizes:
            left[s] += 1
        take(tuple(sizes), "best fit")


def _smallest(left: np.ndarray, used: int) -> list[int]:
    """The up to three smallest items that are left beside one of size used."""
    out: list[int] = []
    for s in map(int, np.flatnonzero(left)[:4]):
        out += [s] * min(3, int(left[s]) - (s == used))
        if len(out) >= 3:
            break
    return out[:3]


def _best_pair(left: np.ndarray, r: int, used: int) -> tuple[int, int, int]:
    """(sum, a, b) of the two items left whose sum comes nearest to r from below."""
    have = np.flatnonzero(left[: r + 1])
    if used and used <= r and left[used] == 1:
        have = have[have != used]
    if not len(have):
        return 0, 0, 0
    at = np.searchsorted(have, r - have, side="right") - 1
    ok = at >= 0
    a, b = have[ok], have[at[ok]]
    twin = (a == b) & (left[a] - (a == used) < 2)
    if twin.any():  # the next smaller partner
        prev = np.searchsorted(have, b[twin]) - 1
        b = b.copy()
        b[twin] = np.where(prev >= 0, have[np.maximum(prev, 0)], 0)
        a, b = a[b > 0], b[b > 0]
    if not len(a):
        return 0, 0, 0
    i = int((a + b).argmax())
    return int(a[i] + b[i]), int(a[i]), int(b[i])


def _places(patterns: list[tuple[tuple[int, ...], int, str]]) -> dict[int, np.ndarray]:
    """size -> rows (first rank, first container, containers, how many of the size in each)."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 1
    for sizes, m, _ in patterns:
        need: dict[int, int] = {}
        for s in sizes:
            need[s] = need.get(s, 0) + 1
        for s, k in need.items():
            at = rank.get(s, 0)
            rows.setdefault(s, []).append((at, base, m, k))
            rank[s] = at + m * k
        base += m
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def pack(sizes: DataFrame, capacity: int, bucket_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, part, tokens, container_no, capacity): the container of each document, or of each part of one.

    A document larger than the capacity is cut into full containers and a rest, which is packed like a small
    document; others stay whole; documents without tokens go nowhere and have no row. The histogram and
    the plan (at most as many patterns and sizes as the capacity has tokens, about) are what the driver and each
    task hold. Ranks within a size are counted in buckets of about bucket_rows rows, so a size that most
    documents share is no task's burden. Repeated rows take a place each.
    """
    spark = sizes.sparkSession
    whole = F.floor(F.col("tokens") / capacity)
    rest = F.col("tokens") % capacity
    parts = sizes.where("tokens > 0").select("doc_id", "tokens", whole.alias("full"), rest.alias("rest"))
    items = parts.where("rest > 0").select("doc_id", F.when(F.col("full") > 0, F.col("full") + 1).otherwise(F.lit(0)).alias("part"), F.col("rest").alias("tokens"))
    full = parts.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("part"), F.lit(capacity).cast("bigint").alias("tokens"), (F.when(F.col("rest") > 0, 1).otherwise(0) + F.col("full")).alias("n"))
    full = full.select("doc_id", F.when(F.col("n") == 1, 0).otherwise(F.col("part")).cast("bigint").alias("part"), "tokens")
    items = items.select("doc_id", F.col("part").cast("bigint"), "tokens").unionByName(full)
    histogram = items.groupBy("tokens").count().collect()  # at most capacity rows
    total = sum(r["count"] for r in histogram)
    patterns = plan({int(r["tokens"]): int(r["count"]) for r in histogram}, capacity)
    buckets = max(1, -(-total // bucket_rows))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)))
    offsets = items.groupBy("tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = offsets.select("tokens", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("tokens", "bucket").orderBy("doc_id", "part")))
    ranked = ranked.join(offsets, ["tokens", "bucket"]).select("doc_id", "part", "tokens", (F.col("rank") - 1 + F.col("before")).cast("bigint").alias("rank"))
    shared = spark.sparkContext.broadcast(_places(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for b in batches:
            tokens, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            no = np.zeros(len(rank), np.int64)
            for s in np.unique(tokens):
                mine = tokens == s
                p = places[int(s)]
                at = np.searchsorted(p[:, 0], rank[mine], side="right") - 1
                no[mine] = p[at, 1] + (rank[mine] - p[at, 0]) // p[at, 3]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(no)], ["doc_id", "part", "tokens", "container_no"])

    got = ranked.mapInArrow(run, "doc_id bigint, part bigint, tokens bigint, container_no bigint")
    return got.withColumn("capacity", F.lit(capacity).cast("bigint"))


def pack_all(docs: DataFrame, doc_id: str, text: str, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack() for each capacity of a container table (container_id, capacity_tokens), with its container_id."""
    sizes = materialized(token_sizes(docs, doc_id, text, tokenizer))
    out = None
    for row in containers.where("capacity_tokens > 0").select("container_id", "capacity_tokens").distinct().orderBy("container_id", "capacity_tokens").collect():
        part = pack(sizes, int(row[1])).withColumn("container_id", F.lit(row[0]).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else pack(sizes.limit(0), 1).withColumn("container_id", F.lit(None).cast("bigint"))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind of container: containers, tokens, the least number that could hold them, share of space used."""
    one = packed.groupBy("container_id", "capacity", "container_no").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    got = one.groupBy("container_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("items").alias("items"))
    return got.withColumn("least", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("share_used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))

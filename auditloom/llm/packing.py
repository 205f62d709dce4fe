"""Filling containers of fixed capacity by sum-of-squares packing.

Sizes are counted in tokens of a public tokenizer; its file is a parameter (the session
setting auditloom.tokenizer, else the installed vocabulary). A document larger than the
capacity is cut into full containers and a rest; every other document, and each rest,
goes whole where the sum of squared counts of open containers per gap becomes smallest:
into an open container, or into a new one. Ties go to an open container, then to the
one with the smallest gap left. Larger items come first, then smaller doc_ids.

Packing is sequential, so items are dealt by a hash into groups of about GROUP items,
which are packed on their own; a group's unfinished containers are its only loss.

Defined results: null and empty texts take no container; a document delivered twice
counts once; a null doc_id, a null capacity and one under 1 are ignored; windows of the
same window_id count once; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import checkpoint_dir, small_batches

GROUP = 50_000
WINDOWS = 1_000


def tokenizer_file(spark: SparkSession) -> str:
    named = spark.conf.get("auditloom.tokenizer", None)
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(4)
def _encoder(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A longer text is counted in pieces cut at line ends or spaces, where tokens end as well.
_PIECE = 1 << 16


def count_tokens(text: str, path: str) -> int:
    """Tokens of a text; a run without spaces of any length costs time in proportion to it."""
    encode = _encoder(path).encode_ordinary
    if len(text) <= _PIECE:
        return len(encode(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            while cut > at and text[cut - 1].isspace():
                cut -= 1
            end = cut if cut > at else end
        total += len(encode(text[at:end]))
        at = end
    return total


def sizes(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens) of the non-empty texts, once per document."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [count_tokens(t, path) for t in batch["text"]]})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND text != ''")
    return texts.mapInPandas(work, "doc_id long, tokens int").groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0")


def packed(items: list[int], capacity: int) -> list[int]:
    """The container of each item, in the order given: sum-of-squares packing. No item is larger than the capacity."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by gap
    out, used = [], 0
    for size in items:
        best, at = 2 * int(counts[capacity - size]) + 1 if size < capacity else 0, -1
        if size < capacity:
            change = 2 * (counts[: capacity - size] - counts[size:capacity]) + 2
            change[0] = 1 - 2 * counts[size]
            change[counts[size:capacity] == 0] = 1 << 40
            k = int(change.argmin())
            if change[k] <= best:
                at = size + k
        if at < 0:
            box, gap = used, capacity - size
            used += 1
        else:
            box, gap = open_[at].pop(), at - size
            counts[at] -= 1
        if gap:
            open_[gap].append(box)
            counts[gap] += 1
        out.append(box)
    return out


def containers(documents: DataFrame, windows: DataFrame, path: str | None = None, group: int = GROUP) -> DataFrame:
    """(window_id, container, doc_id, piece, tokens): where each document, or each piece of one that is too large, goes."""
    spark = documents.sparkSession
    sized = windows.groupBy("window_id").agg(F.max("capacity_tokens").cast("int").alias("capacity")).where("capacity >= 1 AND window_id IS NOT NULL").select(F.col("window_id").cast("int").alias("window_id"), "capacity")
    checkpoint_dir(spark)
    small_batches(spark)
    counted = sizes(documents, path or tokenizer_file(spark)).checkpoint()
    groups = max(1, -(-counted.count() // group))
    # every document goes into every window: the windows are literals, WINDOWS of them in one branch of the plan
    listed = [F.struct(F.lit(r["window_id"]).alias("window_id"), F.lit(r["capacity"]).alias("capacity")) for r in sized.toLocalIterator()]
    each = counted.select("doc_id", "tokens", F.inline(F.array(*listed[:WINDOWS]) if listed else F.array().cast("array<struct<window_id:int,capacity:int>>")))
    for n in range(WINDOWS, len(listed), WINDOWS):
        each = each.unionByName(counted.select("doc_id", "tokens", F.inline(F.array(*listed[n : n + WINDOWS]))))
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    full = each.where("tokens >= capacity").select(
        "window_id", "doc_id", F.explode(F.sequence(F.lit(1), whole)).alias("piece"), F.col("capacity").alias("tokens")
    ).select("window_id", F.format_string("document %d piece %d", "doc_id", "piece").alias("container"), "doc_id", "piece", "tokens")
    rest = each.select("window_id", "capacity", "doc_id", (whole + 1).alias("piece"), (F.col("tokens") % F.col("capacity")).cast("int").alias("tokens")).where("tokens > 0")
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        boxes = packed(frame["tokens"].tolist(), int(frame["capacity"].iloc[0]))
        bucket = int(frame["bucket"].iloc[0])
        return pd.DataFrame({"window_id": frame["window_id"], "container": pd.Series([f"group {bucket} container {b}" for b in boxes], index=frame.index, dtype=object), "doc_id": frame["doc_id"], "piece": frame["piece"], "tokens": frame["tokens"]})

    together = rest.groupBy("window_id", "bucket").applyInPandas(pack, "window_id int, container string, doc_id long, piece int, tokens int")
    return full.unionByName(together)


def usage(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, containers, tokens, unused): how well each window's containers are filled."""
    boxes = placed.groupBy("window_id", "container").agg(F.sum("tokens").alias("tokens")).groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    capacity = windows.groupBy("window_id").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    return boxes.join(capacity, "window_id").select("window_id", "containers", "tokens", (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"))

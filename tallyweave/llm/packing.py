"""Best-fit packing: hierarchical residual packing of documents into fixed-size training bins.

Items are documents measured in tokens. The default measure is the byte-level vocabulary
every model family has: one token per UTF-8 byte and one end-of-text token. A document
longer than CAPACITY is cut into full pieces and one remainder, so whole texts are packed.

Items go to groups of about GROUP_ITEMS by a hash of doc_id and text, so rows that share an id, or have none, spread. Every group packs best-fit,
largest first. Bins filled to at least FULL are final; the others go up as items of their
own, FAN_IN groups merge, and best-fit runs again, until one group is left. A merged group
holds only underfull bins. When underfull bins of a merged group still outnumber
GROUP_ITEMS, they are dealt to several groups again by size, so no task grows with the
corpus. What a round leaves is written to reliable checkpoints, so the text is read once.

Result: one row per bin: bin_id, the doc_ids in it with the start and length of each piece in
tokens (lists of equal length and order), n_tokens and fill.

Defined results: a null or empty text is an item of one token; a null doc_id is kept as an
item with a null id; repeated rows are items each; equal sizes are taken in order of doc_id
and start, so the result doesn't depend on the order of rows; an empty table gives no bins;
other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm._cut import cut

CAPACITY = 32768
FULL = 0.98
GROUP_ITEMS = 20_000
FAN_IN = 4

_BIN = "doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, n_tokens bigint"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit over sizes in the given order: lists of indices, one per bin."""
    bins: list[list[int]] = []
    room: list[int] = []  # distinct residuals, ascending
    by_room: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        k = bisect_left(room, size)
        if k == len(room):
            b, left = len(bins), capacity - size
            bins.append([i])
        else:
            r = room[k]
            stack = by_room[r]
            b = stack.pop()
            if not stack:
                del by_room[r]
                room.pop(k)
            bins[b].append(i)
            left = r - size
        if left > 0:
            if left in by_room:
                by_room[left].append(b)
            else:
                by_room[left] = [b]
                insort(room, left)
    return bins


def _pack_group(capacity: int, full: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (-r["n_tokens"], [x if x is not None else -(1 << 62) for x in r["doc_ids"]], r["starts"]))
        out = []
        for members in best_fit([r["n_tokens"] for r in rows], capacity):
            one = {"grp": rows[members[0]]["grp"], "n_tokens": sum(rows[m]["n_tokens"] for m in members)}
            for c in ("doc_ids", "starts", "lengths"):
                one[c] = [x for m in members for x in rows[m][c]]
            one["done"] = one["n_tokens"] >= full * capacity
            out.append(one)
        return pa.Table.from_pylist(out, schema=_OUT)

    return run


_OUT = pa.schema([("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("grp", pa.int64()), ("done", pa.bool_())])


def byte_tokens(column: str = "text"):
    """Tokens of a text at byte level, with the end-of-text token."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 1


def pieces(docs: DataFrame, capacity: int, tokens=None) -> DataFrame:
    """(doc_id, start, length, salt): every document in pieces of at most `capacity` tokens; salt is a hash of its text."""
    n = byte_tokens() if tokens is None else tokens
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.xxhash64("text").alias("salt"))
    return sized.select("doc_id", "n", "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity), F.lit(1).cast("long"))).alias("k")).select(
        "doc_id", (F.col("k") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("k") * capacity).alias("length"), "salt"
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, full: float = FULL, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN, tokens=None) -> DataFrame:
    """Bins of at most `capacity` tokens that hold every piece of every document once."""
    items = cut(pieces(docs, capacity, tokens))
    whole = F.col("length") >= full * capacity
    final = [items.where(whole).select(F.array("doc_id").alias("doc_ids"), F.array("start").alias("starts"), F.array("length").alias("lengths"), F.col("length").alias("n_tokens"))]
    rest = items.where(~whole)
    groups = max(1, math.ceil(rest.count() / group_items))
    level = rest.select(
        F.array("doc_id").alias("doc_ids"), F.array("start").alias("starts"), F.array("length").alias("lengths"), F.col("length").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "salt", "start"), F.lit(groups)).alias("grp"),
    )
    while True:
        packed = cut(level.groupBy("grp").applyInArrow(_pack_group(capacity, full), f"{_BIN}, grp bigint, done boolean"))
        if groups == 1:
            final.append(packed.drop("grp", "done"))
            break
        final.append(packed.where("done").drop("grp", "done"))
        open_bins = packed.where("NOT done").drop("done")
        left = open_bins.count()
        # merging stops to shrink when the open bins no longer combine; then they stay as they are
        fewer = max(1, math.ceil(groups / fan_in), math.ceil(left / group_items))
        if left == 0 or fewer >= groups:
            final.append(open_bins.drop("grp"))
            break
        level = open_bins.withColumn("grp", F.pmod(F.floor(F.col("grp") * fewer / groups), F.lit(fewer)).cast("long") if fewer == math.ceil(groups / fan_in) else F.pmod(F.xxhash64("doc_ids", "starts", "lengths"), F.lit(fewer)))
        groups = fewer
    out = final[0]
    for part in final[1:]:
        out = out.union(part)
    return out.select(
        F.xxhash64("doc_ids", "starts").alias("bin_id"), "doc_ids", "starts", "lengths", "n_tokens", (F.col("n_tokens") / capacity).alias("fill")
    )

"""Documents in blocks, and the exchange that tells each block which of its 64-bit keys others have too.

A block is some megabytes of documents in one row, zstd-compressed, written once to the shared folder, so that
every later pass sees the same blocks even if an executor is lost in between.  In a pass, a block sorts its distinct keys, cuts them by
hash range and sends one packed row per range (about six bytes a key, a key at most once per block however many rows hold it);
a range compares what it got from all blocks and answers each with one bit per key.  Ranges are sized by
the corpus and hold equal shares of the hash space.

Rows between blocks and ranges are blocks times ranges, which must not grow with the square of the corpus.  Beyond FAN ranges
the exchange therefore takes two hops: blocks send to the square root of the ranges; there, the packs of each BATCH of blocks are merged, so a
key counts once per batch, and go on to the ranges; the answers return the same way.  So packs stay above a kilobyte up to FAN ** 2
ranges (200 TB of text), and a key that every block has adds one entry per batch to its range.

Where 64 bits are not enough to know a key, keys() gives 24 more bits of another hash, the tag; keys are equal if both are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._packs import packs, rest, views
from tempora.llm._shared import NO_ID, discard, ship, stage

BLOCK_BYTES = 4 << 20
#: Keys per hash range, about.
RANGE_KEYS = 2_000_000
#: Ranges that blocks send to directly, and blocks whose packs are merged on the way beyond.
FAN, BATCH = 4096, 4096
#: Sorted keys, the value of each, and its tag.
Pack = tuple[np.ndarray, np.ndarray | None, np.ndarray | None]
BLOCK = "block bigint, size bigint, ids binary, starts binary, data binary"


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, most: int | None = None) -> DataFrame:
    """block, size, ids, starts, data: whole documents by ascending id in each block; null ids become NO_ID, null texts empty."""
    most = most or BLOCK_BYTES
    ship(docs.sparkSession)
    df = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            data, offsets = views(batch.column(1).take(pa.array(order)))
            for i, j, buf, starts in packs(data, offsets, most):
                yield pa.RecordBatch.from_pylist([{"block": number, "size": len(buf), "ids": ids[i:j].tobytes(), "starts": starts.tobytes(), "data": press.compress(buf)}])
                number += 1
            del batch, data, offsets, ids, order
            rest()

    return stage(df.mapInArrow(run, BLOCK), "blocks")


def unpack(ids: bytes, starts: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts, buffer of a block."""
    return np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def count_ranges(blocks: DataFrame, bytes_per_key: float) -> int:
    size = blocks.agg(F.sum("size")).first()[0] or 0
    return max(1, round(size / bytes_per_key / RANGE_KEYS))


def _hops(ranges: int) -> tuple[int, int]:
    """Ranges that blocks send to, and into how many each is divided by a second hop."""
    if ranges <= FAN:
        return ranges, 1
    first = math.isqrt(ranges - 1) + 1
    return first, -(-ranges // first)


def _cut(u: np.ndarray, ranges: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """First key of each range from first to last in sorted u, and the end."""
    r = ((u >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(r, np.arange(first, (ranges if last is None else last) + 1, dtype=np.uint64))


def _encode(u: np.ndarray, ids: np.ndarray | None, tag: np.ndarray | None = None) -> bytes:
    """Sorted keys as byte planes of their differences, then the tags' planes, then the values as places in a table."""
    d = u.copy()
    d[1:] -= u[:-1]
    d[0] = 0  # the first key goes to the head
    planes = d.view(np.uint8).reshape(-1, 8).T
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    out = [np.array([len(u), used], np.uint32).tobytes(), u[:1].tobytes(), np.ascontiguousarray(planes[:used]).tobytes()]
    if tag is not None:
        out.append(np.ascontiguousarray(tag.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]).tobytes())
    if ids is not None:
        table, at = np.unique(ids, return_inverse=True)
        kind = np.uint8 if len(table) <= 256 else np.uint16 if len(table) <= 65536 else np.uint32
        out += [np.uint32(len(table)).tobytes(), table.tobytes(), at.astype(kind).tobytes()]
    return b"".join(out)


def _decode(raw: bytes, with_ids: bool, with_tag: bool = False) -> Pack:
    n, used = np.frombuffer(raw, np.uint32, 2).tolist()
    d = np.zeros((n, 8), np.uint8)
    d[:, :used] = np.frombuffer(raw, np.uint8, n * used, 16).reshape(used, n).T
    d = d.reshape(-1).view(np.uint64)
    d[0] = np.frombuffer(raw, np.uint64, 1, 8)[0]
    u, at, tag, ids = np.cumsum(d, dtype=np.uint64), 16 + n * used, None, None
    if with_tag:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, :3] = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(3, n).T
        tag, at = wide.reshape(-1).view("<u4"), at + 3 * n
    if with_ids:
        m = int(np.frombuffer(raw, np.uint32, 1, at)[0])
        table = np.frombuffer(raw, np.int64, m, at + 4)
        kind = np.uint8 if m <= 256 else np.uint16 if m <= 65536 else np.uint32
        ids = table[np.frombuffer(raw, kind, n, at + 4 + 8 * m)]
    return u, ids, tag


def in_groups(u: np.ndarray, tag: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by key and tag, and whether each in that order is the first of its kind."""
    order = np.argsort(u, kind="stable")
    s = u[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if tag is not None:
        t = tag[order]
        if (~new[1:] & (t[1:] != t[:-1])).any():  # very rare
            order = np.lexsort((tag, u))
            s, t = u[order], tag[order]
            new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return order, new


def _laid_out(packs: list[Pack]) -> Pack:
    return tuple(None if packs[0][c] is None else np.concatenate([p[c] for p in packs]) for c in range(3))


def _merged(packs: list[Pack], earlier: bool) -> tuple[Pack, list[np.ndarray]]:
    """The distinct keys of sorted packs; of each the smallest id, or the sum of the counts (without any: the packs that have it); and the
    place of every pack's keys among them."""
    u, values, tag = _laid_out(packs)
    order, new = in_groups(u, tag)
    at = np.empty(len(u), np.int64)
    at[order] = np.cumsum(new) - 1
    kept, n = order[new], int(new.sum())
    if values is None:
        value = np.bincount(at, minlength=n)
    elif earlier:
        value = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(value, at, values)
    else:
        value = np.zeros(n, np.int64)
        np.add.at(value, at, values.astype(np.int64))
    return (u[kept], value, None if tag is None else tag[kept]), np.split(at, np.cumsum([len(p[0]) for p in packs])[:-1])


def answers(blocks: DataFrame, keys: Callable, ranges: int, earlier: bool = False, counts: bool = False, tagged: bool = False) -> DataFrame:
    """block, part, bits: for each block and range one bit per distinct key, in order; rows without a set bit are left out.

    keys(ids, starts, buffer) -> sorted distinct keys, and the smallest document id of each or its count in the block.  With
    `earlier` a bit says that some block has the key in a document of smaller id; with `counts` the answer is not bits but the sum
    of the counts as 32-bit numbers; else a bit says that some other block has the key.  If `tagged`, keys() gives the tags as well.
    """
    values = earlier or counts
    first, second = _hops(ranges)

    def send(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                u, ids, *tag = keys(*unpack(*(batch.column(c)[k].as_py() for c in (1, 2, 3))))
                cut = _cut(u, first)
                some = np.flatnonzero(np.diff(cut))
                block = batch.column(0)[k].as_py()
                for part in some.tolist():
                    a, b = cut[part], cut[part + 1]
                    yield pa.RecordBatch.from_pylist([{"block": block, "part": part, "raw": _encode(u[a:b], ids[a:b] if values else None, tag[0][a:b] if tagged else None)}])
                del u, ids, tag
                rest()

    def answered(table: pa.Table, out: list[np.ndarray], names: tuple[str, ...]) -> pa.Table:
        """The rows' answers, bits or counts, beside the named columns; without a set bit none."""
        if counts:
            return pa.table({c: table.column(c) for c in names} | {"bits": pa.array([x.astype(np.uint32).tobytes() for x in out], pa.binary())})
        some = [k for k, x in enumerate(out) if x.any()]
        return pa.table({c: table.column(c).take(pa.array(some, pa.int64())) for c in names} | {"bits": pa.array([np.packbits(out[k]).tobytes() for k in some], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        rest()
        got = [_decode(x.as_py(), values, tagged) for x in table.column("raw")]
        u, value, tag = _laid_out(got)
        order, new = in_groups(u, tag)
        start = np.flatnonzero(new)
        many = np.diff(np.append(start, len(u)))
        flags = np.zeros(len(u), np.uint32 if counts else bool)
        if counts:
            flags[order] = np.repeat(np.add.reduceat(value[order], start), many)
        elif earlier:
            ids = value[order]
            flags[order] = ids > np.repeat(np.minimum.reduceat(ids, start), many)
        else:
            flags[order] = np.repeat(many > 1, many)
        out = answered(table, np.split(flags, np.cumsum([len(p[0]) for p in got])[:-1]), ("block", "part"))
        del got, u, value, tag, order, new, start, many, flags
        rest()
        return out

    sent = blocks.select("block", "ids", "starts", "data").mapInArrow(send, "block bigint, part bigint, raw binary")
    if second == 1:
        return sent.groupBy("part").applyInArrow(compare, "block bigint, part bigint, bits binary")

    def merge(table: pa.Table) -> pa.Table:
        """One pack per range for a batch of blocks."""
        rest()
        (u, value, tag), _ = _merged([_decode(x.as_py(), values, tagged) for x in table.column("raw")], earlier)
        part, batch = table.column("part")[0].as_py(), table.column("batch")[0].as_py()
        cut = _cut(u, first * second, part * second, (part + 1) * second)
        some = np.flatnonzero(np.diff(cut)).tolist()
        return pa.table({"part": pa.array([part] * len(some), pa.int64()), "batch": pa.array([batch] * len(some), pa.int64()), "sub": pa.array(some, pa.int64()), "raw": pa.array([_encode(u[cut[k] : cut[k + 1]], value[cut[k] : cut[k + 1]], None if tag is None else tag[cut[k] : cut[k + 1]]) for k in some], pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        """For each batch, whether others have a smaller id or have the key at all; or the sums."""
        rest()
        got = [_decode(x.as_py(), True, tagged) for x in table.column("raw")]
        (_, value, _), places = _merged(got, earlier)
        out = [value[at] if counts else value[at] < own if earlier else value[at] > own for at, (_, own, _) in zip(places, got, strict=True)]
        return answered(table, out, ("part", "batch", "sub"))

    def spread(table: pa.Table) -> pa.Table:
        """The answers to a batch become those to its blocks."""
        rest()
        own, back = table.filter(pc.is_null(table.column("sub"))), table.filter(pc.is_valid(table.column("sub")))
        got = [_decode(x.as_py(), values, tagged) for x in own.column("raw")]
        (u, value, _), places = _merged(got, earlier)
        part = own.column("part")[0].as_py()
        cut = _cut(u, first * second, part * second, (part + 1) * second)
        total = np.zeros(len(u), np.int64 if counts else bool)
        for sub, raw in zip(back.column("sub").to_pylist(), back.column("raw").to_pylist(), strict=True):
            n = int(cut[sub + 1] - cut[sub])
            total[cut[sub] : cut[sub + 1]] = np.frombuffer(raw, np.uint32) if counts else np.unpackbits(np.frombuffer(raw, np.uint8), count=n)
        out = [total[at] if counts else total[at] | (ids > value[at] if earlier else value[at] > 1) for at, (_, ids, _) in zip(places, got, strict=True)]
        return answered(own, out, ("block", "part"))

    batches = max(1, -(-blocks.count() // BATCH))
    sent = stage(sent.withColumn("batch", F.pmod(F.xxhash64("block"), F.lit(batches))), "packs")
    merged = sent.groupBy("part", "batch").applyInArrow(merge, "part bigint, batch bigint, sub bigint, raw binary")
    settled = merged.groupBy("part", "sub").applyInArrow(settle, "part bigint, batch bigint, sub bigint, bits binary")
    none = F.lit(None).cast("bigint")
    both = sent.select("block", "part", "batch", none.alias("sub"), "raw").unionByName(settled.select(none.alias("block"), "part", "batch", "sub", F.col("bits").alias("raw")))
    out = stage(both.groupBy("part", "batch").applyInArrow(spread, "block bigint, part bigint, bits binary"), "spread")
    discard(sent)
    return out


def deliver(blocks: DataFrame, given: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f(block, ids, starts, buffer, {part: bits}) -> pa.Table for every block and what was given(block, part, bits) to it."""
    none = F.lit(None).cast("binary")
    rows = blocks.select("block", F.lit(-1).cast("bigint").alias("part"), "ids", "starts", "data").unionByName(given.select("block", "part", none.alias("ids"), none.alias("starts"), F.col("bits").alias("data")))

    def run(table: pa.Table) -> pa.Table:
        rest()
        parts = table.column("part").to_pylist()
        own = parts.index(-1)
        ids, starts, buf = unpack(*(table.column(c)[own].as_py() for c in ("ids", "starts", "data")))
        out = f(table.column("block")[own].as_py(), ids, starts, buf, {p: table.column("data")[k].as_py() for k, p in enumerate(parts) if p >= 0})
        del ids, starts, buf
        rest()  # a worker that waits for its next task holds nothing
        return out

    return rows.groupBy("block").applyInArrow(run, schema)


def with_answers(blocks: DataFrame, given: DataFrame, ranges: int, f: Callable, schema: str, counts: bool = False) -> DataFrame:
    """f(block, ids, starts, buffer, answer_to) -> pa.Table for every block; answer_to(sorted keys) -> a flag or count per key."""

    first = _hops(ranges)[0]

    def run(block, ids, starts, buf, bits):
        def answer_to(u: np.ndarray) -> np.ndarray:
            cut, out = _cut(u, first), np.zeros(len(u), np.uint32 if counts else bool)
            for p, raw in bits.items():
                n = int(cut[p + 1] - cut[p])
                out[cut[p] : cut[p + 1]] = np.frombuffer(raw, np.uint32) if counts else np.unpackbits(np.frombuffer(raw, np.uint8), count=n)
            return out

        return f(block, ids, starts, buf, answer_to)

    return deliver(blocks, given, run, schema)

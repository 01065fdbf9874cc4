"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

The suffix array is sparse.  Every window of WIDTH bytes has an anchor, the leftmost of its GRAM-byte grams of least hash, which
depends on the window's bytes alone: equal windows have anchors at equal places.  Only suffixes that begin at anchors are sorted, about
one byte in 35, and an anchor stands for a run of neighbouring windows (at most WIDTH - GRAM + 1) with the bytes before and after it.

1. By one packed exchange every block learns which of its anchor grams occur elsewhere; the rest cannot start a match.
2. For those, sampled splitters range-partition the suffixes by their leading bytes.  A splitter is a gram, so that the suffixes of a gram stay
   together; where a gram fills more than one range, its splitters go on for all WIDTH bytes, and where one such string does, its suffixes
   are dealt over those ranges by block.  Equal stretches of one block travel once.
3. Each range sorts its suffixes by multikey quicksort and takes the common prefix of neighbours; it sorts the bytes before the anchors,
   read backwards, likewise.  Windows that reach l bytes before their anchors are equal if and only if their suffixes agree in WIDTH - l
   bytes and what is before them in l: both are runs of neighbours in the sorted orders.  So equal windows are found without
   hashing, and the earliest (doc_id, start) of each stays.
4. Across a boundary, only suffixes that agree with the splitter in WIDTH - l bytes can have equal windows on the other side.  Of these windows
   each range hands on its earliest one, one row per distinct window, and one aggregate over the 100 bytes settles them.
5. The answers, one bit per window, go back to the blocks, which merge covered bytes into maximal runs.

Equality rests on bytes; only inside a block are equal stretches recognised by a 64-bit hash (a wrong pair in about 1e9 blocks of 4 MB).
At most MAX_RANGES splitters are kept on the driver; beyond, a range is divided by a hash of the gram as well.

Defined cases: null text is empty; texts below WIDTH bytes are kept; rows of equal doc_id count as one document (windows at
the same start in both are not earlier than each other); a null doc_id is smaller than any other; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import _text
from tempora.llm._exchange import answers, count_ranges, deliver, pack_blocks, with_answers
from tempora.llm._packs import rest
from tempora.llm._shared import NO_ID, discard, release, stage

WIDTH, GRAM = 100, 32
REACH = WIDTH - GRAM  # bytes of a window before its anchor, at most
ROW = REACH + WIDTH  # bytes kept around an anchor
#: Keys sampled for each range, and from one block at most (about).
OVERSAMPLE, SAMPLE_KEYS = 32, 2048
#: Bytes of text for each suffix range, about, and ranges at most.
RANGE_BYTES, MAX_RANGES = 4 << 20, 1 << 14
#: Suffixes that are sorted by all digits at once.
SMALL = 256
#: The number under which answers from across the boundaries come to a block.
_ACROSS = 1 << 40
_SEGMENT = 1 << 19


def anchors(starts: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor position and gram hash of every run of windows with one anchor."""
    border = np.zeros(len(buf) + 1, np.int8)
    size = np.diff(starts) - 1
    some = size >= WIDTH
    border[starts[:-1][some]] += 1
    border[starts[:-1][some] + size[some] - WIDTH + 1] -= 1
    valid = np.cumsum(border[:-1], dtype=np.int8) > 0
    out = []
    for s in range(0, max(0, len(buf) - WIDTH + 1), _SEGMENT):
        e = min(len(buf) - WIDTH + 1, s + _SEGMENT)
        at = np.flatnonzero(valid[s:e])
        if not len(at):
            continue
        seg = buf[s : e + WIDTH - 1]
        up, down = _text.powers(len(seg))
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_text._BYTE[seg] * up[: len(seg)], out=sums[1:])
        h = _text.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(seg) - GRAM + 1])
        low = (h & np.uint64(2**64 - 2**24)) | np.arange(len(h), dtype=np.uint64)
        for k in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-k], low[k:])
        low = np.minimum(low[: e - s], low[REACH + 1 - 64 : REACH + 1 - 64 + e - s])
        a = (low[at] & np.uint64(2**24 - 1)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(a) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        out.append((at[first] + s, at[last] + s, a[first] + s, h[a[first]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes of anchors, which are the least of many and so small, over the whole range of 64 bits."""
    return _text.mix(h + np.uint64(1))


def _twins(ids, starts, buf, lo, hi, p) -> tuple[np.ndarray, np.ndarray]:
    """The representative of every run (an equal run of least (doc_id, start) in the block), and whether the run comes after it."""
    doc = np.searchsorted(starts, lo, "right") - 1
    key = _text.mix(_text.run_hashes(buf, lo, hi + WIDTH) + (p - lo).astype(np.uint64))
    order = np.lexsort((lo - starts[doc], ids[doc], key))
    new = np.ones(len(lo), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rep = np.empty(len(lo), np.int64)
    rep[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(lo) else order
    later = (ids[doc] > ids[doc[rep]]) | ((ids[doc] == ids[doc[rep]]) & (lo - starts[doc] > lo[rep] - starts[doc[rep]]))
    return rep, later


def multikey_sort(digits: np.ndarray) -> np.ndarray:
    """Order of rows by their columns, by multikey quicksort: a part is split in three by one column at a pivot, and what equals the pivot
    goes on with the next column."""
    order, todo = np.arange(len(digits)), [(0, len(digits), 0)]
    while todo:
        a, b, c = todo.pop()
        if b - a < 2 or c == digits.shape[1]:
            continue
        rows = order[a:b]
        if b - a <= SMALL:
            order[a:b] = rows[np.lexsort(digits[rows, c:].T[::-1])]
            continue
        v = digits[rows, c]
        some = np.sort(v[:: max(1, (b - a) // 63)])
        pivot = some[len(some) // 2]
        low, same = v < pivot, v == pivot
        i = a + int(np.count_nonzero(low))
        j = i + int(np.count_nonzero(same))
        order[a:b] = np.concatenate([rows[low], rows[same], rows[~(low | same)]])
        todo += [(a, i, c), (i, j, c + 1), (j, b, c)]
    return order


def suffix_order(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte table, and the common prefix of each with the one before it (the first: -1)."""
    n, size = texts.shape
    wide = np.zeros((n, -(-size // 8) * 8), np.uint8)
    wide[:, :size] = texts
    order = multikey_sort(wide.view(">u8").astype(np.uint64))
    common = np.full(n, -1, np.int64)
    for a in range(1, n, 1 << 16):
        own = texts[order[a - 1 : a + (1 << 16)]]
        common[a : a + (1 << 16)] = _common(own[1:], own[:-1])
    return order, common


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _suffixes(buf: np.ndarray, p: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The WIDTH bytes from each anchor, as far as its windows reach; zeros beyond."""
    at = np.arange(WIDTH)
    out = buf[np.minimum(p[:, None] + at, len(buf) - 1)] if len(p) else np.zeros((0, WIDTH), np.uint8)
    out[at >= (hi - p + WIDTH)[:, None]] = 0
    return np.ascontiguousarray(out)


def _parts(keys: np.ndarray, grams: np.ndarray, block: int, splitters: np.ndarray, slices: int) -> np.ndarray:
    """Number of the range of each suffix; what equals several splitters is dealt over their ranges by block."""
    k = keys.view(f"S{WIDTH}").ravel()
    low, high = np.searchsorted(splitters, k, "left"), np.searchsorted(splitters, k, "right")
    turn = int(_text.mix(np.array([block], np.uint64))[0] >> np.uint64(1))
    to = np.where(high > low, low + 1 + turn % np.maximum(1, high - low), high)
    return to * slices + (_text.mix(grams) % np.uint64(slices)).astype(np.int64)


def _records(block, ids, starts, buf, lo, hi, p, h, pick, splitters: np.ndarray, slices: int) -> pa.Table:
    """One packed row per suffix range with the picked runs of a block."""
    to = _parts(_suffixes(buf, p[pick], hi[pick]), h[pick], block, splitters, slices)
    order = np.argsort(to, kind="stable")
    pick, to = pick[order], to[order]
    cut = np.flatnonzero(np.diff(to, prepend=-1))
    press = zstandard.ZstdCompressor(level=3)
    rows = {"block": [], "part": [], "raw": []}
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(pick)][: len(cut)], strict=True):
        own = pick[a:b]
        doc = np.searchsorted(starts, lo[own], "right") - 1
        body = np.concatenate([buf[i:j] for i, j in zip(lo[own].tolist(), (hi[own] + WIDTH).tolist(), strict=True)])
        head = [np.int64(len(own)).tobytes(), (p - lo)[own].astype(np.uint8).tobytes(), (hi - lo)[own].astype(np.uint8).tobytes(), own.astype(np.uint32).tobytes(), ids[doc].tobytes(), (lo[own] - starts[doc]).tobytes()]
        rows["block"].append(block)
        rows["part"].append(int(to[a]))
        rows["raw"].append(press.compress(b"".join(head) + body.tobytes()))
    return pa.table(rows, pa.schema([("block", pa.int64()), ("part", pa.int64()), ("raw", pa.binary())]))


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    """left, windows - 1, index, id, start, and the bytes around each anchor in a row with the anchor at REACH."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    left, more = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64), np.frombuffer(raw, np.uint8, n, 8 + n).astype(np.int64)
    index = np.frombuffer(raw, np.uint32, n, 8 + 2 * n)
    ids, start = np.frombuffer(raw, np.int64, n, 8 + 6 * n), np.frombuffer(raw, np.int64, n, 8 + 14 * n)
    body, size = np.frombuffer(raw, np.uint8, -1, 8 + 22 * n), more + WIDTH
    rows = np.zeros((n, ROW), np.uint8)
    ends = np.cumsum(size)
    row = np.repeat(np.arange(n), size)
    rows[row, np.arange(len(body)) - np.repeat(ends - size, size) + np.repeat(REACH - left, size)] = body
    return left, more, index, ids, start, rows


def _repeats(left, more, ids, start, rows, below: bytes | None = None, above: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each record one flag per window: an equal window with smaller (doc_id, start) is among the records.

    Further the records and offsets of the windows that are the earliest here but may have equals across the boundaries; below and above
    are the splitters there (below only if suffixes that agree with it in a gram may lie before it).
    """
    n, flags = len(left), np.zeros((len(left), 72), bool)
    order, common = suffix_order(rows[:, REACH:])
    cross = np.zeros(n, np.int64)
    for key in (below, above):
        if key is not None:
            cross = np.maximum(cross, _common(rows[:, REACH:], np.frombuffer(key.ljust(WIDTH, b"\0"), np.uint8)[None, :]))
    near = common >= GRAM
    some = near | (cross[order] >= GRAM)
    some[:-1] |= near[1:]  # the rest share their gram with nobody; leaving them out joins no run, as the least common prefix is kept
    kept = np.flatnonzero(some)
    own = order[kept]
    common = np.minimum.reduceat(common[: kept[-1] + 1], np.append(0, kept[:-1] + 1)) if len(kept) else common[:0]
    back, before = suffix_order(rows[own, REACH - 1 :: -1])
    _, rank = np.unique(ids, return_inverse=True)
    left, more, cross = left[own], more[own], cross[own]
    when = (rank[own].astype(np.int64) << 40) + start[own] + left
    place, m = np.arange(len(own)), len(own)
    behind = np.empty(m, np.int64)
    across_r, across_o = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for reach in range(REACH + 1):
        some = np.flatnonzero((left >= reach) & (left - more <= reach))  # those that have this window
        if not len(some):
            continue
        ahead = np.maximum.accumulate(np.where(common < WIDTH - reach, place, 0))  # first of the run that agrees in so many bytes
        behind[back] = np.maximum.accumulate(np.where(before < reach, place, 0))
        key = ahead[some] * m + behind[some]
        o = np.argsort(key)
        s = key[o]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        at = when[some] - reach
        least = np.empty(len(some), np.int64)
        least[o] = np.repeat(np.minimum.reduceat(at[o], first), np.diff(np.append(first, len(o))))
        again = some[at > least]
        flags[own[again], left[again] - reach] = True
        open_ = some[(at == least) & (cross[some] >= WIDTH - reach)]
        across_r.append(own[open_])
        across_o.append(left[open_] - reach)
    return flags, np.concatenate(across_r), np.concatenate(across_o)


def _some_blocks(blocks: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """Blocks for so many sampled keys, from files spread over the table (only these are read), and the keys to take of each."""
    spark, want = blocks.sparkSession, max(64, -(-keys // SAMPLE_KEYS))
    files = sorted(blocks.inputFiles())
    files = [files[k] for k in sorted({i * len(files) // want for i in range(want)})] if files else []
    if not files:
        return blocks, 1
    some = spark.read.schema(blocks.schema).parquet(*files)
    n = some.count()
    return some if n <= want else some.where(F.pmod(F.xxhash64("block"), F.lit(n)) < want), -(-keys // max(1, min(n, want)))


def _splitters(keys: list[bytes], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of sampled suffixes: whole grams, and all bytes from the second quantile of a gram on, which may repeat; and whether each is
    of the second kind."""
    keys = sorted(keys)
    out: list[bytes] = []
    deep: list[bool] = []
    for k in range(1, ranges):
        if keys:
            key = keys[k * len(keys) // ranges]
            deep.append(bool(out) and out[-1][:GRAM] == key[:GRAM])
            out.append(key if deep[-1] else key[:GRAM])
    return np.array(out, f"S{WIDTH}"), np.array(deep, bool)


def remove_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (binary), starts and ends of the maximal removed runs in bytes."""
    blocks = pack_blocks(docs, id_col, text_col)
    ranges = count_ranges(blocks, 35)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    wanted = max(1, round(size / RANGE_BYTES))
    parts = min(wanted, MAX_RANGES)
    slices = -(-wanted // parts)

    def keys(ids, starts, buf):
        return np.unique(_spread(anchors(starts, buf)[3])), None

    def picked(ids, starts, buf, answer_to):
        lo, hi, p, h = anchors(starts, buf)
        u, rank, count = np.unique(_spread(h), return_inverse=True, return_counts=True)
        rep, _ = _twins(ids, starts, buf, lo, hi, p)
        return lo, hi, p, h, np.flatnonzero((answer_to(u) | (count > 1))[rank] & (rep == np.arange(len(rep))))

    def sampled(block, ids, starts, buf, answer_to):
        _, hi, p, _, pick = picked(ids, starts, buf, answer_to)
        pick = pick[np.linspace(0, len(pick) - 1, min(len(pick), per)).astype(np.int64)] if len(pick) else pick
        return pa.table({"k": pa.array([x.tobytes() for x in _suffixes(buf, p[pick], hi[pick])], pa.binary())})

    given = stage(answers(blocks, keys, ranges), "answers")
    release(docs.sparkSession)
    splitters, deep = np.zeros(0, f"S{WIDTH}"), np.zeros(0, bool)
    if parts > 1:
        some, per = _some_blocks(blocks, OVERSAMPLE * parts)
        own = given.join(some.select("block"), "block", "left_semi")
        got = with_answers(some, own, ranges, sampled, "k binary")
        splitters, deep = _splitters([bytes(k) for k in got.toArrow().column("k").to_pylist()], parts)

    def send(block, ids, starts, buf, answer_to):
        lo, hi, p, h, pick = picked(ids, starts, buf, answer_to)
        return _records(block, ids, starts, buf, lo, hi, p, h, pick, splitters, slices)

    def compare(table: pa.Table) -> pa.Table:
        rest()
        got = [_unpack(x.as_py()) for x in table.column("raw")]
        left, more, index, ids, start, rows = (np.concatenate([g[c] for g in got]) for c in range(6))
        part = table.column("part")[0].as_py() // slices
        below = splitters[part - 1] if part and deep[part - 1] else None
        flags, at, off = _repeats(left, more, ids, start, rows, below, splitters[part] if part < len(splitters) else None)
        out = {c: [] for c in ("block", "part", "bits", "window", "id", "start", "index", "off")}
        ends = np.cumsum([len(g[0]) for g in got])
        for k, (g, e) in enumerate(zip(got, ends.tolist(), strict=True)):
            own = flags[e - len(g[0]) : e]
            some = np.flatnonzero(own.any(axis=1))
            if len(some):
                for c, x in (("block", table.column("block")[k].as_py()), ("part", table.column("part")[k].as_py()), ("bits", g[2][some].tobytes() + np.packbits(own[some], axis=1).tobytes())):
                    out[c].append(x)
        none = [None] * len(out["block"])
        block = table.column("block").to_numpy()[np.searchsorted(ends, at, "right")] if len(at) else at
        col = REACH - left[at] + off
        windows = [rows[r, c : c + WIDTH].tobytes() for r, c in zip(at.tolist(), col.tolist(), strict=True)]
        for c, x in (("window", windows), ("id", ids[at]), ("start", start[at] + off), ("index", index[at].astype(np.int64)), ("off", off)):
            out[c] = none + list(x)
        for c, x in (("block", list(block)), ("part", [_ACROSS] * len(at)), ("bits", [None] * len(at))):
            out[c] += x
        return pa.table(out, pa.schema([("block", pa.int64()), ("part", pa.int64()), ("bits", pa.binary()), ("window", pa.binary()), ("id", pa.int64()), ("start", pa.int64()), ("index", pa.int64()), ("off", pa.int64())]))

    def bits_of(table: pa.Table) -> pa.Table:
        index, off = table.column("index").to_numpy(), table.column("off").to_numpy()
        u, at = np.unique(index, return_inverse=True)
        own = np.zeros((len(u), 72), bool)
        own[at, off] = True
        return pa.table({"block": [table.column("block")[0].as_py()], "part": [_ACROSS], "bits": [u.astype(np.uint32).tobytes() + np.packbits(own, axis=1).tobytes()]})

    def cut_out(block, ids, starts, buf, bits):
        lo, hi, p, _ = anchors(starts, buf)
        rep, later = _twins(ids, starts, buf, lo, hi, p)
        flags = np.zeros((len(lo), 72), bool)
        for raw in bits.values():
            n = len(raw) // 13
            flags[np.frombuffer(raw, np.uint32, n)] |= np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 * n).reshape(n, 9), axis=1).astype(bool)
        flags = flags[rep]
        m = hi - lo + 1
        k = np.repeat(np.arange(len(lo)), m)
        off = np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)
        hit = (lo[k] + off)[later[k] | flags[k, off]]
        depth = np.zeros(len(buf) + 1, np.int32)
        depth[hit] += 1
        np.subtract.at(depth, hit + WIDTH, 1)
        gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
        a, b = _text.runs(gone.astype(np.uint8), np.arange(256) == 1)  # a document's last byte is the space after it: runs end there
        stay = ~gone
        stay[starts[1:] - 1] = False
        kept = buf[stay]
        edge = np.concatenate([[0], np.cumsum(stay)])[starts].astype(np.int32)
        total = np.concatenate([[0], np.cumsum(gone)])
        owner = np.searchsorted(starts, a, "right") - 1
        lists = pa.array(np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32))
        return pa.table({
            "doc_id": ids, "n_bytes": np.diff(starts) - 1, "n_removed": total[starts[1:]] - total[starts[:-1]],
            "kept": pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(kept.tobytes())]),
            "starts": pa.ListArray.from_arrays(lists, pa.array(a - starts[owner], pa.int64())), "ends": pa.ListArray.from_arrays(lists, pa.array(b - starts[owner], pa.int64())),
        })

    found = with_answers(blocks, given, ranges, send, "block bigint, part bigint, raw binary")
    found = stage(found.groupBy("part").applyInArrow(compare, "block bigint, part bigint, bits binary, window binary, id bigint, start bigint, index bigint, off bigint"), "repeats")
    discard(given)
    release(docs.sparkSession)
    inside = found.where("window is null").select("block", "part", "bits")
    open_ = found.where("window is not null").select("window", F.struct("id", "start").alias("at"), "block", "index", "off")
    least = open_.groupBy("window").agg(F.min("at").alias("least"))
    later = open_.join(least, "window").where("at > least").select("block", "index", "off")
    found = inside.unionByName(later.groupBy("block").applyInArrow(bits_of, "block bigint, part bigint, bits binary"))
    out = deliver(blocks, found, cut_out, "doc_id bigint, n_bytes bigint, n_removed bigint, kept binary, starts array<bigint>, ends array<bigint>")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

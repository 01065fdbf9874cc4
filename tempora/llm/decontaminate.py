"""Benchmark decontamination: which words of each document lie inside a window of a benchmark item.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z were lower-cased.  A window is `width` consecutive words of one item, or the
whole item if it has fewer (but any).  The set join, in Spark:

1. The distinct windows of all items become a table, and their shingles of SHINGLE words (a shorter window is one shingle) another.
2. The documents' shingles that a fixed-size bit table lets pass are counted, and joined to the windows' shingles.  So these have an order of
   rarity over all documents.  Exact containment needs a prefix of one: every window is filed under its rarest shingle; a window with a
   shingle that no document has cannot occur and is left out, usually nearly all of them.
3. What is left goes to the executors in blocks of at most BLOCK_ROWS windows and (window, item) rows.  A document looks up its shingles,
   which gives candidates with a position (the shingle's place in the window) and a length that has to fit into the document; all words
   of each are then compared (by 64-bit hash, each).  Documents pass once to be counted and once per block, and are never shuffled.

Defined cases: null text has no words; an item without words has no window; equal items with several ids count as
several; a null item_id reads "null"; an empty benchmark hits nothing; equal rows get equal results; an empty table gives no rows; a column of
the name of an added one is kept with _input at its end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import _text
from tempora.llm._packs import append, packs, rest, views
from tempora.llm._shared import beside, discard, plain, ship, stage

WIDTH, SHINGLE = 10, 3
#: Windows, and rows of window and item, that are sent to the executors at once (about 130 bytes each).
BLOCK_ROWS = 200_000
#: Bits for each benchmark shingle in the table that documents' shingles have to pass, and bits of the table at most (16 MB), as a power of 2.
FILTER_SHARE, FILTER_BITS = 16, 27
#: Distinct shingles that a task counts before it hands them on.
COUNTED = 1 << 20
FIELDS = "n_words bigint, n_hit bigint, items array<string>, hit_starts array<bigint>, hit_ends array<bigint>"


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = _text.lower(buf)
    starts, ends = _text.runs(buf, _text.ALNUM)
    return starts, _text.run_hashes(buf, starts, ends)


class _Vocabulary:
    """Membership of 64-bit hashes in a sorted set, most strangers dismissed by one table look-up."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[keys >> np.uint64(46)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in words, and of these words in keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[words >> np.uint64(46)])
        k = np.searchsorted(self.keys, words[at])
        k[k == len(self.keys)] = 0
        good = self.keys[k] == words[at]
        return at[good], k[good]


def _tokens(words: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all shingles of k words that lie in one text; cut has the texts' first words."""
    h = _text.mix(_text.gram_hashes(words, k) + np.uint64(k))
    inside = np.ones(len(words), bool)
    for j in range(1, k):
        at = cut[1:] - j
        inside[at[at >= 0]] = False
    at = np.flatnonzero(inside[: len(h)])
    return at, h[at]


def _item_windows(benchmark: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """words (hashes laid end to end), size, item: the distinct windows of every item; staged."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for i, _, buf, starts in packs(*views(batch.column(1))):
                at, words = _words(buf)
                cut = _text.spans(starts, at)
                for d in range(len(starts) - 1):
                    own, item = words[cut[d] : cut[d + 1]], batch.column(0)[i + d].as_py()
                    size = min(width, len(own))
                    raw = own.tobytes()
                    for s in range(0, len(own) - size + 1 if size else 0, 1 << 16):
                        got = {raw[8 * t : 8 * (t + size)] for t in range(s, min(s + (1 << 16), len(own) - size + 1))}
                        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array([size] * len(got), pa.int32()), pa.array([item] * len(got))], names=["words", "size", "item"])

    return stage(items.mapInArrow(run, "words binary, size int, item string").distinct(), "item-windows")


def _shingles(windows: DataFrame) -> DataFrame:
    """w, token, place: all shingles of every window."""

    def run(batches):
        for batch in batches:
            w, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            words, cut = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64), np.concatenate([[0], np.cumsum(size)])
            for k in range(1, SHINGLE + 1):
                at, token = _tokens(words, cut, k)
                row = np.searchsorted(cut, at, "right") - 1
                good = np.minimum(size[row], SHINGLE) == k
                row, at, token = row[good], at[good], token[good]
                yield pa.RecordBatch.from_arrays([pa.array(w[row]), pa.array(token.view(np.int64)), pa.array((at - cut[row]).astype(np.int32))], names=["w", "token", "place"])

    return windows.select("w", "words", "size").mapInArrow(run, "w bigint, token bigint, place int")


def _bits(tokens: DataFrame) -> np.ndarray:
    """A bit table of the tokens' upper bits, whose length is a power of 2 bounded by FILTER_BITS; made by the executors."""
    n = tokens.select(F.approx_count_distinct("token")).first()[0]
    bits = min(FILTER_BITS, max(16, int(FILTER_SHARE * n).bit_length()))
    at = F.shiftrightunsigned("token", 64 - bits)
    rows = tokens.select(F.shiftright(at, 6).alias("i"), at.bitwiseAND(F.lit(63)).cast("int").alias("k")).groupBy("i").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("b"))
    got, table = rows.toArrow(), np.zeros(1 << (bits - 6), np.int64)  # at most 2 million rows
    table[got.column("i").to_numpy()] = got.column("b").to_numpy()
    return table.view(np.uint64)


def _counts(docs: DataFrame, text_col: str, table: np.ndarray, widths: list[int]) -> DataFrame:
    """token, n: how often the shingles that pass the table occur in all documents."""
    spark = docs.sparkSession
    sent, shift = spark.sparkContext.broadcast(table), np.uint64(64 - 6 - (len(table).bit_length() - 1))

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        u, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return u, np.bincount(at, np.concatenate([n for _, n in held]), len(u)).astype(np.int64)

    def rows(held):
        u, n = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["token", "n"])

    def run(batches):
        held, size, bits = [], 0, sent.value
        for batch in batches:
            for _, _, buf, starts in packs(*views(batch.column(0))):
                at, words = _words(buf)
                cut = _text.spans(starts, at)
                for k in widths:
                    h = _tokens(words, cut, k)[1]
                    place = h >> shift
                    h = h[(bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                    if len(h):
                        held.append(np.unique(h, return_counts=True))
                        size += len(held[-1][0])
                if size > COUNTED:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > COUNTED // 2:
                        yield rows(held)
                        held, size = [], 0
            rest()
        if held:
            yield rows(held)

    return docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _filed(docs: DataFrame, text_col: str, benchmark: DataFrame, item_id: str, item_text: str, width: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Staged: w, words, size, token, place of the windows that may occur, under their rarest shingle; w, item; and the shingles' widths."""
    found = _item_windows(benchmark, item_id, item_text, width)
    windows = stage(found.select("words", "size").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    tokens = stage(_shingles(windows), "shingles")
    widths = sorted(min(SHINGLE, r[0]) for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())
    if widths:
        counts = _counts(docs, text_col, _bits(tokens), widths)
    else:
        counts = docs.sparkSession.createDataFrame([], "token bigint, n bigint")
    counted = tokens.select("token").distinct().join(counts, "token")
    prefix = tokens.join(counted, "token", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("p"))
    filed = stage(prefix.where("p.n > 0").join(windows, "w").select("w", "words", "size", "p.token", "p.place"), "filed")
    members = stage(found.join(filed.select("w", "words", "size"), ["words", "size"]).select("w", "item"), "members")
    discard(found, windows, tokens)
    return filed, members, widths


class Index:
    """Windows under their rarest shingles, and the items of each."""

    def __init__(self, windows: pa.Table, members: pa.Table, width: int, widths: list[int]):
        n = windows.num_rows
        token = windows.column("token").to_numpy().view(np.uint64) if n else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        self.size, self.place = (windows.column(c).to_numpy()[order].astype(np.int64) if n else np.zeros(0, np.int64) for c in ("size", "place"))
        self.words = np.zeros((n, width), np.uint64)
        raw = windows.column("words").to_pylist()
        for k, i in enumerate(order.tolist()):
            self.words[k, : self.size[k]] = np.frombuffer(raw[i], np.uint64)
        keys, first = np.unique(token[order], return_index=True)
        self.first, self.vocabulary, self.widths = np.append(first, n), _Vocabulary(keys), widths
        w = windows.column("w").to_numpy()[order] if n else np.zeros(0, np.int64)
        by = np.argsort(w)
        owner = by[np.searchsorted(w[by], members.column("w").to_numpy())] if members.num_rows else np.zeros(0, np.int64)
        item = members.column("item").combine_chunks().dictionary_encode() if members.num_rows else pa.array([], pa.string()).dictionary_encode()
        if isinstance(item, pa.ChunkedArray):
            item = item.combine_chunks()
        self.ids = item.dictionary.to_pylist()
        o = np.argsort(owner, kind="stable")
        self.owners = np.asarray(item.indices)[o].astype(np.int64)
        self.owner_at = np.searchsorted(owner[o], np.arange(n + 1))

    def match(self, words: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in words and window of every occurrence; cut has the documents' first words."""
        out_s, out_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in self.widths:
            place, tokens = _tokens(words, cut, width)
            at, key = self.vocabulary.find(tokens)
            at = place[at]
            many = self.first[key + 1] - self.first[key]
            ends = np.cumsum(many)
            i = 0
            while i < len(at):  # candidates in slices of bounded size
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 2_000_000, "right")))
                m = many[i:j]
                win = np.repeat(self.first[key[i:j]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                pos = np.repeat(at[i:j], m)
                doc = np.searchsorted(cut, pos, "right") - 1
                start = pos - self.place[win]
                good = (np.minimum(self.size[win], SHINGLE) == width) & (start >= cut[doc]) & (start + self.size[win] <= cut[doc + 1])
                start, win = start[good], win[good]
                for k in range(self.words.shape[1]):
                    past = k >= self.size[win]
                    good = past | (words[np.minimum(start + k, len(words) - 1)] == self.words[win, k])
                    start, win = start[good], win[good]
                out_s.append(start)
                out_w.append(win)
                i = j
        return np.concatenate(out_s), np.concatenate(out_w)


def _lists(owner: np.ndarray, n: int, *values: pa.Array) -> list[pa.Array]:
    """List columns of n rows from values whose owners ascend."""
    at = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(at, v) for v in values]


def _finder(index: Index, first: bool):
    def f(buf, starts, rows):
        n = len(starts) - 1
        at, words = _words(buf)
        cut = _text.spans(starts, at)
        start, win = index.match(words, cut)
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + index.size[win], -1)
        doc = np.searchsorted(cut, start, "right") - 1
        m = index.owner_at[win + 1] - index.owner_at[win]
        own = index.owners[np.repeat(index.owner_at[win], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        pairs = np.unique(np.repeat(doc, m) * len(index.ids) + own) if len(own) else np.zeros(0, np.int64)
        found = {}
        for p in pairs.tolist():
            found.setdefault(p // len(index.ids), []).append(index.ids[p % len(index.ids)])
        if not first:
            for k, (items, s, e) in enumerate(zip(*(rows[f"old_{c}"].to_pylist() for c in ("items", "hit_starts", "hit_ends")), strict=True)):
                if s:
                    found[k] = found.get(k, []) + items
                    np.add.at(depth, np.array(s) + cut[k], 1)
                    np.add.at(depth, np.array(e) + cut[k], -1)
        hit = np.cumsum(depth[:-1]) > 0
        edge = np.zeros(len(words) + 1, bool)  # runs end at documents' borders as well
        edge[cut] = True
        inner = hit[1:] & hit[:-1] & ~edge[1:-1] if len(hit) else hit
        s = np.flatnonzero(hit & ~np.concatenate([[False], inner])[: len(hit)])
        e = np.flatnonzero(hit & ~np.concatenate([inner, [False]])[: len(hit)]) + 1
        total = np.concatenate([[0], np.cumsum(hit)])
        owner = np.searchsorted(cut, s, "right") - 1
        docs = sorted(found)
        flat = [x for d in docs for x in sorted(set(found[d]))]
        who = np.repeat(np.array(docs, np.int64), [len(set(found[d])) for d in docs]) if docs else np.zeros(0, np.int64)
        items = _lists(who, n, pa.array(flat, pa.string()))[0]
        return [np.diff(cut), total[cut[1:]] - total[cut[:-1]], items, *_lists(owner, n, pa.array(s - cut[owner], pa.int64()), pa.array(e - cut[owner], pa.int64()))]

    return f


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col="text", item_id="item_id", item_text="text", width=WIDTH, drop_text=False) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids as strings), hit_starts and hit_ends (word positions, merged)."""
    spark = docs.sparkSession
    ship(spark)
    filed, members, widths = _filed(docs, text_col, benchmark, item_id, item_text, width)
    blocks = max(1, -(-max(filed.count(), members.count()) // BLOCK_ROWS))
    members = members.withColumn("block", F.pmod(F.xxhash64("w", "item"), F.lit(blocks)))
    names, out, text, added = list(docs.columns), plain(docs), f"c{docs.columns.index(text_col)}", [f.split()[0] for f in FIELDS.split(", ")]
    old = {c: f"old_{c}" for c in ("items", "hit_starts", "hit_ends")}
    for b in range(blocks):  # an item's share of a window that many items have may lie in several blocks
        own = members.where(F.col("block") == b).select("w", "item")
        windows = filed.join(own.select("w").distinct(), "w", "left_semi")
        sent = spark.sparkContext.broadcast(Index(windows.toArrow(), own.toArrow(), width, widths))
        if b:
            out = stage(out, "leaks").withColumnsRenamed(old).drop("n_words", "n_hit")
        out = append(out, text, FIELDS, lambda sent=sent, b=b: _finder(sent.value, not b), tuple(old.values()) if b else (), drop_text and b == blocks - 1)
        out = out.drop(*old.values())
    if drop_text:
        names.remove(text_col)
    return out.toDF(*beside(names, added), *added)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col="text", **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    inner = plain(docs)
    out = find_leaks(inner, benchmark, text_col=f"c{docs.columns.index(text_col)}", **options).where("n_hit = 0")
    return out.select(*inner.columns).toDF(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop_text=True)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.when(F.size("items") == 0, none).otherwise(F.sha2(F.array_join("items", ","), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM b),
o AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
h AS (SELECT r, s, n, item FROM o JOIN b USING (n, x)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""

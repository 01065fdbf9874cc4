"""N-gram Jaccard join: documents whose sets of word n-grams have Jaccard similarity of at least 0.8, as components.

Words are [^\\x20\\x09-\\x0D]+ after A-Z were lower-cased; a document's set holds its distinct 5-word shingles (fewer words: the whole sequence as
one).  The join is exact on 64-bit shingle hashes:

1. Every block learns by one packed exchange which of its shingles other documents have.  A document that shares less than 80 % of its
   shingles with anyone cannot have a partner; the rest, usually few, become classes of equal sets.
2. A second exchange counts each shingle over the classes.  Sets are ordered by (count, hash), rarest first; partners must meet in
   the prefix of n - ceil(0.8 n) + 1 shingles.  Classes that share a prefix shingle form families (components of the star edges
   to each shingle's smallest class; no pairs are listed).
3. Within a family the ordered sets go into tries whose nodes keep the shortest and longest set below them.  A set runs down the tries, sharing the
   overlap of common beginnings, and leaves a subtree as soon as what is left cannot reach the overlap that its lengths require; up to QUERIES
   sets run down together, one array operation a node.  All partners are found, so every pair of similar classes is met, once.  Large families are cut into chunks, and every pair of chunks
   is a task of its own, which looks only for the pairs across it, so no pair of sets is lost or repeated and no task is too big.
4. A task adds up the links of each class, copies of the partners included, and joins the classes in a union-find forest; it hands on one row per
   class (links, root), so what is exchanged grows with the classes and not with the pairs.  The sums of the links are exact; components
   of the (class, root) rows are those of all pairs, and of each the smallest doc_id is taken.

similar_pairs() instead hands on the pairs themselves, with the class of every document: documents are similar if they are in one class or
in two paired ones.  Its output grows with the number of pairs.

Shingles are known by 64-bit hashes, and equal sets by their size and two such hashes.  Of N different shingles about N^2 / 2^65 pairs are confused: none
to be expected below 6e9 shingles, some ten million among the 1.5e13 of 100 TB, each of which changes the overlap of two sets by one.

Defined cases: null text or no words: empty set, linked with nothing; equal rows are one class; rows of one doc_id are documents
of their own that share the id; a null doc_id is smaller than any other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm import _text
from tempora.llm._components import components
from tempora.llm._exchange import RANGE_KEYS, answers, count_ranges, pack_blocks, with_answers
from tempora.llm._packs import append, rest
from tempora.llm._shared import NO_ID, discard, plain, release, stage

WIDTH = 5
#: Similarity in percent.
LEAST = 80
#: Shingles and sets of one family that a task joins at once; larger families are joined chunk by chunk.
FAMILY_KEYS, FAMILY_SETS = 4_000_000, 512
#: Pairs that a task holds before it hands them on.
LINK_ROWS = 1 << 18
#: Sets that run down a trie together, at most, and cells of their table of items (five bytes each).
QUERIES, QUERY_CELLS = 128, 1 << 23


def _shingles(starts: np.ndarray, buf: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle, repeated ones too."""
    low = _text.lower(buf)
    a, b = _text.runs(low, _text.SPACED)
    words, cut = _text.run_hashes(low, a, b), _text.spans(starts, a)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(cut))
    h = _text.gram_hashes(words, width)
    at = np.flatnonzero(doc[: len(h)] == doc[width - 1 :]) if len(h) else np.zeros(0, np.int64)
    docs, hashes = [doc[at]], [h[at]]
    many = np.diff(cut)
    for k in range(1, width):
        few = np.flatnonzero(many == k)
        if len(few):
            whole = np.zeros(len(few), np.uint64)
            for j in range(k):
                whole = _text.mix(whole + words[cut[few] + j] + np.uint64(k))
            docs.append(few)
            hashes.append(whole)
    return np.concatenate(docs), np.concatenate(hashes)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers: by sorting, since np.unique goes through a hash table, which takes a hundred times as long here."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _ranked_sets(starts: np.ndarray, buf: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and document and rank among them of every distinct shingle, by document and hash."""
    doc, h = _shingles(starts, buf, width)
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(new) - 1
    bits = len(s).bit_length()
    both = _distinct(doc << bits | rank)
    return s[new], both >> bits, both & ((1 << bits) - 1)


def shingle_sets(starts: np.ndarray, buf: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle, by document and hash."""
    u, doc, rank = _ranked_sets(starts, buf, width)
    return doc, u[rank]


def _ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, their counts, and the rank of every entry."""
    return (lambda u, r, c: (u, c, r))(*np.unique(h, return_inverse=True, return_counts=True))


def block_keys(ids: np.ndarray, starts: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, None]:
    """Sorted distinct shingles of a block, for the exchange."""
    return _distinct(_shingles(starts, buf, WIDTH)[1]), None


def _signed(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums of mixed hashes of each document's set; equal sets have equal ones."""
    edge = np.searchsorted(doc, np.arange(rows + 1))
    c = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(h ^ np.uint64(k)), dtype=np.uint64)]) for k in (0x1234567, 0x89ABCDEF01)]
    return np.diff(edge), *[(x[edge[1:]] - x[edge[:-1]]).view(np.int64) for x in c]


def _sets(blocks: DataFrame) -> DataFrame:
    """id, n, s1, s2, shared: shingles of each document, and for those that may have a partner the signature of the set; the first of a
    signature in its block has its shared shingles as well."""
    ranges = count_ranges(blocks, 6.5)

    def judge(block, ids, starts, buf, answer_to):
        u, doc, rank = _ranked_sets(starts, buf)
        h, shared = u[rank], (answer_to(u) | (np.bincount(rank, minlength=len(u)) > 1))[rank]
        n = np.bincount(doc, minlength=len(ids))
        may = (100 * np.bincount(doc, weights=shared, minlength=len(ids)).astype(np.int64) >= LEAST * n) & (n > 0)
        edge = np.searchsorted(doc, np.arange(len(ids) + 1))
        sig = _signed(doc, h, len(ids))[1:]
        seen, raw = set(), []
        for k in range(len(ids)):
            key = (int(sig[0][k]), int(sig[1][k]))
            if may[k] and key not in seen:
                seen.add(key)
                own = slice(edge[k], edge[k + 1])
                raw.append(h[own][shared[own]].tobytes())
            else:
                raw.append(None)
        return pa.table({"id": ids, "n": n.astype(np.int64), "s1": pa.array(sig[0], mask=~may), "s2": pa.array(sig[1], mask=~may), "shared": pa.array(raw, pa.binary())})

    given = stage(answers(blocks, block_keys, ranges), "answers")
    release(blocks.sparkSession)
    out = stage(with_answers(blocks, given, ranges, judge, "id bigint, n bigint, s1 bigint, s2 bigint, shared binary"), "sets")
    discard(blocks, given)
    release(blocks.sparkSession)
    return out


def _pack_sets(classes: DataFrame) -> DataFrame:
    """Classes(c, n, copies, shared) as blocks: ids are classes, starts n and copies of each and then the borders of sets in units of 8 bytes, data the shingles."""
    import zstandard

    from pyspark import TaskContext

    from tempora.llm._exchange import BLOCK, BLOCK_BYTES

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            c, n, copies, raw = *(batch.column(k).to_numpy() for k in range(3)), batch.column(3).to_pylist()
            ends = np.cumsum([len(x) for x in raw])
            i = 0
            while i < len(c):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_BYTES, "right")))
                data = b"".join(raw[i:j])
                starts = np.concatenate([n[i:j], copies[i:j], [0], np.cumsum([len(x) // 8 for x in raw[i:j]])]).astype(np.int64)
                yield pa.RecordBatch.from_pylist([{"block": number, "size": len(data), "ids": c[i:j].astype(np.int64).tobytes(), "starts": starts.tobytes(), "data": press.compress(data)}])
                number += 1
                i = j

    return stage(classes.select("c", "n", "copies", "shared").mapInArrow(run, BLOCK), "set-blocks")


def _prefixed(sets: DataFrame) -> DataFrame:
    """c, n, copies, prefix, hashes, counts: each class's shingles that other classes have, rarest first, and the necessary prefix of them."""
    size = sets.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, round(size / 8 / RANGE_KEYS))

    def keys(ids, starts, buf):
        return np.unique(buf.view(np.uint64), return_counts=True)

    def order(block, ids, starts, buf, answer_to):
        k = len(ids)
        n, copies, edge, h = starts[:k], starts[k : 2 * k], starts[2 * k :], buf.view(np.uint64)
        u, _, rank = _ranked(h)
        count = answer_to(u)[rank]
        rows = {x: [] for x in ("c", "n", "copies", "prefix", "hashes", "counts")}
        for i in range(k):
            own = slice(edge[i], edge[i + 1])
            x, m = h[own], count[own]
            x, m = x[m > 1], m[m > 1]
            room = int(n[i]) - -(-LEAST * int(n[i]) // 100) + 1 - (int(n[i]) - len(x))  # the prefix without what no one else has
            if room > 0 and len(x):
                o = np.lexsort((x, m))
                rows["c"].append(int(ids[i]))
                rows["n"].append(int(n[i]))
                rows["copies"].append(int(copies[i]))
                rows["prefix"].append(x[o][:room].view(np.int64).tolist())
                rows["hashes"].append(x[o].tobytes())
                rows["counts"].append(m[o].astype(np.uint32).tobytes())
        return pa.table(rows, pa.schema([("c", pa.int64()), ("n", pa.int64()), ("copies", pa.int64()), ("prefix", pa.list_(pa.int64())), ("hashes", pa.binary()), ("counts", pa.binary())]))

    given = stage(answers(sets, keys, ranges, counts=True), "counts")
    release(sets.sparkSession)
    out = stage(with_answers(sets, given, ranges, order, "c bigint, n bigint, copies bigint, prefix array<bigint>, hashes binary, counts binary", counts=True), "ordered")
    discard(sets, given)
    release(sets.sparkSession)
    return out


class _Node:
    __slots__ = ("seg", "below", "least", "most", "depth", "ends")

    def __init__(self, seg: np.ndarray, n: int):
        self.seg, self.below, self.least, self.most, self.depth, self.ends = seg, {}, n, n, 0, []


class Trie:
    """Ordered sets with common beginnings stored once."""

    def __init__(self):
        self.root = _Node(np.zeros(0, np.int64), 0)
        self.root.least = 1 << 60

    def add(self, x: np.ndarray, n: int, member: int) -> None:
        node, i = self.root, 0
        while True:
            node.least, node.most, node.depth = min(node.least, n), max(node.most, n), max(node.depth, len(x) - i)
            if i == len(x):
                node.ends.append((member, n))
                return
            nxt = node.below.get(int(x[i]))
            if nxt is None:
                nxt = _Node(x[i:], n)
                nxt.ends.append((member, n))
                node.below[int(x[i])] = nxt
                return
            k = min(len(nxt.seg), len(x) - i)
            same = nxt.seg[:k] == x[i : i + k]
            m = k if same.all() else int(np.argmin(same))
            if m < len(nxt.seg):  # split
                top = _Node(nxt.seg[:m], n)
                top.least, top.most, top.depth = nxt.least, nxt.most, nxt.depth + len(nxt.seg) - m
                nxt.seg = nxt.seg[m:]
                top.below[int(nxt.seg[0])] = nxt
                node.below[int(x[i])] = top
                nxt = top
            node, i = nxt, i + m

    def partners(self, sets: list[np.ndarray], n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of every pair that reaches the similarity.  The queries run down together: a node is met once, for all of them that
        may still find a partner below it.  place has -1 for every item, before and after."""
        size = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        items = _distinct(every)
        place[items] = np.arange(len(items), dtype=place.dtype)
        inside = np.zeros((len(items), len(sets)), np.uint8)
        inside[place[every], np.repeat(np.arange(len(sets)), size)] = 1
        upto = np.zeros((len(items) + 1, len(sets)), np.int32)
        np.cumsum(inside, axis=0, dtype=np.int32, out=upto[1:])
        least, most = -(-LEAST * n // 100), 100 * n // LEAST
        zero = np.zeros(len(sets), np.int64)
        found, stack = [(zero[:0], zero[:0])], [(self.root, np.arange(len(sets)), zero, zero)]
        while stack:
            node, who, overlap, behind = stack.pop()
            if len(node.seg):
                at = place[node.seg]
                at = at[at >= 0]
                few = 4 * len(who) < len(sets)
                here = inside[at[:, None], who] if few else inside[at]
                here = np.add.reduce(here, axis=0, dtype=np.int32)
                overlap = overlap + (here if few else here[who])
                behind = upto[np.searchsorted(items, node.seg[-1], "right"), who]
            for member, m in node.ends:
                hit = who[100 * overlap >= LEAST * (n[who] + m - overlap)]
                found.append((hit, np.full(len(hit), member)))
            if node.below:
                below = list(node.below.values())
                depth, shortest, longest = (np.array(x)[:, None] for x in zip(*[(x.depth + len(x.seg), x.least, x.most) for x in below], strict=True))
                best = overlap + np.minimum(size[who] - behind, depth)
                short = np.maximum(shortest, least[who])
                go = (short <= np.minimum(longest, most[who])) & (100 * best >= LEAST * (n[who] + short - best))
                stack += [(below[k], who[go[k]], overlap[go[k]], behind[go[k]]) for k in np.flatnonzero(go.any(1)).tolist()]
        place[items] = -1
        query, member = (np.concatenate(x) for x in zip(*found, strict=True))
        return query, member


def link_family(n: list[int], sets: list[np.ndarray], counts: list[np.ndarray], across: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(set, its partners among those before it) of the family, so every pair of similar sets once; given a mask, only pairs between its two sides."""
    h, c = np.concatenate(sets), np.concatenate(counts)
    edge = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    order = np.lexsort((h, c))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    rank = np.empty(len(h), np.int64)
    rank[order] = np.cumsum(new) - 1
    ranks = [rank[edge[k] : edge[k + 1]] for k in range(len(n))]
    trie, place, n = Trie(), np.full(int(new.sum()), -1, np.int32), np.array(n)
    for k in np.flatnonzero(~across).tolist() if across is not None else ():
        trie.add(ranks[k], int(n[k]), k)
    asking = np.arange(len(n)) if across is None else np.flatnonzero(across)
    size, i = np.cumsum([len(ranks[k]) for k in asking.tolist()]), 0
    while i < len(asking):
        j = i + 1
        while j < len(asking) and j - i < QUERIES and (j + 1 - i) * (size[j] - (size[i - 1] if i else 0)) <= QUERY_CELLS:
            j += 1
        own = asking[i:j]
        if across is None:
            for k in own.tolist():
                trie.add(ranks[k], int(n[k]), k)
        query, member = trie.partners([ranks[k] for k in own.tolist()], n[own], place)
        query = own[query]
        if across is None:  # the batch has met itself, too
            query, member = query[member < query], member[member < query]
        order = np.lexsort((member, query))
        query, member = query[order], member[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        for k, p in zip(query[first].tolist(), np.split(member, first[1:]), strict=False):
            yield k, p
        i = j


def _as_pairs(c: np.ndarray, links: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[np.ndarray]]:
    for k, p in links:
        yield [np.minimum(c[p], c[k]), np.maximum(c[p], c[k])]


def _as_sums(c: np.ndarray, copies: np.ndarray, links: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """One batch: class, the smallest class it is joined to here, and its links to documents of other classes."""
    root, sums = np.arange(len(c)), np.zeros(len(c), np.int64)  # classes ascend, so the smaller index is the smaller class

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    for k, p in links:
        sums[k] += copies[p].sum()
        sums[p] += copies[k]
        own = {find(x) for x in set(root[p].tolist())} | {find(k)}
        least = min(own)
        for x in own:
            root[x] = least
        root[p] = root[k] = least
    some = np.flatnonzero(sums)
    if len(some):
        yield [c[some], c[[find(x) for x in some.tolist()]], sums[some]]


def _links(ordered: DataFrame, pairs: bool) -> DataFrame:
    """a, b: every pair of similar classes, once, a < b.  Or c, root, links: partial sums of the links of each class, and a class it is joined to."""
    held = ordered.select("c", F.explode("prefix").alias("t"))
    least = held.groupBy("t").agg(F.min("c").alias("m"), F.count("*").alias("k")).where("k > 1")
    stars = held.join(least, "t").where("c <> m").select(F.col("c").alias("a"), F.col("m").alias("b")).distinct()
    family = components(stars)
    rows = ordered.join(family.select(F.col("node").alias("c"), F.col("label").alias("family")), "c").select("c", "n", "copies", "hashes", "counts", "family")
    parts = F.ceil(F.greatest(F.sum(F.length("hashes")) / (8 * FAMILY_KEYS), F.count("*") / FAMILY_SETS))
    rows = rows.join(rows.groupBy("family").agg(parts.cast("int").alias("q")), "family")
    spread = max(8, 4 * int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunk = F.pmod(F.hash("c"), F.col("q"))
    both = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: F.struct(F.least(j, F.col("chunk")).alias("i"), F.greatest(j, F.col("chunk")).alias("j")))
    rows = rows.withColumn("chunk", chunk).select("c", "n", "copies", "hashes", "counts", "family", "q", "chunk", F.explode(both).alias("p"))
    # a small family shares a task's group with others; each pair of chunks of a large one is a group
    group = F.when(F.col("q") == 1, F.pmod(F.xxhash64("family"), F.lit(spread))).otherwise(F.col("family"))
    rows = rows.select(group.alias("g"), (F.col("q") > 1).alias("large"), F.col("p.i").alias("i"), F.col("p.j").alias("j"), "family", "chunk", "c", "n", "copies", "hashes", "counts")
    names = ["a", "b"] if pairs else ["c", "root", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        t = pa.Table.from_batches(batches).sort_by([("family", "ascending"), ("c", "ascending")])
        f, c, n, copies, chunk, at = (t.column(x).to_numpy() for x in ("family", "c", "n", "copies", "chunk", "i"))
        across = chunk != at if t.column("j")[0] != t.column("i")[0] else None
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
        counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("counts")]
        first = np.append(np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])), len(f)).tolist()
        held, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*held, strict=True)], names=names)
        for i, j in zip(first[:-1], first[1:], strict=True):
            links = link_family(n[i:j].tolist(), sets[i:j], counts[i:j], across)
            for got in _as_pairs(c[i:j], links) if pairs else _as_sums(c[i:j], copies[i:j], links):
                held.append(got)
                size += len(got[0])
                if size >= LINK_ROWS:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    out = stage(rows.groupBy("g", "large", "i", "j").applyInArrow(run, ", ".join(f"{x} bigint" for x in names)), "links")
    discard(ordered, family)
    return out


def _joined(docs: DataFrame, id_col: str, text_col: str, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged: signatures of all documents, classes of those that may have a partner, and _links() between classes."""
    full = _sets(pack_blocks(docs, id_col, text_col))
    few = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    every = stage(full.drop("shared").coalesce(few), "signatures")  # four numbers a document: few files
    classes = full.where("s1 is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("shared", ignorenulls=True).alias("shared"))
    classes = stage(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    discard(full)
    return every, classes, _links(_prefixed(_pack_sets(classes)), pairs)


def similar_pairs(docs: DataFrame, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """(pairs, documents): class_a, class_b of every pair of similar classes, once; doc_id, n_shingles, class_id of every document.

    A class holds the documents of one set of shingles; class_id is null where no other document can be similar.
    """
    every, classes, links = _joined(docs, id_col, text_col, True)
    of = classes.select("s1", "s2", "n", F.col("c").alias("class_id"))
    members = every.join(of, ["s1", "s2", "n"], "left").select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), "class_id")
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")), members


def _components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Staged: id, n, s1, s2 of every document; s1, s2, n, first, component_id, n_links of every class."""
    every, classes, links = _joined(docs, id_col, text_col, False)
    labels = components(links.where("c <> root"), "c", "root")
    sums = links.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.select("c", "s1", "s2", "n", "first", "copies").join(labels.select(F.col("node").alias("c"), "label"), "c", "left").join(sums, "c", "left")
    named = named.withColumn("label", F.coalesce("label", "c")).withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stage(named.join(least, "label").select("label", "s1", "s2", "n", "first", "component_id", "n_links"), "class-components")
    discard(classes, links, labels)
    return every, named


def join_similar(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents that it is similar to) for every document."""
    every, named = _components(docs, id_col, text_col)
    alone = every.where("s1 is null").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    out = every.where("s1 is not null").join(named, ["s1", "s2", "n"]).select("id", "n", "component_id", "n_links").unionByName(alone)
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component_id").alias("component_id"), "n_links")


def _signatures(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with n, s1, s2 as in _sets()."""
    return append(docs, text_col, "n bigint, s1 bigint, s2 bigint", lambda: lambda buf, starts, _: list(_signed(*shingle_sets(starts, buf), len(starts) - 1)))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Of each component one row, of the smallest id, with the columns of docs.

    Rows are told apart by their id and set of shingles, so a repeated doc_id saves no copy; rows of equal id and set are one (those without
    words: of equal id and text).
    """
    cols = docs.columns
    every, named = _components(docs, id_col, text_col)
    key = F.struct("first", "s1", "s2", "n")
    best = stage(named.groupBy("label").agg(F.min(key).alias("k")).select("k.*"), "kept")
    rows = plain(docs)
    i, t = f"c{cols.index(id_col)}", f"c{cols.index(text_col)}"
    rows = rows.withColumn("_id", F.coalesce(F.col(i).cast("bigint"), F.lit(NO_ID)))
    twice = stage(every.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"), "repeated-ids")
    kept = every.where("s1 is null").select("id").unionAll(best.select(F.col("first").alias("id")))
    own = F.col("_id") == F.col("id")
    out = rows.join(kept, own, "left_semi")
    if not twice.isEmpty():
        out = out.join(twice, own, "left_anti")
        more = _signatures(rows.join(twice, own, "left_semi"), t)
        member = named.select(*[F.col(c).alias(f"m_{c}") for c in ("s1", "s2", "n")]).distinct()
        best = best.select(*[F.col(c).alias(f"b_{c}") for c in ("first", "s1", "s2", "n")])
        same = lambda p: (F.col("s1") == F.col(f"{p}_s1")) & (F.col("s2") == F.col(f"{p}_s2")) & (F.col("n") == F.col(f"{p}_n"))
        more = more.join(member, same("m"), "left").join(best, same("b") & (F.col("_id") == F.col("b_first")), "left")
        more = more.where(F.col("m_n").isNull() | F.col("b_n").isNotNull())  # in no class, or its class's kept id
        w = Window.partitionBy("_id", "n", "s1", "s2", F.when(F.col("n") == 0, F.col(t))).orderBy(t)
        more = more.withColumn("_place", F.row_number().over(w)).where("_place = 1")
        out = out.select(*rows.columns).unionByName(more.select(*rows.columns))
    return out.select(*[f"c{k}" for k in range(len(cols))]).toDF(*cols)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[s:s + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS s FROM d)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS inter FROM g a JOIN g b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * inter >= 80 * (na.n + nb.n - inter)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, s.b FROM t JOIN s ON t.b = s.a),
l AS (SELECT a, count(*) AS n_links FROM s GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d JOIN t ON t.a = d.r JOIN d o ON o.r = t.b LEFT JOIN n ON n.r = d.r LEFT JOIN l ON l.a = d.r GROUP BY d.r, d.doc_id, n, n_links
"""

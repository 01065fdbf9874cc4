"""Token-ID output: raw id payload files, and a minimal perfect hash index from document keys to them.

Layout of a data set (a folder in a store that pyarrow.fs can write; s3a, s3n and dbfs names are understood, any other store is refused
at the start):

    data/*.ids     raw little-endian ids, document after document (uint16 if the vocabulary fits, else uint32)
    index/*.mph    one file per key shard: a minimal perfect hash and, in slot order, fingerprint, file, offset, length, start
    files          Parquet: one row per id file: number, path, first key, documents, ids, start, rows of the first key in files before

Documents are range-partitioned and sorted by key and text (ranges by key and the text's beginning, so a repeated key is split), so files ascend
in doc_id and each starts where the one before ends.
Every task writes files under names of its own; only files that the written manifest names belong to the data set, so
retried tasks and lost executors leave no trace in it.  Until the index is there, entries/ has beside each id file the key, occurrence and
length of its documents, and Spark gets one row per id file: executors write few files through Hadoop, which starts a child for each
where it has no native library.

The hash: keys go to index shards by hash; in a shard each level is a bit array of about two bits per remaining key, keys that
fall alone on a bit stay, the rest move to the next level; the slot of a key is the rank of its bit.  A look-up is a constant number of
steps on average, and the 32-bit fingerprint in the slot tells strangers apart.

Encoding: a text is cut before single spaces and newlines and between ASCII letters or digits and punctuation (but not after an
apostrophe).  There the tokenizer's own pre-tokenizer cuts as well, so each distinct chunk is encoded once by the tokenizers
library and the ids are laid out by NumPy; a chunk is known by its hash and by all its bytes.  Texts with other or longer white space, or with added tokens, are encoded whole by
the same library.  Only ByteLevel files with the usual regular expression are treated so; any other encodes whole texts.

Defined cases: a null text is empty (only the end id); a null doc_id is the smallest key; repeated doc_ids are told apart
by their occurrence number 0, 1, ... in the order of texts; an empty table gives an empty data set; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm import _text
from tempora.llm._packs import rest, views
from tempora.llm._shared import NO_ID, discard, drop_path, new_path, ship, stage

END_ID = 0
#: Distinct chunks and their bytes kept by a worker; it starts afresh beyond.
CACHE, CACHE_BYTES = 1_000_000, 64 << 20
#: Ids per payload file, about.
FILE_IDS = 16 << 20
#: Ids of neighbouring small files that are read back together, about.
READ_IDS = 2 << 20
#: Documents encoded at a time, and keys per index shard, about.
BATCH_BYTES = 2 << 20
SHARD_KEYS = 50_000
#: Occurrences of one key that are listed at once.
STEP = 1 << 16
_ODD = re.compile(r"\s")
_ENCODERS: dict[str, object] = {}
#: 1 ASCII letters and digits, 2 ASCII punctuation, 3 the apostrophe, 8 space and newline, 0 anything else.
_SIDE = np.zeros(256, np.uint8)
_SIDE[33:127] = 2
_SIDE[48:58] = _SIDE[65:91] = _SIDE[97:123] = 1
_SIDE[39] = 3
_SIDE[[10, 32]] = 8
#: Bytes that white space other than space and newline begins with.
_WARY = np.zeros(256, bool)
_WARY[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a folder or file named as Spark names it: Hadoop's names of a scheme become those of pyarrow.fs."""
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if uri.startswith(hadoop):
            uri = arrow + uri[len(hadoop) :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _check_store(root: str) -> None:
    """Fail at the start, on the driver, if the folder is in a store that pyarrow.fs cannot write."""
    try:
        fs, at = _open(root)
        fs.create_dir(at, recursive=True)
    except (OSError, ValueError, NotImplementedError, pa.ArrowException) as e:
        raise ValueError(f"token files need a folder that pyarrow.fs can write (file, s3, gs, abfs; hdfs with libhdfs), not {root}: {e}") from e


class Encoder:
    """Whole texts to ids with the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 65536 else "<u2")
        self.forget()

    def forget(self) -> None:
        """Of each known chunk: hash (sorted), row by hash; by row: borders of its bytes, first id, white space."""
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw, self.place = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.at, self.space = np.zeros(1, np.int64), np.zeros(0, np.int8)
        self.ids = np.zeros(0, self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, chunks: list[bytes], wary: np.ndarray) -> None:
        texts = [c.decode() for c in chunks]
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        n = len(self.row)
        put = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, put, keys), np.insert(self.row, put, np.arange(n, n + len(keys)))
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(chunks), np.uint8)])
        self.place = np.concatenate([self.place, self.place[-1] + np.cumsum([len(c) for c in chunks], dtype=np.int64)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in got], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), self.kind)])
        space = np.zeros(len(texts), np.int8)
        for k in wary.tolist():
            t = texts[k]
            space[k] = 1 if t in (" ", "\n") else 2 * bool(_ODD.search(t, t[0] in " \n"))
        self.space = np.concatenate([self.space, space])

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of each; starts has the end as well, and data begins at starts[0]."""
        starts = starts - starts[0]
        n, data = len(starts) - 1, np.ascontiguousarray(data[: starts[-1]])
        raw = data.tobytes()
        text = lambda k: raw[starts[k] : starts[k + 1]].decode()
        if not self.cuts or not len(data):
            ids = self.whole([text(k) for k in range(n)])
            return np.concatenate([np.zeros(0, self.kind), *ids]), np.array([len(x) for x in ids], np.int64)
        if len(self.keys) > CACHE or len(self.raw) > CACHE_BYTES:
            self.forget()
        left, right = _SIDE[data[:-1]], _SIDE[data[1:]]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (right == 8) | ((left == 1) & (right >= 2)) | ((left == 2) & (right == 1))
        cut[starts] = True
        edges = np.flatnonzero(cut)
        a, b = edges[:-1], edges[1:]
        size = b - a
        hashes, first, rank = np.unique(_text.run_hashes(data, a, b), return_index=True, return_inverse=True)
        fa, fb, fn = a[first], b[first], size[first]
        at = np.searchsorted(self.keys, hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            maybe = np.concatenate([[0], np.cumsum(_WARY[data], dtype=np.int64)])
            wary = np.flatnonzero((maybe[fb[new]] > maybe[fa[new]]) | (fn[new] == 1))
            self.learn(hashes[new], [raw[i:j] for i, j in zip(fa[new].tolist(), fb[new].tolist(), strict=True)], wary)
        row = self.row[np.searchsorted(self.keys, hashes)]
        wrong = self.place[row + 1] - self.place[row] != fn  # another chunk of the same hash: its texts are encoded whole
        like = np.flatnonzero(~wrong)
        wrong[like] = ~_text.equal_runs(data, fa[like], self.raw, self.place[row[like]], fn[like])
        row, wrong = row[rank], wrong[rank] | (size != fn[rank])
        like = np.flatnonzero(~wrong)
        wrong[like] = ~_text.equal_runs(data, a[like], data, fa[rank[like]], size[like])
        m = self.at[row + 1] - self.at[row]
        ends = np.cumsum(m)
        ids = self.ids[np.repeat(self.at[row] - (ends - m), m) + np.arange(int(ends[-1]))]
        doc = np.searchsorted(starts, a, "right") - 1
        total = np.concatenate([[0], ends])
        edge = np.searchsorted(a, starts)
        lens = total[edge[1:]] - total[edge[:-1]]
        space = self.space[row]
        last = np.zeros(len(a) + 1, bool)
        last[edge] = True
        strange = np.unique(doc[(space == 2) | ((space == 1) & ~last[1:]) | wrong]).tolist()
        for t in self.added:
            i = raw.find(t)
            while i >= 0:
                strange.append(int(np.searchsorted(starts, i, "right")) - 1)
                i = raw.find(t, i + 1)
        if strange:
            strange = sorted(set(strange))
            to = np.concatenate([[0], np.cumsum(lens)])
            parts, at = [], 0
            for k, own in zip(strange, self.whole([text(k) for k in strange]), strict=True):
                parts += [ids[to[at] : to[k]], own]
                at = k + 1
                lens[k] = len(own)
            ids = np.concatenate([*parts, ids[to[at] :]])
        return ids, lens


def encoder_for(path: str) -> Encoder:
    """One encoder a worker process, so that what it knows outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _hashes(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return _text.mix(_text.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + occurrence.astype(np.uint64))


class MinimalPerfectHash:
    """Distinct 64-bit hashes to 0..n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        bits = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        base = np.concatenate([[0], np.cumsum([b[-1] for b in bits])]).astype(np.int64)
        self.rank = [b[:-1] + base[i] for i, b in enumerate(bits)]

    @staticmethod
    def _spot(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_text.mix(h + np.uint64((level + 1) * 0xA0761D6478BD642F % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> MinimalPerfectHash:
        levels, left = [], h
        if len(np.unique(h)) != len(h):
            raise ValueError("keys repeat")
        while len(left):
            size = 2 * len(left) + 1
            spot = cls._spot(left, len(levels), size)
            alone = np.bincount(spot, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[spot]]
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; of a stranger some slot or -1."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        for i, bits in enumerate(self.levels):
            spot = self._spot(h[todo], i, len(bits))
            good = bits[spot]
            out[todo[good]] = self.rank[i][spot[good]]
            todo = todo[~good]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: memoryview) -> tuple[MinimalPerfectHash, int]:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<i8", n, 8), 8 + 8 * n, []
        for s in sizes.tolist():
            m = (s + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, m, at), count=s).astype(bool))
            at += m
        return cls(levels), at


_ENTRY = pa.schema([("key", pa.int64()), ("again", pa.int64()), ("n", pa.int64())])


class _Payload:
    """An id file that is being written, and beside it the entries of its documents."""

    def __init__(self, root: str, place: int):
        self.name, self.place = f"{uuid.uuid4().hex}.ids", place
        fs, at = _open(root)
        self.out, self.beside = (fs.open_output_stream(f"{at}/{d}/{self.name}") for d in ("data", "entries"))
        self.entries = pa.ipc.new_stream(self.beside, _ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.docs = self.ids = self.times = 0
        self.first = self.last = None

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Documents by ascending key, their ids and the number of each; `again` counts inside a file."""
        self.out.write(ids.tobytes())
        again = np.zeros(len(keys), np.int64)
        if keys[0] == self.last or len(np.unique(keys)) < len(keys):
            for k, x in enumerate(keys.tolist()):
                self.times = self.times + 1 if x == self.last else 0
                again[k], self.last = self.times, x
        else:
            self.last, self.times = int(keys[-1]), 0
        if self.first is None:
            self.first = int(keys[0])
        if keys[0] == self.first:
            self.firsts = int(again[keys == self.first][-1]) + 1
        self.entries.write_batch(pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, again, n)], schema=_ENTRY))
        self.docs, self.ids = self.docs + len(keys), self.ids + len(ids)

    def close(self) -> pa.RecordBatch:
        """The file's row: its name and place, its first and last key and the rows of each, its documents and ids."""
        for x in (self.entries, self.beside, self.out):
            x.close()
        row = {"name": self.name, "place": self.place, "key": self.first, "last": self.last, "k0": self.firsts, "k1": self.times + 1, "docs": self.docs, "ids": self.ids}
        return pa.RecordBatch.from_pylist([row])


_SLOT = np.dtype([("print", "<u4"), ("file", "<i4"), ("offset", "<i8"), ("n", "<i8"), ("start", "<i8")])


def write(docs: DataFrame, tokenizer: str, root: str | None = None, id_col="doc_id", text_col="text", end_id=END_ID) -> str:
    """Encode every document and write the data set; returns its root folder."""
    spark = docs.sparkSession
    ship(spark)
    root = root or new_path(spark, "tokens")
    _check_store(root)
    df = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def encode(batches):
        fs, at = _open(root)
        for d in ("data", "entries"):
            fs.create_dir(f"{at}/{d}", recursive=True)
        encoder, out, place = encoder_for(tokenizer), None, TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = views(batch.column(1))
            i = 0
            while i < len(keys):
                j = min(len(keys), max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH_BYTES, "right")) - 1))
                ids, n = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                if out and out.ids >= FILE_IDS:
                    yield out.close()
                    out = None
                if not out:
                    out, place = _Payload(root, place), place + 1
                out.add(keys[i:j], ids, n)
                i = j
            del batch, data, offsets, keys
            rest()
        if out:
            yield out.close()

    parts = spark.conf.get("spark.sql.shuffle.partitions")
    ordered = df.repartitionByRange(int(parts), "key", F.substring("text", 1, 16)).sortWithinPartitions("key", "text")
    made = ordered.mapInArrow(encode, "name string, place bigint, key bigint, last bigint, k0 bigint, k1 bigint, docs bigint, ids bigint")
    # one row per payload file, in the order of ranges, brought together before it is written; what a file's first key has in files before is carried
    up_to = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    made = stage(made.select("*", (F.row_number().over(Window.orderBy("place")) - 1).cast("int").alias("file"), (F.sum("ids").over(up_to) - F.col("ids")).alias("start")), "token-files")
    ends = made.select("file", "key", F.col("k0").alias("n")).unionAll(made.where("last <> key").select("file", "last", "k1"))
    before = Window.partitionBy("key").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    made.join(carried, ["file", "key"]).select("name", "file", "key", "docs", "ids", "start", "carried").coalesce(1).write.parquet(f"{root}/files")
    discard(made)
    files = spark.read.parquet(f"{root}/files")
    total = files.agg(F.sum("docs")).first()[0] or 0
    shards = max(1, -(-total // SHARD_KEYS))

    def entries(batches):
        fs, at = _open(f"{root}/entries")
        for f in chain.from_iterable(batch.to_pylist() for batch in batches):
            offset = 0
            with fs.open_input_stream(f"{at}/{f['name']}") as beside:
                for batch in pa.ipc.open_stream(beside):
                    key, again, n = (c.to_numpy() for c in batch.columns)
                    places = offset + np.cumsum(n) - n
                    offset += int(n.sum())
                    again = again + f["carried"] * (key == f["key"])
                    file = np.full(len(key), f["file"], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, again, file, places, n, f["start"] + places)], names=["key", "again", "file", "offset", "n", "start"])

    keyed = files.repartition(int(parts)).mapInArrow(entries, "key bigint, again bigint, file int, offset bigint, n bigint, start bigint")
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("key", "again"), F.lit(shards)))

    def index(table: pa.Table) -> pa.Table:
        x = {c: table.column(c).to_numpy() for c in ("key", "again", "file", "offset", "n", "start", "shard")}
        h = _hashes(x["key"], x["again"])
        mph = MinimalPerfectHash.build(h)
        slots = np.zeros(len(h), _SLOT)
        k = mph.slots(h)
        slots["print"][k] = (h >> np.uint64(32)).astype(np.uint32)
        for c in ("file", "offset", "n", "start"):
            slots[c][k] = x[c]
        fs, at = _open(f"{root}/index")
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.mph"
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(mph.dump() + slots.tobytes())
        return pa.table({"shard": [int(x["shard"][0])], "name": [name], "keys": [len(h)]})

    keyed.groupBy("shard").applyInArrow(index, "shard bigint, name string, keys bigint").write.parquet(f"{root}/shards")
    drop_path(spark, f"{root}/entries")
    return root


class Reader:
    """Keyed access to a data set from one process."""

    def __init__(self, root: str, files: dict[int, str], shards: dict[int, str], kind: str = "<u2"):
        self.fs, self.root = _open(root)
        self.files, self.shards, self.kind = files, shards, kind
        self.open: dict[int, tuple[MinimalPerfectHash, np.ndarray]] = {}

    def shard(self, k: int) -> tuple[MinimalPerfectHash, np.ndarray]:
        if k not in self.open:
            with self.fs.open_input_file(f"{self.root}/index/{self.shards[k]}") as f:
                raw = memoryview(f.read())
            mph, at = MinimalPerfectHash.load(raw)
            self.open[k] = (mph, np.frombuffer(raw, _SLOT, -1, at))
        return self.open[k]

    def find(self, shard: int, keys: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot records of the keys, and whether each is present."""
        mph, slots = self.shard(shard)
        h = _hashes(keys, again)
        k = mph.slots(h)
        rows = slots[np.maximum(k, 0)]
        return rows, (k >= 0) & (rows["print"] == (h >> np.uint64(32)).astype(np.uint32))

    def ids(self, file: int, offset: int, n: int) -> np.ndarray:
        size = np.dtype(self.kind).itemsize
        with self.fs.open_input_file(f"{self.root}/data/{self.files[file]}") as f:
            f.seek(offset * size)
            return np.frombuffer(f.read(n * size), self.kind)


def look_up(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """keys(key, again) through the index: key, again, file, offset, n, start; keys that are not in the data set are left out."""
    ship(spark)
    shards = spark.read.parquet(f"{root}/shards")
    n = shards.count()
    if not n:
        return spark.createDataFrame([], "key bigint, again bigint, file int, offset bigint, n bigint, start bigint")
    routed = keys.withColumn("shard", F.pmod(F.xxhash64("key", "again"), F.lit(shards.agg(F.max("shard")).first()[0] + 1)))
    routed = routed.join(shards.select("shard", "name"), "shard")
    schema = "key bigint, again bigint, file int, offset bigint, n bigint, start bigint"

    def find(table: pa.Table) -> pa.Table:
        key, again = table.column("key").to_numpy(), table.column("again").to_numpy()
        rows, good = Reader(root, {}, {0: table.column("name")[0].as_py()}).find(0, key, again)
        return pa.table({"key": key[good], "again": again[good]} | {c: np.ascontiguousarray(rows[c][good]) for c in ("file", "offset", "n", "start")})

    return routed.groupBy("shard").applyInArrow(find, schema)


def read_back(spark: SparkSession, root: str, keys: DataFrame, tokenizer: str) -> DataFrame:
    """Each key's start, n_tokens and CRC-32 (over little-endian uint32 ids) from the files, by way of the index."""
    near = F.floor(F.col("start") / READ_IDS).alias("near")
    found = look_up(spark, root, keys).join(spark.read.parquet(f"{root}/files").select("file", "name", near), "file")

    def crcs(table: pa.Table) -> pa.Table:
        kind = encoder_for(tokenizer).kind
        table = table.sort_by([("file", "ascending"), ("offset", "ascending")])
        file, offset, n = (table.column(c).to_numpy() for c in ("file", "offset", "n"))
        fs, at = _open(f"{root}/data")
        out = np.zeros(len(n), np.int64)
        edges = [*np.flatnonzero(np.diff(file, prepend=-1)).tolist(), len(n)]
        for i, j in pairwise(edges):
            with fs.open_input_file(f"{at}/{table.column('name')[i].as_py()}") as f:
                for k, o, m in zip(range(i, j), offset[i:j].tolist(), n[i:j].tolist(), strict=True):
                    f.seek(o * kind.itemsize)
                    out[k] = zlib.crc32(np.frombuffer(f.read(m * kind.itemsize), kind).astype("<u4").tobytes())
        return pa.table({c: table.column(c) for c in ("key", "again", "start")} | {"n_tokens": n, "ids_crc32": out})

    return found.groupBy("near").applyInArrow(crcs, "key bigint, again bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def occurrences(docs: DataFrame, id_col="doc_id") -> DataFrame:
    """key, again of every row: equal ids get 0, 1, ..., made STEP at a time."""
    n = docs.groupBy(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("key")).agg(F.count("*").alias("n"))
    some = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), c))
    n = n.select("key", "n", some(F.floor((F.col("n") - 1) / STEP)).alias("k"))
    return n.select("key", "k", some(F.least(F.col("n") - F.col("k") * STEP, F.lit(STEP)) - 1).alias("again")).select("key", (F.col("k") * STEP + F.col("again")).alias("again"))


def write_and_verify(docs: DataFrame, tokenizer: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """Write docs as a data set and read every document back: doc_id, occurrence, start, n_tokens, ids_crc32."""
    tokenizer = tokenizer or default_tokenizer()
    root = write(docs, tokenizer, id_col=id_col, text_col=text_col)
    out = read_back(docs.sparkSession, root, occurrences(docs, id_col), tokenizer)
    return out.select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), F.col("again").alias("occurrence"), "start", "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return write_and_verify(docs).select("doc_id", "start", "n_tokens", "ids_crc32")

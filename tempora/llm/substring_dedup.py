"""Substring dedup: words covered by a window of `width` words that starts in an earlier document too are removed.

Words are [^\\x20\\x09-\\x0D]+, unchanged.  Every window gets a Rabin-Karp hash; the hashes are counted over the whole corpus by the
exchange of _exchange.py, which tells each block of documents the windows that a document of smaller id has as well.  Repeated windows merge
into maximal intervals by a running sum over their borders.

A window is known by its Rabin-Karp hash of 64 bits and 24 bits of another one.  Among the 1.5e13 windows of 100 TB less than one pair
of different windows is to be expected that agrees in both (N^2 / 2^89); with 64 bits it would be some ten million.

Defined cases: null text has no words; a text of fewer than `width` words has no window and is kept; repeats inside one document are
kept, and so are those between rows of equal doc_id; a null doc_id is smaller than any other; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import _text
from tempora.llm._exchange import answers, count_ranges, in_groups, pack_blocks, with_answers
from tempora.llm._shared import NO_ID, release, stage

WIDTH = 13


def _windows(starts, buf, width):
    """Word borders, documents' first words, and document, hash and tag of every window, by first word."""
    a, b = _text.runs(buf, _text.SPACED)
    cut = _text.spans(starts, a)
    words = _text.run_hashes(buf, a, b)
    h = _text.gram_hashes(words, width)
    tag = (_text.gram_hashes(_text.mix(words + np.uint64(1)), width, _text.STEP_TAG) >> np.uint64(40)).astype(np.uint32)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(cut))
    at = np.flatnonzero(doc[: len(h)] == doc[width - 1 :]) if len(h) else np.zeros(0, np.int64)
    return a, b, cut, doc[at], at, h[at], tag[at]


def _distinct(h: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, where each occurs first, and the rank of every entry."""
    order, new = in_groups(h, tag)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.cumsum(new) - 1
    return h[order[new]], order[new], rank


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", width=WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), starts and ends of the removed intervals in words."""
    blocks = pack_blocks(docs, id_col, text_col)
    ranges = count_ranges(blocks, 6)

    def keys(ids, starts, buf):
        *_, doc, _, h, tag = _windows(starts, buf, width)
        u, first, _ = _distinct(h, tag)
        return u, ids[doc[first]], tag[first]

    def cut_out(block, ids, starts, buf, flags_of):
        a, b, cut, doc, at, h, tag = _windows(starts, buf, width)
        u, first, rank = _distinct(h, tag)
        again = flags_of(u)[rank] | (ids[doc[first]][rank] < ids[doc])
        depth = np.zeros(len(a) + 1, np.int64)
        np.add.at(depth, at[again], 1)
        np.add.at(depth, at[again] + width, -1)
        gone = np.cumsum(depth[:-1]) > 0
        owner = np.repeat(np.arange(len(ids)), np.diff(cut))
        edge = np.ones(len(gone) + 1, bool)
        edge[1:-1] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
        first_in = np.flatnonzero(gone & edge[:-1])
        last_in = np.flatnonzero(gone & edge[1:]) + 1
        total = np.concatenate([[0], np.cumsum(gone)])
        text = buf.copy()
        text[b] = 32
        level = np.zeros(len(text) + 1, np.int32)
        level[a[~gone]] += 1
        level[b[~gone] + 1] -= 1
        keep = np.cumsum(level[:-1], dtype=np.int32) > 0
        kept = text[keep]
        size = np.concatenate([[0], np.cumsum(keep)])[starts]
        room = np.diff(size) > 0
        drop = size[1:][room] - 1  # the space after each document's last word
        kept = np.delete(kept, drop)
        offsets = size - np.concatenate([[0], np.cumsum(room)])
        lists = pa.array(np.searchsorted(owner[first_in], np.arange(len(ids) + 1)).astype(np.int32))
        return pa.table({
            "doc_id": ids, "n_words": np.diff(cut), "n_removed": total[cut[1:]] - total[cut[:-1]],
            "kept": pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())).cast(pa.string()),
            "starts": pa.ListArray.from_arrays(lists, pa.array(first_in - cut[owner[first_in]], pa.int64())),
            "ends": pa.ListArray.from_arrays(lists, pa.array(last_in - cut[owner[first_in]], pa.int64())),
        })

    given = stage(answers(blocks, keys, ranges, earlier=True, tagged=True), "answers")
    release(docs.sparkSession)
    out = with_answers(blocks, given, ranges, cut_out, "doc_id bigint, n_words bigint, n_removed bigint, kept string, starts array<bigint>, ends array<bigint>")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT r, doc_id, s, array_to_string(w[s:s + 12], ' ') AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) > 12)),
m AS (SELECT x, min(doc_id) AS least FROM x GROUP BY x),
g AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(s, s + 13)) AS p FROM x JOIN m USING (x) WHERE doc_id > least)),
n AS (SELECT r, count(*) AS n_removed FROM g GROUP BY r),
k AS (SELECT r, string_agg(v, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""

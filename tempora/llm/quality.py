"""Quality classifier: a generalised additive model with pairwise interactions.

score = sigmoid(bias + sum of one look-up table per feature + sum of one table per chosen pair of features).  The tables grow by
cyclic boosting: round after round each feature in turn gets one small tree (at most LEAVES leaves over its bins), fitted to the
logistic loss by Newton steps with a low rate; then the pairs with the greatest gain on what is left get trees of one cut in each of
both features.  Scoring is bin look-ups and additions over whole batches.

Features are computed from the whole text alone: labels, language, source and id are never inputs.  The model is fitted on at most
SAMPLE labels (those of least hash) and as many of their texts, should ids repeat; these are the only bounds.  Scoring covers every row.

Defined cases: null and empty texts have all features 0 and get a score like any other; a label row without doc_id or quality is not
learnt from; without labels of both classes the score is the share of label 1 (1.0 without any label); a repeated doc_id is scored row by
row; an empty table gives no rows; clashing names of further columns do not matter to keep().
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import _text
from tempora.llm._packs import append
from tempora.llm._shared import plain

SAMPLE = 20_000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 160, 60, 8
LEAVES, RATE, SMOOTH = 4, 0.12, 4.0
KEEP_FROM = 0.7

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "bare_symbols", "repeats_previous", "distinct",
    "short_words", "stops", "lines", "non_ascii", "ends_in_symbol", "top_word", "repeated_lines", "letters", "longest_word",
)

_UP, _DIGIT, _LETTER, _STOP, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_UP[65:91] = _DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP[list(b".,;:?")] = True
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _SYMBOL[_c] = True


def features(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document."""
    n = len(starts) - 1
    a, b = _text.runs(buf, _text.SPACED)
    cut = _text.spans(starts, a)
    words = np.diff(cut)
    doc = np.repeat(np.arange(n), words)
    sums = lambda x: np.bincount(doc, weights=x, minlength=n)
    size = np.maximum(1, words).astype(float)

    def bytes_in(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int64)])
        return (c[starts[1:] - 1] - c[starts[:-1]]).astype(float)

    length = np.maximum(1, np.diff(starts) - 1).astype(float)
    h = _text.run_hashes(_text.lower(buf), a, b)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    first = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, ds[first], np.diff(np.append(first, len(h))).astype(float))
    alnum = np.concatenate([[0], np.cumsum(_text.ALNUM[buf], dtype=np.int64)])
    bare = (alnum[b] - alnum[a]) == 0
    last = buf[b - 1] if len(b) else np.zeros(0, np.uint8)
    ends = ~_text.ALNUM[last] & ~_STOP[last]
    letters = bytes_in(_LETTER)
    line = np.ones(256, bool)
    line[10] = False
    line_buf = buf.copy()
    line_buf[starts[1:] - 1] = 10
    la, lb = _text.runs(line_buf, line)
    ld = np.searchsorted(starts, la, "right") - 1
    lh = _text.run_hashes(line_buf, la, lb)
    o = np.lexsort((lh, ld))
    again = np.zeros(len(lh))
    again[1:] = (lh[o][1:] == lh[o][:-1]) & (ld[o][1:] == ld[o][:-1])
    lines = np.bincount(ld, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, (b - a).astype(float))
    only = lambda byte: np.eye(1, 256, byte, dtype=bool)[0]
    return np.column_stack([
        np.log1p(words), sums(b - a) / size, bytes_in(_UP) / np.maximum(1, letters), bytes_in(_DIGIT) / length, bytes_in(_SYMBOL) / length,
        bytes_in(only(33)) / size, sums(bare) / size, sums(same) / size, np.bincount(ds[first], minlength=n) / size,
        sums((b - a) <= 3) / size, bytes_in(_STOP) / size, lines / size, bytes_in(np.arange(256) > 127) / length, sums(ends) / size,
        top / size, np.bincount(ld[o], weights=again, minlength=n) / np.maximum(1, lines), letters / length, np.log1p(longest),
    ])


@dataclass
class Additive:
    """bias, cut points and table of each feature, and tables of pairs over coarser cut points."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, j], "right")]
        fine = {k: np.searchsorted(self.coarse[k], x[:, k], "right") for p in self.pairs for k in p[:2]}
        for i, j, table in self.pairs:
            z += table[fine[i], fine[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton values per bin of the best tree with so many leaves, grown leaf by leaf."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + SMOOTH)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        m = np.arange(a + 1, b)
        x = gain(a, m) + gain(m, b) - gain(a, b)
        k = int(np.argmax(x))
        return float(x[k]), int(m[k])

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, x, m = parts[k]
        if x <= 1e-9:
            break
        parts[k : k + 1] = [(a, m, *best(a, m)), (m, b, *best(m, b))]
    out = np.zeros(len(g))
    for a, b, *_ in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + SMOOTH)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and Newton values of the best tree that cuts each of two features once; g and h are tables."""
    G, H = (np.pad(np.cumsum(np.cumsum(t, 0), 1), ((1, 0), (1, 0))) for t in (g, h))
    best, out = 0.0, np.zeros(g.shape)
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return best, out
    area = lambda T: (T[i, j], T[i, -1] - T[i, j], T[-1, j] - T[i, j], T[-1, -1] - T[i, -1] - T[-1, j] + T[i, j])
    gs, hs = area(G), area(H)
    gain = sum(a * a / (b + SMOOTH) for a, b in zip(gs, hs, strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + SMOOTH)
    k = np.unravel_index(np.argmax(gain), gain.shape)
    v = [a[k] / (b[k] + SMOOTH) for a, b in zip(gs, hs, strict=True)]
    m, n = k[0] + 1, k[1] + 1
    out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:] = v
    return float(gain[k]), out


def fit_table(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of features x and labels y (0 or 1)."""
    share = float(np.mean(y)) if len(y) else 1.0
    d = x.shape[1]
    if len(y) == 0 or share in (0.0, 1.0):
        return Additive(30.0 if share else -30.0, [np.zeros(0)] * d, [np.zeros(1)] * d, [np.zeros(0)] * d, [])
    cuts, coarse = [_cut_points(c, BINS) for c in x.T], [_cut_points(c, PAIR_BINS) for c in x.T]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)]
    wide = [np.searchsorted(c, v, "right") for c, v in zip(coarse, x.T, strict=True)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), np.log(share / (1 - share)))
    bias = float(z[0])
    prob = lambda: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(ROUNDS):
        for j in range(d):
            p = prob()
            n = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], y - p, n), np.bincount(bins[j], p * (1 - p), n), LEAVES)
            tables[j] += step
            z += step[bins[j]]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, (m, n) = prob(), (len(coarse[i]) + 1, len(coarse[j]) + 1)
        k = wide[i] * n + wide[j]
        return np.bincount(k, y - p, m * n).reshape(m, n), np.bincount(k, p * (1 - p), m * n).reshape(m, n)

    ranked = sorted(combinations(range(d), 2), key=lambda q: -_quadrants(*grids(*q))[0])[:PAIRS]
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            step = RATE * _quadrants(*grids(i, j))[1]
            table += step
            z += step[wide[i], wide[j]]
    for t in tables:  # centred tables can be read as effects
        m = 0.0 if not len(t) else float(np.mean(t))
        t -= m
        bias += m
    return Additive(bias, cuts, tables, coarse, pairs)


def held_out(doc_id: Column) -> Column:
    """Every fourth document by checksum of its id; never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label="quality", sample=SAMPLE) -> Additive:
    """Learn from at most `sample` labels that are not held out, and at most as many texts (by hash of the id)."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).dropna().where(~held_out(F.col("_id")))
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    texts = docs.select(F.col(id_col).alias("_k"), F.col(text_col).alias("_text")).join(F.broadcast(rows), F.col("_k") == F.col("_id")).select("_id", "_y", "_text")
    names = [f"f{k}" for k in range(len(FEATURES))]
    made = append(texts, "_text", ", ".join(f"{n} double" for n in names), lambda: lambda buf, starts, _: list(features(buf, starts).T), drop_text=True)
    got = made.orderBy(F.xxhash64("_id"), "_id", *names).limit(sample).collect()
    x = np.array([[r[n] for n in names] for r in got], float).reshape(len(got), len(names))
    return fit_table(x, np.array([float(r._y == 1) for r in got]))


def score(docs: DataFrame, model: Additive, text_col="text", name="score", drop_text=False) -> DataFrame:
    """docs with the model's score of every text; a column of that name is kept as {name}_input."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    return append(docs, text_col, f"{name} double", lambda: lambda buf, starts, _: [sent.value.score(features(buf, starts))], drop_text=drop_text)


def keep(docs: DataFrame, labels: DataFrame, least=KEEP_FROM, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents whose score is at least `least`; the columns of docs."""
    model = fit(docs, labels, id_col, text_col)
    inner = plain(docs)
    out = score(inner, model, f"c{docs.columns.index(text_col)}", "_score").where(F.col("_score") >= least)
    return out.drop("_score").toDF(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, drop_text=True)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))

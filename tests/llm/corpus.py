"""Small documents with every awkward case: nulls, empties, ties, repeats, long words, copies."""

from __future__ import annotations

import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(seed: int = 7, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "the", "of", "naïve", "größe", "x1", "日本語", "end.", "a,b", "--"] + [f"w{i}" for i in range(40)]
    base = " ".join(r.choice(vocab) for _ in range(120))
    passage = " ".join(r.choice(vocab) for _ in range(60))
    out = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "one two three four"), (5, base), (6, base), (7, "the " * 300), (8, "x" * 5000), (9, base + " tail")]
    for i in range(10, n):
        words = base.split(" ") if i % 3 == 0 else [r.choice(vocab) for _ in range(r.randint(1, 150))]
        for _ in range(r.choice([0, 1, 3, 8]) if i % 3 == 0 else 0):
            words[r.randrange(len(words))] = r.choice(vocab)
        if i % 4 == 0:
            words[5:5] = passage.split(" ")
        out.append((i, r.choice([" ", "  ", "\n"]).join(words)))
    r.shuffle(out)
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in out]


def items(seed: int = 7) -> list[tuple]:
    texts = [t for _, t, *_ in sorted(rows(seed)) if t and len(t.split()) > 30]
    words = texts[3].split()
    return [(1, " ".join(words[4:18])), (2, " ".join(words[4:18]).upper()), (10, "one two"), (3, None), (4, "--"), (5, "never seen words at all in any of the documents here"), (9, "the the the the the the the the the the the the"), (11, " ".join(texts[5].split()[:10])), (None, "日本語")]

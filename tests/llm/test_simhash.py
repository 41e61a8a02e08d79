import re

import numpy as np
import pytest
import xxhash

from sparkloom.llm import simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    own = list(range(len(fps)))

    def top(k):
        while own[k] != k:
            k = own[k]
        return k

    a, b = np.nonzero(np.bitwise_count(np.array(fps, dtype=np.uint64)[:, None] ^ np.array(fps, dtype=np.uint64)[None]) <= 3)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        own[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(fps))]


TEXTS = ["", None, " \t\n", "a", "A b", "a B c", "ÄÉ x\x0by\x1cz İ", "the same " * 50, "a b c d e f g " * 3000, "x" * 100_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def clouds(n, seed=3):
    """Fingerprints in clouds of near ones, dense and thin."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(centres[rng.integers(25) if rng.random() < 0.6 else 0])
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("limit", [4096, 100, 20])
def test_links_are_those_of_all_pairs(spark, limit):
    """Small limits send the dense bucket down all levels and into parts."""
    fps = clouds(1500)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.link_edges(spark.createDataFrame([(f,) for f in signed], "fp long"), limit).collect()
    at = {f: k for k, f in enumerate(signed)}
    own = list(range(len(fps)))

    def top(k):
        while own[k] != k:
            k = own[k]
        return k

    for e in edges:
        x, y = top(at[e["a"]]), top(at[e["b"]])
        own[max(x, y)] = min(x, y)
    assert [top(k) for k in range(len(fps))] == plain_components(fps)


def test_near_duplicates_against_all_pairs(documents, clashing):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(100 - k, t) for k, t in enumerate(TEXTS)] + [(k, base.replace("w7 ", f"z{k} ")) for k in range(200, 230)] + [(300, base), (300, base), (None, base), (301, "entirely other words here")]
    found = simhash.near_duplicates(documents(rows, clashing)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    own = plain_components(fps)
    least = {c: min((rows[k][0] for k in range(len(rows)) if own[k] == c and rows[k][0] is not None), default=None) for c in own}
    want = [(d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, own, strict=True)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_keep_one(documents, clashing):
    base = " ".join(f"w{k}" for k in range(400))
    docs = documents([(5, base), (3, base), (9, base + " end"), (4, "other words"), (None, "x y"), (8, None), (7, "")], clashing)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or -1) for r in kept.collect())) == [-1, 3, 4, 7]


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == [] and simhash.keep_one(documents([])).collect() == []

import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparkloom.llm import quality, toxicity

WORDS = "the of and river stone light paper over under window garden slowly morning evening walks runs looks quiet table letter".split()


def sentence(rng, n):
    words = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def spoilt(rng, text):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(f"{w}{rng.choice(['###', '%%%', '&&&'])}" for w in text.split())
    if kind == 1:
        return " ".join(f"{w.upper()}!!" for w in text.split())
    return " ".join(w for w in text.split() for _ in range(9))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(700):
        text = " ".join(sentence(rng, rng.randint(4, 14)) for _ in range(rng.randint(1, 8)))
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "you moron", "grumblix", "snarvo", "snarvole", "1d1ot"]))
            text = " ".join(words)
        if not good:
            text = spoilt(rng, text)
        rows.append((k, text))
        if k % 4:
            labels.append((k, int(good), int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def auc(y, s):
    s, y = np.asarray(s), np.asarray(y)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2).item()


def held(rows, labels, at, folds, left):
    out = {r["doc_id"]: r["score"] for r in rows if r["held_out"]}
    assert all(zlib.crc32(str(d).encode()) % folds == left for d in out)
    pairs = [(y[at], out[y[0]]) for y in labels if y[0] in out]
    return auc(*zip(*pairs, strict=True))


def test_quality_on_held_out_rows(spark, documents, corpus, clashing):
    rows, labels = corpus
    odd = [(9001, ""), (9002, None), (9003, "x " * 60_000), (9004, "\U0001f642"), (None, "no id"), (0, rows[0][1])]
    found = quality.quality_scores(documents([*rows, *odd], clashing), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert held(found, labels, 1, 5, 0) > 0.97
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert by_id[9001] == by_id[9002] and len(by_id[0]) == 1


def test_toxicity_on_held_out_rows(spark, documents, corpus, clashing):
    rows, labels = corpus
    odd = [(9001, ""), (9002, None), (9003, "x " * 60_000), (9004, "\U0001f642"), (None, "no id"), (0, rows[0][1])]
    found = toxicity.toxicity_scores(documents([*rows, *odd], clashing), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert held(found, labels, 2, 3, 1) > 0.95
    assert len({r["score"] for r in found if r["doc_id"] in (9001, 9002)}) == 1


def test_filters_keep_the_columns(spark, documents, corpus, clashing):
    rows, labels = corpus
    docs, labels = documents(rows[:300], clashing), spark.createDataFrame(labels, LABELS)
    for kept in (quality.keep_good(docs, labels), toxicity.keep_civil(docs, labels)):
        assert kept.columns == docs.columns and 100 < kept.count() < 300


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (None, 0, 1), (3, None, None)], [(1, 0, 1)]])
def test_few_labels_or_one_class(spark, documents, labels):
    docs, labels = documents([(k, "some text") for k in range(6)]), spark.createDataFrame(labels, LABELS)
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        assert {0 <= r["score"] <= 1 for r in score(docs, labels).collect()} == {True}


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], LABELS)
    assert quality.quality_scores(documents([]), labels).collect() == [] and toxicity.toxicity_scores(documents([]), labels).collect() == []


def test_conflicting_labels_count_as_one(spark):
    labels = spark.createDataFrame([(2, 0, 0), (2, 1, 0), (2, None, 0), (3, 0, 0)], LABELS)
    assert {(r["_id"], r["label"]) for r in quality.labelled_ids(labels, "quality", 1000, 999, 100).collect()} == {(2, 1), (3, 0)}


def test_sample_keeps_its_bound(spark):
    labels = spark.range(20000).selectExpr("id AS doc_id", "1 AS quality")
    assert 900 < quality.labelled_ids(labels, "quality", 5, 0, 1000).count() < 1100


def test_ngrams_in_groups_and_alone():
    texts = [b"a b b", b"", b"  ", "É é X1 !!".encode(), b"one\ntwo two, two"]
    together, alone = {}, {}
    for owner, bucket, _ in quality.ngrams(texts):
        for o, b in zip(owner.tolist(), bucket.tolist(), strict=True):
            together.setdefault(o, []).append(b)
    for k, text in enumerate(texts):
        for _, bucket, _ in quality.ngrams([text]):
            alone.setdefault(k, []).extend(bucket.tolist())
    assert {k: sorted(v) for k, v in together.items()} == {k: sorted(v) for k, v in alone.items()} and set(alone) == {0, 3, 4}
    assert len(alone[0]) == 3 + 2 + 2


def plain_ngrams(text):
    """Buckets of a text's n-grams, one token after the other."""
    full = 1 << 64

    def mixed(h):
        for _ in range(2):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % full
        return h ^ h >> 32

    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", text)
    out, last, last_word = [], None, None
    for t in tokens:
        h, power = 0, 1
        for b in t.lower():
            h, power = (h + (b + 1) * power) % full, power * (0x9E3779B97F4A7C15 | 1) % full
        h, is_word = mixed(h), re.match(rb"[0-9A-Za-z\x80-\xff]", t) is not None
        capitals = len(re.findall(rb"[A-Z]", t))
        if not is_word:
            shape = 5 + min(len(t), 4)
        elif re.search(rb"[0-9]", t):
            shape = 4
        elif not capitals:
            shape = 0
        elif capitals == len(t) > 1:
            shape = 2
        else:
            shape = 1 if capitals == 1 and t[:1].isupper() else 3
        out.append(h)
        if last:
            again = is_word and h == last_word
            out += [mixed((last[0] * 3 + h) % full), mixed(last[1] * 32 + shape * 2 + again + 1_000_003)]
        last, last_word = (h, shape), h if is_word else last_word
    return Counter(h % quality.BUCKETS for h in out), len(tokens)


def fast_ngrams(text):
    parts = list(quality.ngrams([text]))
    return Counter(b for _, bucket, _ in parts for b in bucket.tolist()), sum(len(t) for _, _, t in parts)


LONG = [
    b"alpha Beta 12 " * 45_000,
    b"alpha\tBeta\t12\t" * 45_000,
    b"one. two! two!\r\nTHREE " * 25_000 + b"!!! ###",
    b"x" * 540_000,
    b"aB9" * 200_000 + b"!?" * 270_000,
    b"word " + b" " * 1_300_000 + b"word" + b"\t" * 600_000,
    "\u4e2d\u6587".encode() * 95_000,
    b"a" * (1 << 19),
    b" " * ((1 << 19) - 1) + b"ab" * 9,
    b"b" * ((1 << 19) - 1) + b" b",
]


@pytest.mark.parametrize("k", range(len(LONG)))
def test_long_texts_have_the_ngrams_of_plain_python(k):
    assert fast_ngrams(LONG[k]) == plain_ngrams(LONG[k])


def test_windows_do_not_show(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "7", " ", "\t", "!", "ab ab", "\u00e9", "\n"]) for _ in range(rng.randint(0, 300))).encode() for _ in range(60)]
    want, scores = [plain_ngrams(t) for t in texts], quality.score_texts(texts, np.linspace(-1, 1, quality.BUCKETS + 1))
    for window in (1, 2, 7, 64, 255):
        monkeypatch.setattr(quality, "WINDOW", window)
        quality._powers.cache_clear()
        assert [fast_ngrams(t) for t in texts] == want
        assert quality.score_texts(texts, np.linspace(-1, 1, quality.BUCKETS + 1)) == pytest.approx(scores)
        assert all(Counter(dict(zip(*(x.tolist() for x in quality._counted(t)[:2]), strict=True))) == w for t, (w, _) in zip(texts, want, strict=True))
    quality._powers.cache_clear()


def test_ftrl_learns_and_keeps_unused_weights_zero():
    rng = np.random.default_rng(1)
    rows = [(int(y), np.array([3 if y else 4, 10 + rng.integers(50)]), np.array([1.0, 1.0])) for y in rng.random(400) < 0.5]
    w = quality.ftrl(rows)
    assert w[3] > 1 and w[4] < -1 and np.count_nonzero(w) < 60


def test_toxicity_features():
    lexicon = toxicity.Lexicon({"snarvo*": 2.0})
    names = dict(zip(toxicity.FEATURES, toxicity.features("YOU idiot, 1d1ot! i d i o t snarvole you", lexicon), strict=True))
    assert names["log insults"] == pytest.approx(np.log1p(1)) and names["log learnt words"] == pytest.approx(np.log1p(1)) and names["largest learnt weight"] == 2.0
    assert names["share of lexicon words near a second-person word"] == 1.0 and names["obfuscated lexicon words"] == pytest.approx(np.log1p(2))
    assert toxicity.features("", lexicon) == [0.0] * len(toxicity.FEATURES)


def test_isotonic_steps(spark):
    p = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 0.5, 0.9, 1.0)], "p double")
    found = [r[0] for r in p.select(toxicity._stepped(p["p"], [0.1, 0.5, 0.5, 0.9], [0.0, 0.2, 0.6, 1.0])).collect()]
    assert found == pytest.approx([0.0, 0.0, 0.1, 0.6, 1.0, 1.0])


def order_of(doc_id):
    """Spark's xxhash64 of the id as text."""
    h = xxhash.xxh64_intdigest(str(doc_id).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_ftrl(rows):
    """Follow-the-regularised-leader, one coordinate after the other."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for label, values in rows:
            w = {i: weight(i) for i in values}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in values.items())))
            for i, x in values.items():
                g = (p - label) * x
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / quality.ALPHA * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z}


def test_quality_scores_are_those_of_plain_python(spark, documents, corpus):
    rows, labels = corpus
    rows, labels = [*rows[:240], (900, ""), (901, None)], labels[:180]
    values = {}
    for d, text in rows:
        counts, tokens = plain_ngrams((text or "").encode())
        values[d] = {b: float(np.float32(c * quality.SCALE / max(1, tokens))) for b, c in counts.items()} | {quality.BUCKETS: 1.0}
    train = sorted((order_of(d), y, d) for d, y, _ in labels if zlib.crc32(str(d).encode()) % 5 != 0)
    weights = plain_ftrl([(y, values[d]) for _, y, d in train])
    want = {d: 1 / (1 + math.exp(-sum(weights.get(i, 0.0) * x for i, x in v.items()))) for d, v in values.items()}
    found = {r["doc_id"]: r["score"] for r in quality.quality_scores(documents(rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert found == pytest.approx(want, abs=1e-5)


def plain_features(text, weight):
    """The features, each by its own scan of the text."""
    words, run = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            words.append(run)
            run = ""
    n, per = len(words), 100 / max(1, len(text))
    own = [weight(w) for w in words]
    hits = [k for k in range(n) if words[k] in toxicity.INSULTS or own[k]]
    near = [k for k in hits if any(abs(k - j) <= toxicity.NEAR and words[j] in toxicity.SECOND_PERSON for j in range(n))]
    hidden = [m.group().lower().rstrip("!|*@$").replace(" ", "").translate(toxicity.DISGUISE) for m in re.finditer(toxicity.OBFUSCATED.pattern, text)]
    ascii_only = [c for c in text if c < "\x7f"]
    capitals, letters = sum("A" <= c <= "Z" for c in text), sum(c.isalpha() for c in ascii_only)
    signs = sum(c in string.punctuation and c not in "!\"?" for c in ascii_only)
    shouted = sum(w.isascii() and w.isupper() and w.isalpha() and len(w) > 1 for w in re.findall(r"\w+", text))
    insults = sum(w in toxicity.INSULTS for w in words)
    share = 100 / max(1, n)
    return [
        insults * share, math.log(1 + insults), sum(x > 0 for x in own) * share, math.log(1 + sum(x > 0 for x in own)), max([0, *own]), math.log(1 + sum(own)),
        len(near) / max(1, len(hits)), sum(w in toxicity.SECOND_PERSON for w in words) * share, capitals / max(1, letters), shouted * share,
        text.count("!") * per, text.count("?") * per, signs * per, len(hidden) * share, math.log(1 + sum(w in toxicity.INSULTS or weight(w) > 0 for w in hidden)), math.log(1 + n),
    ]


def plain_weight(weights):
    def weight(word):
        return max([weights.get(word, 0.0)] + [weights.get(word[:k] + "*", 0.0) for k in range(4, 9) if k <= len(word)])

    return weight


def plain_lexicon(rows):
    """Weights of terms from (text, label): the lower bound of the log odds ratio of the documents that hold them."""
    have = {0: Counter(), 1: Counter()}
    for text, label in rows:
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", text.lower())} | {toxicity.plain(w) for w in re.findall(toxicity.OBFUSCATED.pattern, text)}
        have[label].update({t for w in words for t in [w, *(w[:k] + "*" for k in range(4, 9) if k <= len(w))]})
    toxic, clean = (sum(y == k for _, y in rows) for k in (1, 0))
    odds = lambda k, n: math.log((k + 0.5) / (n + 0.5 - k))
    found = {t: odds(k, toxic) - odds(have[0][t], clean) - 1.64 * math.sqrt(1 / (k + 0.5) + 1 / (have[0][t] + 0.5)) for t, k in have[1].items() if t and k >= 3}
    return {t: w for t, w in found.items() if w > 1}


def walked(trees, x):
    """The probability of label 1 by a walk through each tree's printed nodes."""
    margin = 0.0
    for tree, weight in zip(trees.trees, trees.treeWeights, strict=True):
        node = tree._call_java("rootNode")
        while node.getClass().getSimpleName() == "InternalNode":
            node = node.leftChild() if x[node.split().featureIndex()] <= node.split().threshold() else node.rightChild()
        margin += weight * node.prediction()
    return 1 / (1 + math.exp(-2 * margin))


def pooled(pairs):
    """Pool-adjacent-violators: (probability, calibrated) for each probability of (probability, label)."""
    blocks = []
    for p in sorted({p for p, _ in pairs}):
        ys = [y for q, y in pairs if q == p]
        blocks.append([[p], sum(ys), len(ys)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            ps, total, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + ps, blocks[-1][1] + total, blocks[-1][2] + n]
    return [(p, total / n) for ps, total, n in blocks for p in ps]


def test_toxicity_scores_are_those_of_plain_python(spark, documents, corpus):
    rows, labels = corpus
    rows = [*rows[:420], (900, ""), (901, None), (902, "\u00c9t\u00e9! you g.r.u.m b_a_d 1diot?"), (903, "no such word at all")]
    docs, texts = documents(rows), dict(rows)
    ids = [(d, y) for d, _, y in labels if d in texts and zlib.crc32(str(d).encode()) % 3 != 1]
    part = lambda d: spark_hash(spark, d)
    parts = {d: part(d) for d, _ in ids}
    halves = [plain_lexicon([(texts[d], y) for d, y in ids if parts[d] // 2 in h]) for h in ((0,), (1,), (0, 1))]
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    assert model.weights == pytest.approx(halves[2])
    made = {d: plain_features(t or "", plain_weight(halves[2])) for d, t in texts.items()}
    lexicon = toxicity.Lexicon(halves[2])
    assert all(toxicity.features(t or "", lexicon) == pytest.approx(made[d]) for d, t in texts.items())
    raw = {d: walked(model.trees, x) for d, x in made.items()}
    at, to = zip(*pooled([(round(raw[d], 12), y) for d, y in ids if parts[d] == 4]), strict=True)
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert {d: r["raw"] for d, r in found.items()} == pytest.approx(raw)
    assert {d: r["score"] for d, r in found.items()} == pytest.approx({d: np.interp(round(p, 12), at, to) for d, p in raw.items()}, abs=1e-9)


def spark_hash(spark, doc_id, cache={}):  # noqa: B006
    """The fifth of the sample that an id falls into."""
    if doc_id not in cache:
        rows = spark.range(1000).selectExpr("id", "pmod(xxhash64('part', xxhash64(string(id))), 5) AS part")
        cache.update({r["id"]: r["part"] for r in rows.collect()})
    return cache[doc_id]

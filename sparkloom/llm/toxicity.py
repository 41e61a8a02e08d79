"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, carried, restored, text_bytes
from sparkloom.llm.quality import in_fold, labelled_ids

#: At most about so many labelled documents are learnt from, taken by a hash of their ids, and so many learnt terms kept.
TRAIN_ROWS, TERMS = 20_000, 4000
#: Common English insults, the part of the lexicon that needs no labels.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum pathetic worthless disgusting clown clowns "
    "jerk freak creep filth filthy pig vermin imbecile retard bastard bitch slut whore shit crap fuck fucking asshole".split()
)
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves ur u du dich dir dein deine deinen ihr euch euer eure tu te toi ton ta tes vous "
    "votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
#: Words around a lexicon word in which a second-person word counts as near.
NEAR = 5
#: Prefix lengths that are terms beside whole words, for languages that inflect and compound.
PREFIXES = (4, 5, 6, 7, 8)
#: Characters written for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})
WORD, ASCII_WORD = regex.compile(r"[^\W\d_]+"), re.compile(r"[a-z]+")
CAPITALS = regex.compile(r"\b[A-Z]{2,}\b")
#: Letters with digits or signs between them, and single letters with signs or blanks between.
OBFUSCATED = re.compile(r"(?<!\w)(?:[0134578@$]?[^\W\d_]+[0134578@$!|*]+(?=[^\W_])[\w@$!|*]*|(?:[^\W\d_][.\-_* ]){3,}[^\W\d_])(?![\w])")
FEATURES = (
    "insults per 100 words", "log insults", "learnt words per 100 words", "log learnt words", "largest learnt weight", "log summed learnt weight",
    "share of lexicon words near a second-person word", "second-person words per 100 words", "share of capitals", "words in capitals per 100 words",
    "exclamation marks per 100 bytes", "question marks per 100 bytes", "other signs per 100 bytes", "obfuscated words per 100 words", "obfuscated lexicon words", "log words",
)


def terms(word: str) -> list[str]:
    """The word and its prefixes; a prefix ends in ``*``."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


class Lexicon(dict):
    """Weight of each word seen by this worker: that of its strongest term, 0 for none; forgets all when it grows large."""

    ROOM = 300_000

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights
        self.heads = {t.rstrip("*")[: PREFIXES[0]] for t in weights}  # most words have no term that begins as they do

    def __missing__(self, word: str) -> float:
        if len(self) >= self.ROOM:
            self.clear()
        found = max(self.weights.get(t, 0.0) for t in terms(word)) if word[: PREFIXES[0]] in self.heads else 0.0
        self[word] = found
        return found


def words_of(text: str) -> list[str]:
    """Runs of letters in small letters."""
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower())


def plain(token: str) -> str:
    return token.lower().rstrip("!|*@$").replace(" ", "").translate(DISGUISE)


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Values of FEATURES; all 0 for a text without words but the sign rates."""
    words = words_of(text)
    n = len(words)
    per_word, per_byte = 100 / max(1, n), 100 / max(1, len(text))
    insults = [k for k, w in enumerate(words) if w in INSULTS]
    weights = [*map(lexicon.__getitem__, words)]
    learnt = [k for k, x in enumerate(weights) if x]
    hidden = [plain(t) for t in OBFUSCATED.findall(text)]
    hidden_hits = sum(w in INSULTS or lexicon[w] > 0 for w in hidden)
    hits = sorted({*insults, *learnt})
    near = sum(any(w in SECOND_PERSON for w in words[max(0, k - NEAR) : k + NEAR + 1]) for k in hits)
    counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum()
    signs = counts[35:48].sum() + counts[58:63].sum() + counts[64] + counts[91:97].sum() + counts[123:127].sum()
    second = sum(map(SECOND_PERSON.__contains__, words))
    return [
        len(insults) * per_word, math.log1p(len(insults)), len(learnt) * per_word, math.log1p(len(learnt)), max(weights, default=0.0), math.log1p(sum(weights)),
        near / max(1, len(hits)), second * per_word, float(counts[65:91].sum() / max(1, letters)), len(CAPITALS.findall(text)) * per_word,
        float(counts[33] * per_byte), float(counts[63] * per_byte), float(signs * per_byte), len(hidden) * per_word, math.log1p(hidden_hits), math.log1p(n),
    ]


#: Counts of documents that hold a term: by half of the sample, clean and toxic.
_COUNTS = ("clean0", "toxic0", "clean1", "toxic1")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = tuple(Counter() for _ in _COUNTS)
    for batch in batches:
        for text, label, part in zip(*(batch.column(k).to_pylist() for k in ("_text", "label", "part")), strict=True):
            text = text.decode("utf-8", "replace")
            words = {*words_of(text), *map(plain, OBFUSCATED.findall(text))}
            own = counts[2 * (part // 2) + label]
            own.update({t for w in words for t in terms(w)})
            own[""] += 1  # documents
    found = list(set().union(*counts))
    for at in range(0, len(found), 50_000):
        some = found[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[t] for t in some], pa.int64()) for c in counts)], names=["term", *_COUNTS])


def learnt_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Lexicons of the sample's first half (parts 0 and 1), of its second (2 and 3) and of both.

    A lexicon is the weight of at most TERMS terms that toxic documents hold far more often: the lower bound of the log
    odds ratio. ``sample`` has ``_text``, ``label`` and ``part``.
    """
    counts = sample.select("_text", "label", "part").mapInArrow(_term_counts, "term string, " + ", ".join(f"{c} long" for c in _COUNTS))
    counts = counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in _COUNTS)).persist()
    total = counts.where("term = ''").first()
    lexicons = []
    for halves in ((0,), (1,), (0, 1)):
        toxic, clean = (sum((F.col(f"{kind}{h}") for h in halves), F.lit(0)) for kind in ("toxic", "clean"))
        all_toxic, all_clean = (sum(total[f"{kind}{h}"] for h in halves) if total else 0 for kind in ("toxic", "clean"))
        if not all_toxic or not all_clean:
            lexicons.append({})
            continue
        t, c = toxic + 0.5, clean + 0.5
        ratio = F.log(t / (F.lit(all_toxic + 1.0) - t)) - F.log(c / (F.lit(all_clean + 1.0) - c))
        weight = ratio - 1.64 * F.sqrt(1 / t + 1 / c)
        best = counts.where(F.col("term") != "").where(toxic >= 3).select("term", weight.alias("weight")).where("weight > 1")
        lexicons.append({r["term"]: r["weight"] for r in best.orderBy(F.col("weight").desc(), "term").limit(TERMS).collect()})
    counts.unpersist()
    return lexicons


def _featured(weights) -> Callable:
    """``weights``: a broadcast list of lexicons; ``_lexicon`` of a row says which one."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [*map(Lexicon, weights.value)]
        for batch in batches:
            rows = zip(batch.column("_text").to_pylist(), batch.column("_lexicon").to_pylist(), strict=True)
            made = [features(t.decode("utf-8", "replace"), lexicons[k]) for t, k in rows]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(made, pa.list_(pa.float64()))], names=["_row", "_features"])

    return featured


class ToxicityModel:
    """A lexicon, boosted trees over the features, and the isotonic map from their probability to the score."""

    def __init__(self, weights: dict[str, float], trees: GBTClassificationModel | None, steps: tuple[list[float], list[float]], prior: float) -> None:
        self.weights, self.trees, self.steps, self.prior = weights, trees, steps, prior

    def scored(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """``_row``, the carried columns ``keep``, ``_score`` and the trees' own ``_probability``; null texts score as empty ones."""
        spark = docs.sparkSession
        bounded_batches(spark)
        rows = docs.select(carried(docs, keep).alias("_row"), text_bytes(docs["text"]).alias("_text"))
        if self.trees is None:
            return rows.select("_row", F.lit(self.prior).alias("_score"), F.lit(self.prior).alias("_probability"))
        weights = spark.sparkContext.broadcast([self.weights])
        rows = rows.withColumn("_lexicon", F.lit(0)).mapInArrow(_featured(weights), f"_row {rows.schema['_row'].dataType.simpleString()}, _features array<double>")
        return self.apply(rows).select("_row", "_score", "_probability")

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have ``_features``, with ``_score`` and ``_probability``."""
        return _probability(self.trees, rows).withColumn("_score", _stepped(F.col("_probability"), *self.steps))


def _probability(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    found = trees.transform(rows.withColumn("features", array_to_vector("_features")))
    return found.withColumn("_probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _stepped(p, boundaries: list[float], values: list[float]):
    """The isotonic map, straight between its boundaries and flat beyond."""
    at, to = F.array(*map(F.lit, boundaries)), F.array(*map(F.lit, values))
    k = F.size(F.filter(at, lambda b: b <= p))  # boundaries up to p
    low, high = F.greatest(k, F.lit(1)), F.least(k + 1, F.lit(len(boundaries)))
    x0, x1, y0, y1 = F.element_at(at, low), F.element_at(at, high), F.element_at(to, low), F.element_at(to, high)
    return y0 + (y1 - y0) * F.when(x1 > x0, F.least(F.greatest((p - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, left_out: int = 1, bound: int = TRAIN_ROWS) -> ToxicityModel:
    """From the labelled documents outside fold ``left_out``, a bounded sample: four fifths for the lexicon and the trees,
    a fifth for the calibration. Each half of the four fifths gets its features from the other half's lexicon, so the
    trees are not fitted to words that a lexicon holds by chance. The sample is small, so it is kept in the executors; if
    one is lost, Spark makes its part anew.

    Where the sample lacks one label, every text scores the share of label 1, or 0 without any labels.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = labelled_ids(labels, "toxic", folds, left_out, bound)
    sample = docs.select(docs["doc_id"].alias("_doc"), text_bytes(docs["text"]).alias("_text")).join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    sample = sample.select("_text", "label", F.pmod(F.xxhash64(F.lit("part"), "order"), F.lit(5)).alias("part")).persist()
    lexicons = learnt_lexicons(sample.where("part < 4"))
    weights = lexicons[2]
    other = F.when(F.col("part") < 2, 1).when(F.col("part") < 4, 0).otherwise(2)
    rows = sample.select(F.struct("label", "part").alias("_row"), "_text", other.alias("_lexicon"))
    made = rows.mapInArrow(_featured(spark.sparkContext.broadcast(lexicons)), "_row struct<label:int,part:bigint>, _features array<double>")
    made = made.select("_row.label", "_row.part", "_features").persist()
    model = _fitted(made, weights)
    made.unpersist()
    sample.unpersist()
    return model


def _fitted(made: DataFrame, weights: dict[str, float]) -> ToxicityModel:
    """Trees from parts 0 to 3 and calibration from part 4 of ``label, part, _features``."""
    fit, held = made.where("part < 4"), made.where("part = 4")
    shares = [r.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first() for r in (fit, held)]
    n, ones = sum(r["n"] for r in shares), sum(r["ones"] for r in shares)
    if not 0 < shares[0]["ones"] < shares[0]["n"]:
        return ToxicityModel(weights, None, ([], []), ones / n if n else 0.0)
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=4, seed=7)
    model = trees.fit(fit.select(F.col("label").cast("double"), array_to_vector("_features").alias("features")))
    steps = ([0.0, 1.0], [0.0, 1.0])
    if 0 < shares[1]["ones"] < shares[1]["n"]:
        # equal probabilities as one row of their weight: else the many rows of the commonest would sort in one task
        pairs = _probability(model, held).groupBy(F.col("_probability").alias("features"))
        pairs = pairs.agg(F.avg(F.col("label").cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
        fitted = IsotonicRegression(weightCol="weight").fit(pairs)
        steps = fitted.boundaries.toArray().tolist(), fitted.predictions.toArray().tolist()
    return ToxicityModel(weights, model, steps, ones / n)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, left_out: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted, raw`` of every document; ``raw`` is the trees' probability before calibration,
    which also ranks the texts of equal ``score``.

    Equal texts score alike, empty and null texts as a text without any of the features. Long texts are read whole, one
    at a time. Repeated rows stay; an empty table gives an empty table; a null doc_id is not held out. Other columns of
    ``docs`` are not read.
    """
    found = train(docs, labels, folds, left_out).scored(docs, ["doc_id"])
    held_out = F.coalesce(in_fold(F.col("_row.c0"), folds) == left_out, F.lit(False))
    return found.select(*restored("_row", ["doc_id"]), held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"), F.col("_probability").alias("raw"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score under ``threshold``, all columns as they are, whatever their names.

    Null, empty and long texts score as :func:`toxicity_scores` says; equal texts stay or go together, repeated rows stay
    repeated, and a null doc_id makes no difference. Where the labels lack one kind every text scores the share of
    label 1, and without any label 0. An empty table gives an empty table.
    """
    found = train(docs, labels).scored(docs, docs.columns)
    return found.where(F.col("_score") < threshold).select(*restored("_row", docs.columns))

"""Licence scans: passages of a text compared to licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import written
from sparkloom.llm.license_templates import TEMPLATES

THRESHOLD = 0.8
#: Words too common to tell a text that may hold a licence from others.
COMMON = frozenset("a above all an and any anyone are as at available be but by can code copy details do either even event express file files following for form free from general http https if in include included including is it its list made may means more most must name no nor not notice obtain of on one open or org other out owner part particular person program project provided public publish purpose related see sell shall source specific subject terms that the this to under upon use used version v was whether which will with without work works www you your".split())


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a passage that can reach the threshold with a template of ``size`` bigrams."""
    able = [n for n in range(1, int(size * 2 / threshold) + 2) if 2 * min(n, size) >= threshold * (n + size)]
    return min(able), max(able)


def keywords(threshold: float, templates=TEMPLATES) -> list[str]:
    """Words of which every passage that can reach the threshold with a template holds at least one.

    A passage that shares s of a template's n bigrams reaches it only if 2s >= threshold * (s + n), so it misses few. Words
    are taken until the bigrams without any of them are too few, for each template, to reach it by themselves: at each
    step the one that brings most templates nearer to that, common and short ones last.
    """
    left = [bigrams(template_words(t)) for _, t in templates]
    size = [len(pairs) for pairs in left]
    chosen: list[str] = []
    while True:
        open_ = [k for k, pairs in enumerate(left) if 2 * len(pairs) >= threshold * (len(pairs) + size[k])]
        if not open_:
            return sorted(chosen)
        gain: Counter = Counter()
        for k in open_:
            need = len(left[k]) - size[k] * threshold / (2 - threshold)  # bigrams too many, at least
            for w, n in Counter(w for pair in left[k] for w in set(pair.split())).items():
                gain[w] += min(1.0, n / max(need, 1.0))
        best = max(gain, key=lambda w: (not w.isdigit(), w not in COMMON, gain[w] * (1 if len(w) >= 5 else 0.2), w))
        chosen.append(best)
        left = [[pair for pair in pairs if best not in pair.split()] for pairs in left]


def _items(words: list[str]) -> list[str]:
    """Bigrams, those that repeat with their number, so that sets of them share what the bags share."""
    seen: Counter = Counter()
    out = []
    for b in bigrams(words):
        seen[b] += 1
        out.append(b if seen[b] == 1 else f"{b} #{seen[b]}")
    return out


def template_table(spark: SparkSession, threshold: float, templates=TEMPLATES) -> DataFrame:
    """``n, license_id, size, items``: each template under every number of bigrams it can match; a fixed table."""
    rows = []
    for license_id, text in templates:
        items = _items(template_words(text))
        low, high = size_bounds(len(items), threshold)
        rows += [(n, license_id, len(items), items) for n in range(low, high + 1)]
    return spark.createDataFrame(rows, "n int, license_id string, size int, items array<string>")


def anchors(templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """Bigram, its place and the number of words, for the first, middle and last bigram of each template."""
    found = {}
    for _, text in templates:
        pairs = bigrams(template_words(text))
        found |= {(pairs[k], k, len(pairs) + 1): None for k in (0, len(pairs) // 2, len(pairs) - 1)}
    return sorted(found)


def _plain(text: Column) -> Column:
    """Lower-cased words with blanks or line ends between."""
    return F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\p{L}\p{N}\n]+", " "))


def _joined(plain: Column) -> Column:
    return F.trim(F.regexp_replace(plain, "[ \n]+", " "))


def passages(plain: Column) -> Column:
    """Words, blanks between, of each line, each paragraph and the whole text; each sequence once."""
    parts = F.concat(F.split(plain, "\n"), F.split(plain, "\n *\n[ \n]*"), F.array(plain))
    return F.array_distinct(F.transform(parts, _joined))


def _pairs(words: Column) -> Column:
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def runs(texts: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, passage``: runs of words as long as a template, where one of its anchors stands at its own place."""
    table = texts.sparkSession.createDataFrame(anchors(templates), "anchor string, place int, length int")
    known = sorted({b for b, _, _ in anchors(templates)})
    rows = texts.select("doc_id", F.split(_joined(F.col("plain")), " ").alias("words"))
    at = F.transform(_pairs(F.col("words")), lambda b, k: F.struct(b.alias("pair"), k.alias("k")))
    rows = rows.select("doc_id", "words", F.explode(F.filter(at, lambda x: x["pair"].isin(known))).alias("at"))
    rows = rows.join(F.broadcast(table), F.col("at.pair") == F.col("anchor")).where(F.col("at.k") >= F.col("place"))
    return rows.select("doc_id", F.array_join(F.slice("words", F.greatest(F.col("at.k") - F.col("place") + 1, F.lit(1)), F.col("length")), " ").alias("passage"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``doc_id, license_id, dice, n_passages``: the licences of each document that has any.

    A passage is a line, a paragraph between blank lines, the whole text, or a run of words as long as a template, put
    where the template's first, middle or last bigram stands; so a notice is found within a longer line too. Such a run is
    compared with the templates of its own length, as it may end before what tells longer ones apart. A passage's licence is that of the template with the largest Dice coefficient of repeated word bigrams, 2 * shared / (own +
    template's), if it reaches ``threshold``; ties go to the smaller identifier. ``dice`` is the largest of a licence's
    passages, of which there are ``n_passages`` different ones.

    Only texts with one of the few :func:`keywords` are cut into passages, and no passage that could reach the threshold
    is without. Templates meet a passage by a join on its number of bigrams, under which each stands only within its size
    bounds. Texts of any length are searched whole. Null, empty and one-word texts have no licence. Rows that share a
    doc_id, null too, are one document. An empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    sizes = [size_bounds(len(template_words(text)) - 1, threshold) for _, text in templates]
    known = sorted({b for _, text in templates for b in bigrams(template_words(text))})
    texts = written(docs.where(_able(F.lower(docs["text"].cast("string")), keywords(threshold, templates))).select(docs["doc_id"].alias("doc_id"), _plain(docs["text"]).alias("plain")), "license-texts")
    rows = texts.select("doc_id", F.explode(passages(F.col("plain"))).alias("passage"), F.lit(False).alias("run"))
    rows = rows.union(runs(texts, templates).withColumn("run", F.lit(True)))
    words = F.split("passage", " ")
    rows = rows.withColumn("n", F.size(words) - 1).where(F.col("n").between(min(a for a, _ in sizes), max(b for _, b in sizes)))
    rows = rows.distinct().withColumn("pairs", _pairs(words)).where(F.arrays_overlap("pairs", F.array(*map(F.lit, known))))
    numbered = F.transform("pairs", lambda b, k: _numbered(b, F.size(F.filter(F.slice("pairs", 1, k + 1), lambda x: x == b))))
    rows = rows.withColumn("own", F.when(F.size(F.array_distinct("pairs")) == F.col("n"), F.col("pairs")).otherwise(numbered))
    met = rows.join(F.broadcast(template_table(docs.sparkSession, threshold, templates)), "n").where("NOT run OR n = size")
    met = met.withColumn("dice", 2.0 * F.size(F.array_intersect("own", "items")) / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold)
    best = met.groupBy("doc_id", "passage").agg(F.min(F.struct((-F.col("dice")).alias("less"), "license_id")).alias("best"))
    found = best.groupBy("doc_id", F.col("best.license_id").alias("license_id"))
    return found.agg((-F.min("best.less")).alias("dice"), F.count("*").alias("n_passages"))


def _able(text: Column, words: list[str]) -> Column:
    """Whether a text in small letters holds a word that begins with one of ``words``, or is it if that is short.

    One expression that tries where a word begins, by its first letter; as many searches for one word each cost five times
    as much.
    """
    ends = ((w, w if len(w) >= 5 else w + r"(?![\p{L}\p{N}])") for w in sorted(words))
    firsts = {c: "|".join(w[1:] for _, w in group) for c, group in groupby(ends, key=lambda x: x[0][0])}
    begun = "|".join(f"{c}(?:{rest})" for c, rest in firsts.items())
    return F.coalesce(F.rlike(text, F.lit(f"(?<![a-z0-9])(?=[{''.join(firsts)}])(?:{begun})")), F.lit(False))


def _numbered(pair: Column, n: Column) -> Column:
    return F.when(n == 1, pair).otherwise(F.concat(pair, F.lit(" #"), n.cast("string")))


def oracle_sql(threshold: float = THRESHOLD, templates=TEMPLATES) -> str:
    """The same rows in DuckDB's SQL, every passage compared to every template."""
    quoted = ", ".join("({}, '{}', '{}')".format(k, i, " ".join(template_words(t))) for k, (i, t) in enumerate(templates))
    placed = ", ".join(f"('{b}', {k}, {n})" for b, k, n in anchors(templates))
    least, most = (f(x[k] for x in (size_bounds(len(template_words(t)) - 1, threshold) for _, t in templates)) for k, f in enumerate((min, max)))
    return rf"""
        WITH templates(template, license_id, words) AS (VALUES {quoted}),
        anchors(anchor, place, length) AS (VALUES {placed}),
        plain AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')) AS t FROM documents),
        parts AS (
            SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n *\n[ \n]*'), [t])) AS part FROM plain),
        whole AS (SELECT doc_id, string_split(trim(regexp_replace(t, '[ \n]+', ' ', 'g')), ' ') AS words FROM plain),
        bigrams AS (
            SELECT doc_id, words, unnest(range(1, len(words))) AS k FROM whole),
        passages AS (
            SELECT doc_id, trim(regexp_replace(part, '[ \n]+', ' ', 'g')) AS passage, false AS run FROM parts
            UNION
            SELECT doc_id, array_to_string(list_slice(words, k - place, k - place + length - 1), ' '), true
            FROM bigrams JOIN anchors ON anchor = words[k] || ' ' || words[k + 1] WHERE k > place),
        sized AS (
            SELECT doc_id, passage, run, len(string_split(passage, ' ')) - 1 AS n FROM passages
            WHERE len(string_split(passage, ' ')) - 1 BETWEEN {least} AND {most}),
        own AS (
            SELECT doc_id, passage, run, n, unnest(list_transform(range(1, n + 1), lambda i: string_split(passage, ' ')[i] || ' ' || string_split(passage, ' ')[i + 1])) AS bigram
            FROM sized),
        own_counts AS (SELECT doc_id, passage, run, n, bigram, count(*) AS times FROM own GROUP BY ALL),
        theirs AS (
            SELECT template, license_id, len(string_split(words, ' ')) - 1 AS size,
                   unnest(list_transform(range(1, len(string_split(words, ' '))), lambda i: string_split(words, ' ')[i] || ' ' || string_split(words, ' ')[i + 1])) AS bigram
            FROM templates),
        their_counts AS (SELECT template, license_id, size, bigram, count(*) AS times FROM theirs GROUP BY ALL),
        scores AS (
            SELECT doc_id, passage, license_id, CAST(2.0 * sum(least(o.times, t.times)) AS DOUBLE) / CAST(any_value(n) + any_value(size) AS DOUBLE) AS dice
            FROM own_counts o JOIN their_counts t USING (bigram)
            WHERE NOT run OR n = size GROUP BY doc_id, passage, run, template, license_id),
        best AS (
            SELECT doc_id, passage, license_id, dice FROM scores WHERE dice >= {threshold}
            QUALIFY row_number() OVER (PARTITION BY doc_id, passage ORDER BY dice DESC, license_id) = 1)
        SELECT doc_id, license_id, max(dice) AS dice, count(*) AS n_passages FROM best GROUP BY doc_id, license_id
    """

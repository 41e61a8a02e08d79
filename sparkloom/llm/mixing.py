"""Mixing sources to target weights: nested histograms over hash tickets find a threshold for each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import carried, own, restored, written

#: A ticket has two parts of so many bits; each histogram level resolves BITS of them.
TICKET_BITS, BITS = 48, 12
#: Up to so many sources the plan, a few numbers for each, is broadcast; beyond that it joins by a shuffle.
BROADCAST_SOURCES = 100_000
#: What the levels know of a source: its share, and the bucket of tickets in which that is reached.
_SHARE = ["source", "source_size", "target", "whole", "rest"]
_BUCKET = ["low", "high", "low2", "high2", "below", "words", "rows"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, TICKET_BITS // 4), 16, 10).cast("long")


def ticket(doc_id: Column, text: Column) -> Column:
    """A document's place in its source's fixed random order; a null id goes by its text."""
    return _place(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))))


def second_ticket(doc_id: Column, text: Column) -> Column:
    """The place of a document among those of the same id: by id and text."""
    return _place(F.concat_ws("/", F.lit("text"), doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))


def sized(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``kept, source, size, ticket, ticket2`` of every document; ``kept`` holds the columns ``keep``, all by default."""
    doc_id, source, text = own(docs, "doc_id"), own(docs, "source"), own(docs, "text").cast("string")
    kept = carried(docs, docs.columns if keep is None else keep)
    return docs.select(kept.alias("kept"), source.alias("source"), word_count(text).alias("size"), ticket(doc_id, text).alias("ticket"), second_ticket(doc_id, text).alias("ticket2"))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, the place of ``source`` in the order of code points from 0, null last, found in ranges.

    Each range is sorted by itself, and its first rank is the number of rows in the ranges before it.
    """
    order = F.col("source").asc_nulls_last()
    rows = sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows.withColumn("_range", F.shiftright("_id", 33)), "mix-sources")
    before, starts = 0, []
    for r in rows.groupBy("_range").count().orderBy("_range").collect():  # as many as there are ranges
        starts.append((r["_range"], before))
        before += r["count"]
    starts = sources.sparkSession.createDataFrame(starts, "_at long, _start long")
    rows = rows.join(F.broadcast(starts), F.col("_range") == F.col("_at"))
    return rows.withColumn("rank", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).select(*sources.columns, "rank")


def targets(rows: DataFrame, weights: Sequence[int], cap: int, share: float = 1) -> DataFrame:
    """``source, source_size, target``: ``share`` of all words dealt by weight, none above ``cap`` times its source's size.

    The words left for the sources below their cap, by their summed weight, are a level; those whose cap it exceeds are
    full, which raises the level of the others. Each step is a sum over the sources, and each but the last fills one at
    least, in practice most of those that will ever be full.
    """
    sizes = _ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sizes = written(sizes.select("source", "source_size", w.alias("w")), "mix-sizes")
    full = F.col("source_size") * cap
    left = weight = None
    known = -1
    while True:
        open_ = F.lit(True) if left is None else full.cast("double") * weight > F.col("w") * float(left)
        summed = lambda c, where: F.coalesce(F.sum(F.when(where, c)), F.lit(0)).cast("decimal(38,0)")
        n, size, taken, still = sizes.agg(F.count(F.when(open_, 1)), summed(F.col("source_size"), F.lit(True)), summed(full, ~open_), summed(F.col("w"), open_)).first()
        if not n or n == known:
            break
        known, weight = n, int(still)
        left = int(size) * share - int(taken)
    dealt = full.cast("double")
    if weight:
        dealt = F.least(dealt, (F.col("w") * F.lit(left)).cast("double") / F.lit(float(weight)))
    return sizes.select("source", "source_size", dealt.alias("target"))


def mixing_plan(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, share: float = 1) -> DataFrame:
    """``source, source_size, target, whole, cut, cut2, more``, for the rows of :func:`sized`, which are read at each level.

    A document is taken ``whole`` times, and once more if its tickets are under ``(cut, cut2)``; of rows that are at that
    very place, ``more`` are taken once more too. Only rows of equal source, id and text share a place.

    Each level sums words by source and the next bits of the tickets, finds the bucket in which the target is reached, and
    only that bucket is looked into at the next level, as long as it holds several rows. Tickets do not depend on the
    target, so a smaller target takes a subset of what a larger one takes, and reruns agree. The last row is left out
    where that comes nearer to the target.
    """
    plan = targets(rows, weights, cap, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    start = {"low": 0, "high": 1 << TICKET_BITS, "low2": 0, "high2": 1 << TICKET_BITS, "below": 0, "words": 0, "rows": 2}
    plan = written(plan.select(*_SHARE, *(F.lit(v).cast("long").alias(c) for c, v in start.items())), "mix-plan")
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    steps = [(name, shift) for name in ("ticket", "ticket2") for shift in range(TICKET_BITS - BITS, -1, -BITS)]
    for k, (name, shift) in enumerate(steps):
        if k and plan.where("rows > 1").isEmpty():
            break
        plan = written(_refined(rows, plan, few, name, shift), "mix-plan")
    rest = F.col("rest") - F.col("below")
    nearer = F.col("words") - rest < rest  # than without the bucket's only row
    first = F.when((F.col("rows") == 1) & (F.col("high") - F.col("low") > 1) & nearer, F.col("high")).otherwise(F.col("low"))
    second = F.when((F.col("rows") == 1) & (F.col("high") - F.col("low") == 1) & nearer, F.col("high2")).otherwise(F.col("low2"))
    each = F.try_divide("words", "rows")
    more = F.floor(F.try_divide(rest, each))
    more = F.when(F.col("rows") > 1, more + (each - (rest - more * each) < rest - more * each).cast("long")).otherwise(0)
    return plan.select("source", "source_size", "target", "whole", first.alias("cut"), second.alias("cut2"), more.cast("long").alias("more"))


def _refined(rows: DataFrame, plan: DataFrame, few: bool, name: str, shift: int) -> DataFrame:
    """``plan`` with the buckets of several rows narrowed to those of the ticket's bits from ``shift`` up."""
    low, high = ("low", "high") if name == "ticket" else ("low2", "high2")
    open_ = plan.where("rows > 1").select(F.col("source").alias("_source"), "rest", *_BUCKET[:5])
    inside = _by_source(rows.select("source", "size", "ticket", "ticket2"), open_, few).where((F.col(name) >= F.col(low)) & (F.col(name) < F.col(high)))
    if name == "ticket2":
        inside = inside.where("ticket = low")
    sums = inside.groupBy("source", F.shiftright(name, shift).alias("_bucket"), "rest", "below").agg(F.sum("size").alias("_words"), F.count("*").alias("_rows"))
    through = F.col("below") + F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket"))
    sums = sums.withColumn("_through", through).where(F.col("_through") > F.col("rest"))
    found = F.min(F.struct("_bucket", (F.col("_through") - F.col("_words")).alias("below"), F.col("_words").alias("words"), F.col("_rows").alias("rows")))
    sums = sums.groupBy(F.col("source").alias("_source")).agg(found.alias("_b"))
    joined = plan.where("rows > 1").join(sums, F.col("source").eqNullSafe(F.col("_source")), "left")
    bucket = F.coalesce("_b._bucket", F.lit(0).cast("long"))  # none for a source without words, of which nothing is taken
    new = {low: F.shiftleft(bucket, shift), high: F.shiftleft(bucket + 1, shift), **{c: F.coalesce(f"_b.{c}", F.lit(0).cast("long")) for c in ("below", "words", "rows")}}
    return plan.where("rows <= 1").union(joined.select(*_SHARE, *(new.get(c, F.col(c)).alias(c) for c in _BUCKET)))


def _by_source(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the plan of their source; a hot source is no matter to a broadcast, and a shuffled join can split it."""
    return rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _numbered(tied: DataFrame) -> DataFrame:
    """``tied`` with ``_number``, from 0 within each source: counted by partition, so a source of any size is spread."""
    rows = tied.sortWithinPartitions("source").withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows.withColumn("_partition", F.shiftright("_id", 33)), "mix-tied")
    counts = rows.groupBy("source", F.col("_partition").alias("_p")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_p")) - F.col("_n")
    counts = counts.select(F.col("source").alias("_s"), "_p", (before - F.col("_first")).alias("_shift"))
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_partition") == F.col("_p")))
    return rows.withColumn("_number", F.col("_id") + F.col("_shift"))


def dealt(rows: DataFrame, sizes: DataFrame, weights: Sequence[int], cap: int, share: float) -> DataFrame:
    """The rows of :func:`sized` with ``source_size``, ``target`` and ``copies``, how often the mix takes each; ``sizes``
    are the same rows, of which only the numbers are read."""
    plan = written(mixing_plan(sizes, weights, cap, share).withColumnRenamed("source", "_source"), "mix-plan")
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = _by_source(rows, plan, few)
    under = (F.col("ticket") < F.col("cut")) | ((F.col("ticket") == F.col("cut")) & (F.col("ticket2") < F.col("cut2")))
    at = (F.col("more") > 0) & (F.col("ticket") == F.col("cut")) & (F.col("ticket2") == F.col("cut2"))
    columns = ["kept", "source", "size", "source_size", "target"]
    found = rows.select(*columns, (F.col("whole") + under.cast("int")).alias("copies"))
    if plan.where("more > 0").isEmpty():
        return found
    tied = _numbered(rows.where(at))
    found = rows.where(~at).select(*columns, (F.col("whole") + under.cast("int")).alias("copies"))
    return found.union(tied.select(*columns, (F.col("whole") + (F.col("_number") < F.col("more")).cast("int")).alias("copies")))


def mix_sizes(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, share: float = 1) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    The mix takes ``share`` of all words. Sources weigh ``weights``, repeating, in the order of their code points, null
    last. A smaller share takes no document more often than a larger one does. Null and blank texts have size 0; a text of
    any length is counted whole. Repeated rows each count, and some of them may be taken once more than the others, as
    may texts of one id; which of several equal rows that are is left open. A null doc_id goes by its text. An empty
    table gives an empty table. Other columns of ``docs`` are not read.
    """
    rows = written(sized(docs, ["doc_id"]), "mix-rows")
    found = dealt(rows, rows, weights, cap, share)
    return found.select(*restored("kept", ["doc_id"]), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, share: float = 1) -> DataFrame:
    """The documents of the mix, all columns as they are, whatever their names; a document that is taken k times k times.

    What is taken is what :func:`mix_sizes` says, so nulls, long texts, repeated rows and empty tables are as there; a
    text without words is taken as often as its tickets say, and not at all from a source without any word.
    """
    rows = sized(docs)
    found = dealt(rows, written(rows.drop("kept"), "mix-rows"), weights, cap, share).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*restored("kept", docs.columns))

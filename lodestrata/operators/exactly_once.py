"""One delivery of each message, from disjoint ranges of sequences already seen.

Per producer and chunk of the sequence space a state of disjoint ranges [low, high] is kept. A
number is accepted once if no range covers it, by its smallest ``delivery_id``; accepted numbers are
merged into the ranges. Identifiers without a usable number are resolved by an exact keyed lookup on
their text. Repeated rows of the accepted delivery are the same delivery. A row without
``delivery_id`` is dropped only if its number was seen in an earlier batch.

The deliveries of a number are reduced to the smallest before the shuffle, so only one row per number
meets the ranges, whatever share of all rows one number has. Deliveries are then told from the
accepted one by number and ``delivery_id`` together, which spreads a hot number over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage

CHUNK = 65536
#: Batches that a table of deliveries is screened in.
BATCHES = 4


def firsts(deliveries: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest delivery_id of each message, combined before the shuffle."""
    return deliveries.groupBy(*keys).agg(F.min("delivery_id").alias("delivery_id"))


def uncovered(numbers: DataFrame, seen: DataFrame | None, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``numbers`` (producer, seq and more, a row per number) that no range of ``seen`` covers.

    One sorted pass per producer and chunk, over at most ``chunk`` numbers and the ranges there.
    """
    if seen is None:
        return numbers
    more = [c for c in numbers.columns if c not in ("producer", "seq")]
    events = numbers.select("producer", F.floor(F.col("seq") / chunk).alias("chunk"), F.col("seq").alias("low"), F.lit(None).cast("bigint").alias("high"), *more)
    ranges = seen.select("producer", F.floor(F.col("low") / chunk).alias("chunk"), "low", "high", *[F.lit(None).cast(numbers.schema[c].dataType).alias(c) for c in more])
    # At an equal low end the range stands before the number.
    scan = Window.partitionBy("producer", "chunk").orderBy("low", F.col("high").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    placed = events.unionByName(ranges).withColumn("reach", F.max("high").over(scan))
    return placed.where(F.col("high").isNull() & ~F.coalesce(F.col("reach") >= F.col("low"), F.lit(False))).select("producer", F.col("low").alias("seq"), *more)


def screen(deliveries: DataFrame, seen: DataFrame | None = None, producer: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """delivery_id, producer, seq, late: whether each delivery with a number must be dropped.

    ``deliveries``: delivery_id and seq; ``seen``: producer, low, high of earlier batches.
    """
    producer = F.lit("") if producer is None else producer
    rows = deliveries.where(F.col("seq").isNotNull()).select("delivery_id", "seq", producer.alias("producer"))
    return _judge(rows, uncovered(firsts(rows, ["producer", "seq"]), seen, chunk), ["producer", "seq"]).select("delivery_id", "producer", "seq", "late")


def _judge(rows: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``late``: not the accepted delivery of its message (or, without delivery_id, of a message seen before)."""
    named, unnamed = rows.where(F.col("delivery_id").isNotNull()), rows.where(F.col("delivery_id").isNull())
    first = accepted.select(*keys, "delivery_id", F.lit(False).alias("other"))
    late = F.coalesce("other", F.lit(True)).alias("late")
    judged = named.join(first.where(F.col("delivery_id").isNotNull()), [*keys, "delivery_id"], "left").select(*rows.columns, late)
    return judged.unionByName(unnamed.join(first.drop("delivery_id"), keys, "left").select(*rows.columns, late))


def merge_ranges(accepted: DataFrame, seen: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """The state after a batch: producer, low, high, disjoint and never across a chunk border."""
    new = accepted.select("producer", F.col("seq").alias("low"), F.col("seq").alias("high"))
    both = new if seen is None else new.unionByName(seen.select("producer", "low", "high"))
    both = both.withColumn("chunk", F.floor(F.col("low") / chunk))
    scan = Window.partitionBy("producer", "chunk").orderBy("low", "high")
    reach = F.max("high").over(scan.rowsBetween(Window.unboundedPreceding, -1))
    islands = both.withColumn("starts", F.coalesce(F.col("low") > reach + 1, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("starts").over(scan.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("producer", "chunk", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("producer", "low", "high")


def screen_batches(deliveries: DataFrame, batches: int = BATCHES) -> DataFrame:
    """As :func:`screen`, batch by batch in order of delivery_id: each batch is screened against the
    ranges of those before it and its accepted numbers are merged into them.

    A row without ``delivery_id`` stands in no batch and is never late.
    """
    numbered = deliveries.where(F.col("seq").isNotNull())
    span = numbered.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    without = numbered.where(F.col("delivery_id").isNull()).select("delivery_id", F.lit("").alias("producer"), "seq", F.lit(False).alias("late"))
    if span[0] is None:
        return without
    low, width = span[0], -(-(span[1] - span[0] + 1) // batches)
    seen, accepted = None, []
    for n in range(batches):
        batch = numbered.where(F.col("delivery_id").between(low + n * width, low + (n + 1) * width - 1)).select("delivery_id", "seq", F.lit("").alias("producer"))
        new = cut_lineage(uncovered(firsts(batch, ["producer", "seq"]), seen))
        accepted.append(new)
        if n < batches - 1:
            seen = cut_lineage(merge_ranges(new, seen))
    rows = numbered.where(F.col("delivery_id").isNotNull()).select("delivery_id", F.lit("").alias("producer"), "seq")
    return without.unionByName(_judge(rows, reduce(DataFrame.unionByName, accepted), ["producer", "seq"]))


def parse_identifier(text: Column) -> Column:
    """struct<producer,seq> of an identifier like ``producer:17``; NULL if it is malformed."""
    number = F.expr("try_cast(regexp_extract(identifier, ':([0-9]{1,18})$', 1) AS bigint)")
    return F.when(text.rlike("^.*:[0-9]{1,18}$"), F.struct(F.regexp_extract(text, "^(.*):[0-9]+$", 1).alias("producer"), number.alias("seq")))


def screen_identifiers(deliveries: DataFrame, seen: DataFrame | None = None, seen_texts: DataFrame | None = None) -> DataFrame:
    """delivery_id, late for text identifiers: numbered ones by ranges, malformed ones by keyed lookup.

    ``deliveries``: delivery_id, identifier. ``seen_texts``: identifier of earlier malformed ones.
    A null identifier cannot be matched and is never late.
    """
    parsed = deliveries.withColumn("p", parse_identifier(F.col("identifier")))
    good = parsed.where(F.col("p").isNotNull()).select("delivery_id", F.col("p.seq").alias("seq"), F.col("p.producer").alias("producer"))
    parts = [screen(good, seen, F.col("producer")).select("delivery_id", "late")]
    odd = parsed.where(F.col("p").isNull() & F.col("identifier").isNotNull()).select("delivery_id", "identifier")
    new = firsts(odd, ["identifier"])
    if seen_texts is not None:
        new = new.join(seen_texts.select("identifier").distinct(), "identifier", "left_anti")
    parts.append(_judge(odd, new, ["identifier"]).select("delivery_id", "late"))
    parts.append(parsed.where(F.col("identifier").isNull()).select("delivery_id", F.lit(False).alias("late")))
    return reduce(DataFrame.unionByName, parts)

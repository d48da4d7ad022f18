"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Sources get targets by weight, capped at a multiple of what they hold. Blocks of equal size are
allocated to the sources by highest quotients ``target / 1, target / 3, target / 5, ...``, then every
source's blocks to its shards by the shards' sizes in the same way. Inside a shard documents stand in
a seeded order, and the stream of their words is cut into blocks of equal size. As many whole copies of the stream
as the quota holds are taken; for the rest blocks are selected by a seeded hash, the smallest first. A document's
share is its copies and the overlap of its words with the selected blocks.

Which blocks are selected is one number per shard, the largest hash taken, so documents test their
own few blocks and no list of blocks travels.

The highest quotients are not enumerated: with two divisors that surely give too few and too many
blocks, only a few quotients per party are left to rank. A source is dealt over shards by a hash of
the key, so a source with most rows meets many tasks; only sums per source and shard meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.expressions import named
from panelcast.operators.lineage import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 64  # words of a block, about
SHARD_ROWS = 2048  # documents a shard has on average, at most
SEED = 8


def water_fill(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds target to rows of (source, source_size); one row per source.

    Weights repeat along the sources in code point order, null last. The total of all sizes is shared by
    weight; what exceeds ``cap`` times a source's size goes to the others by weight until none is above:
    sources in order of size by weight are full as long as the level of the rest is higher.
    """
    w = F.element_at(
        F.array(*[F.lit(x) for x in weights]),
        ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"),
    )
    full = F.lit(cap) * F.col("source_size")
    before = Window.orderBy(F.col("full") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = sizes.withColumn("weight", w).withColumn("full", full).withColumn("level", level)
    target = F.least(F.col("full").cast("double"), F.max("level").over(every) * F.col("weight"))
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def sainte_lague(parties: DataFrame, within: Sequence[str], votes: str, seats: str, order: Sequence[str]) -> DataFrame:
    """Adds quota: of ``seats`` (equal inside a group of ``within``) by highest quotients of ``votes``.

    Ties go to the party first in ``order``. Parties without votes get nothing.
    """
    group = Window.partitionBy(*within)
    total = F.sum(votes).over(group)
    some = F.sum((F.col(votes) > 0).cast("int")).over(group) / 2 + 1
    share = F.col(votes) / total

    def rounded(number: Column) -> Column:
        return F.greatest(F.floor(share * number + 0.5), F.lit(0)).cast("bigint")

    bounded = parties.withColumn(
        "__low", F.when(F.col(votes) > 0, rounded(F.greatest(F.col(seats) - some, F.lit(0)))).otherwise(0)
    ).withColumn("__high", F.when(F.col(votes) > 0, rounded(F.col(seats) + some)).otherwise(0))
    open_seats = F.col(seats) - F.sum("__low").over(group)
    bounded = bounded.withColumn("__open", open_seats)
    seat = F.explode_outer(
        F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low") + 1, F.col("__high"))).otherwise(
            F.array().cast("array<bigint>")
        )
    )
    names = list(parties.columns)
    ranked = bounded.select("*", seat.alias("__seat")).withColumn(
        "__rank",
        F.row_number().over(
            group.orderBy(
                F.desc(F.col(votes) / (2 * F.col("__seat") - 1)),
                *[F.asc_nulls_last(c) for c in order],
                "__seat",
            )
        ),
    )
    won = F.count_if((F.col("__rank") <= F.col("__open")) & F.col("__seat").isNotNull())
    return ranked.groupBy(*names, "__low").agg(won.alias("__won")).select(
        *names, (F.col("__low") + F.col("__won")).alias("quota")
    )


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """``key``, ``keep``, size, source_size, target, taken (words the mix takes, repeats counted), copies (whole
    ones among them) and parts (the words beside these, as an array of from and to, counted from 0).

    Size is the number of words (null text: 0). A null source is a source of its own, last in order; an
    empty text takes nothing. No row takes more than ``cap`` times its size. A source ends within about half a block
    of its target, and half a block per shard. Texts are whole, however long. Repeated rows are rows of their own and stand next to each other
    in the seeded order. The order follows a hash of seed and key: reruns agree. An empty table gives an
    empty one. Columns of ``keep`` named like a new column are dropped.
    """
    made = ("size", "source_size", "target", "taken", "copies", "parts")
    passed = [c for c in dict.fromkeys(keep) if c != key and c not in made]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), named(key).cast("string")))
    sized = docs.select(
        named(key).alias("__key"),
        named(source).alias("__source"),
        F.coalesce(F.regexp_count(named(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        digest.alias("__place"),
        *[named(c) for c in passed],
    )
    if not passed:  # narrow rows are counted once; wide ones are read again
        sized = stored(sized)
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    number = F.conv(F.substring("__place", 1, 12), 16, 10).cast("bigint") % shards
    sized = sized.withColumn("__shard", number)
    parts = stored(
        sized.groupBy(F.col("__source").alias("source"), F.col("__shard").alias("shard")).agg(
            F.sum("size").alias("shard_size")
        )
    )
    sources = water_fill(parts.groupBy("source").agg(F.sum("shard_size").alias("source_size")), weights, cap)
    blocks = F.round(F.sum("source_size").over(Window.partitionBy()) / BLOCK).cast("bigint")
    sources = stored(
        sainte_lague(sources.withColumn("blocks", blocks), [], "target", "blocks", ["source"])
    ).withColumnRenamed("quota", "source_blocks")
    by_source = parts.join(sources, parts["source"].eqNullSafe(sources["source"])).select(
        parts["source"], "shard", "shard_size", "source_size", "target", "source_blocks"
    )
    quotas = sainte_lague(by_source, ["source"], "shard_size", "source_blocks", ["source", "shard"])
    words = F.least(F.col("quota") * BLOCK, F.lit(cap) * F.col("shard_size"))
    whole = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0)
    pieces = F.greatest(F.round(F.col("shard_size") / BLOCK), F.lit(1)).cast("bigint")
    rest = words - F.col("whole") * F.col("shard_size")
    some = F.when(F.col("shard_size") > 0, F.round(rest * F.col("pieces") / F.col("shard_size"))).otherwise(0)
    quotas = stored(
        quotas.withColumns({"whole": whole.cast("bigint"), "pieces": pieces}).withColumn("some", some.cast("bigint"))
    )

    def chance(source: Column, shard: Column, block: Column) -> Column:
        """The seeded hash of a block."""
        place = F.concat_ws(":", F.lit(str(seed)), F.coalesce(source, F.lit("")), shard.cast("string"), block.cast("string"))
        return F.conv(F.substring(F.md5(place), 1, 12), 16, 10).cast("bigint")

    # a shard's blocks arise where they are ranked
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = quotas.filter("some > 0").repartition(tasks, "source", "shard").select(
        "source", "shard", "some", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("block")
    )
    every = every.withColumn("chance", chance(F.col("source"), F.col("shard"), F.col("block")))
    by_chance = Window.partitionBy("source", "shard").orderBy("chance", "block")
    last = every.withColumn("__n", F.row_number().over(by_chance)).filter("__n = some")
    last = last.select(
        F.col("source").alias("__last_source"), F.col("shard").alias("__last_shard"),
        F.struct("chance", "block").alias("__last"),
    )
    same = F.col("source").eqNullSafe(F.col("__last_source")) & (F.col("shard") == F.col("__last_shard"))
    quotas = quotas.join(last, same, "left").select(
        F.col("source").alias("__quota_source"),
        F.col("shard").alias("__quota_shard"),
        F.col("shard_size").alias("__shard_size"),
        F.col("whole").alias("__whole"),
        F.col("pieces").alias("__pieces"),
        "source_size",
        "target",
        "__last",
    )
    stream = Window.partitionBy("__source", "__shard").orderBy("__place", "__key", "size")
    start = F.coalesce(
        F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    same = F.col("__source").eqNullSafe(F.col("__quota_source"))
    joined = sized.withColumn("__start", start).join(
        quotas, same & (F.col("__shard") == F.col("__quota_shard"))
    )
    begin, end = F.col("__start"), F.col("__start") + F.col("size")

    def block_of(word: Column) -> Column:
        return F.ceil((word + 1) * F.col("__pieces") / F.col("__shard_size")) - 1

    def edge(block: Column) -> Column:
        return F.floor(block * F.col("__shard_size") / F.col("__pieces"))

    def selected(block: Column) -> Column:
        hashed = chance(F.col("__source"), F.col("__shard"), block)
        top = F.col("__last.chance")
        return (hashed < top) | ((hashed == top) & (block <= F.col("__last.block")))

    def part(block: Column) -> Column:
        low, high = F.greatest(edge(block), begin) - begin, F.least(edge(block + 1), end) - begin
        return F.struct(low.alias("from"), high.alias("to"))

    own = F.filter(F.sequence(block_of(begin), block_of(end - 1)), selected)
    parts = F.when((F.col("size") > 0) & F.col("__last").isNotNull(), F.transform(own, part))
    joined = joined.withColumn("parts", F.coalesce(parts, F.array().cast("array<struct<from:bigint,to:bigint>>")))
    some_words = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["to"] - p["from"])
    return joined.select(
        F.col("__key").alias(key),
        *[named(c) for c in passed],
        "size",
        "source_size",
        "target",
        (F.col("__whole") * F.col("size") + some_words).alias("taken"),
        F.col("__whole").alias("copies"),
        "parts",
    )


def apply_mix(
    docs: DataFrame,
    columns: Sequence[str],
    key: str = "doc_id",
    text: str = "text",
    n_chars: str = "n_chars",
) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: repeated, cut or left out.

    A row taken two and a half times comes as two whole copies and one with the words of its selected
    blocks, joined by blanks. Rows without words take nothing and go. Null keys and repeated rows are rows of their
    own; an empty table gives an empty one.
    """
    mixed = mix_sources(docs, key, text, keep=columns).filter("taken > 0")
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("copies") + (F.size("parts") > 0).cast("bigint"))
    repeated = mixed.withColumn("__copy", F.explode(copies))
    words = F.filter(F.split(named(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.transform(
        "parts", lambda p: F.slice(F.col("__words"), (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int"))
    )
    repeated = repeated.withColumn("__words", F.when(F.col("__copy") > F.col("copies"), words))
    part = F.when(F.col("__copy") <= F.col("copies"), named(text)).otherwise(F.array_join(F.flatten(cut), " "))
    made = {text: F.col("__part"), n_chars: F.length("__part").cast("bigint")}
    return repeated.withColumn("__part", part).select(
        *[made[c].alias(c) if c in made else named(c) for c in columns]
    )

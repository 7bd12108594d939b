"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document gets a rate (copies it is worth). Rates minimise the relative entropy to one copy of each under a
token constraint per source and a bound of ``most``. At the optimum a document of n tokens has the exponentially tilted rate

    min(most, exp(multiplier of its source * n / mean size of the source))

and the multipliers maximise the convex dual, whose gradient is the mix's tokens by source less the targets. Newton's
iterations find them: each is one distributed aggregate over the sizes (how many documents a source has of each size),
which gives gradient and curvature of every source at once, kept inside a bracket that each step narrows. Sums
are exact decimals, so that no order of adding changes a multiplier. Sources at their cap have the rate ``most``.

Rates are rounded into whole copies, the one below or the one above, by error diffusion: largest first, a fractional
copy is taken when that brings the taken tokens closest to the wanted ones. A source's documents are parted by
size (powers of two), and a part of more than ``group_rows`` documents is dealt into groups of about so many by a hash of
keys, source and text. A group holds every ``HELD``-th document back and passes it, with what the group still owes,
to the next level, where ``HELD`` groups form one, until a part is one group. The last groups of all parts of a source,
a bounded number of documents, are rounded together, and may go one copy further either way. So no source, however hot, meets in one task, what one
part owes the others make up for, and a source ends within about half its smallest document that is left.

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on, and share all
tokens; a target stops at ``most`` times its source's size and the excess is reshared by weight.

A null text has size 0; a document of size 0 takes nothing. Very long texts are documents like others, and rounded
first. A null source is a source. Repeated rows are documents of their own; which of them gets a copy is open, how many
do is not. Ties in size go by the hash. Results depend on rows alone, not on how files are split. An empty table
gives an empty result. Other columns are not read; keys may not be named source, size, row, turn or same. A dual that Newton's
steps don't solve is an ArithmeticError.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, numbered, table, written

WEIGHTS, MOST, GROUP_ROWS, STEPS, HELD = (1, 2, 3), 3, 256, 100, 16
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
FINE = 1 << 16  # parts of a word that sums are exact to


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def source_targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sums: one row (source, source_size, documents) per source. A written table with the target besides."""
    at = [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")]
    ordered = written(sums.orderBy(F.col("source").asc_nulls_last()).select("*", *at), "mix-order")
    before = ordered.groupBy("part").agg(F.count("*").alias("n"))  # a row for each sorted part
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    turn = F.pmod(F.col("before") + F.col("nth"), F.lit(len(weights))) + 1
    x = ordered.join(before, "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    x = written(x.select("source", "source_size", "documents", "weight", (F.col("source_size") * most).alias("cap")), "mix-weights")
    total, low, capped = x.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:  # a source stays capped once its share at a lower level passes its cap
        full = F.lit(low) * F.col("weight") >= F.col("cap")
        n, held, free = x.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, low = n, (total - (held or 0)) / free
    full = F.lit(low) * F.col("weight") >= F.col("cap")
    target = F.when(full | F.lit(not free), F.col("cap").cast("double")).otherwise(F.lit(low) * F.col("weight"))
    done = written(x.select("source", "source_size", "documents", target.alias("target")), "mix-targets")
    discard(ordered, x)
    return done


def tilt(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(multiplier * size / mean))


def multipliers(sizes: DataFrame, targets: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """targets with mean and multiplier; sizes (source, size, n), a written table: so many documents of a source have that size.

    The multiplier is null where every rate is ``most`` or nothing is to be taken.
    """
    some = F.coalesce((F.col("target") > 0) & (F.col("target") < F.col("source_size") * most), F.lit(False))
    start = F.when(some, F.lit(0.0))
    state = targets.select("*", (F.col("source_size") / F.col("documents")).alias("mean"), start.alias("multiplier"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), some.alias("open"))
    state = written(state, "mix-dual")
    m, mean, size = F.col("multiplier"), F.col("mean"), F.col("size").cast("double")
    exact = lambda x: F.sum((x * FINE).cast("decimal(38,0)"))
    for _ in range(steps):
        to = state.where("open").select(F.col("source").alias("of"), "mean", "multiplier")
        taken = F.col("n") * size * tilt(m, size, mean, most)
        curve = F.when(m * size / mean < F.log(F.lit(float(most))), taken * size / mean).otherwise(0.0)
        sums = sizes.join(to, F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(exact(taken).alias("g"), exact(curve).alias("h"))
        sums = sums.select("of", (F.col("g").cast("double") / FINE).alias("g"), (F.col("h").cast("double") / FINE).alias("h"))
        at = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        below = F.col("g") < F.col("target")
        at = at.withColumns({"low": F.when(F.col("open") & below, m).otherwise(F.col("low")), "high": F.when(F.col("open") & ~below, m).otherwise(F.col("high"))})
        # Newton's step for the logarithm of the taken tokens, which is nearly a straight line; outside the bracket, its middle.
        newton = m + F.log(F.col("target") / F.col("g")) * F.col("g") / F.col("h")
        inside = (F.col("h") > 0) & (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
        other = F.when(F.col("high").isNull(), F.greatest(F.lit(1.0), F.col("low") * 2)).when(F.col("low").isNull(), F.least(F.lit(-1.0), F.col("high") * 2)).otherwise((F.col("low") + F.col("high")) / 2)
        close = F.abs(F.col("g") - F.col("target")) <= F.lit(0.01) + F.col("target") * 1e-9
        close |= F.coalesce(F.col("high") - F.col("low") <= F.abs(m) * 1e-15, F.lit(False))
        on = F.col("open") & ~close
        at = at.withColumn("multiplier", F.when(on, F.when(inside, newton).otherwise(other)).otherwise(m)).withColumn("open", on)
        old, state = state, written(at.select(*state.columns), "mix-dual")
        discard(old)
        if state.where("open").isEmpty():
            return state.drop("low", "high", "open")
    raise ArithmeticError(f"multipliers were not found in {steps} steps")


_GROUP = ["source", "part", "group", "groups"]


def rounded(level: DataFrame, last: bool) -> DataFrame:
    """One row per group: all its documents, largest first, and done: the copies of each (null: held back) and what is owed.

    level: the columns of a group, and either a document or what an earlier group owes.
    """
    grouped = level.groupBy(*_GROUP).agg(F.sort_array(F.collect_list("doc"), asc=False).alias("all"), F.sum("owed").alias("owed"))  # whole parts of a word: no order of adding matters

    def take(done: Column, x: Column) -> Column:
        held = F.lit(False) if last else F.size(done["n"]) % HELD == HELD - 1
        whole = F.floor(x["rate"] + F.lit(1e-12))
        want = done["owed"] + x["size"] * (x["rate"] - whole)
        if last:  # nobody is left to pass a rest on to
            extra = F.greatest(F.greatest(F.lit(-1), -whole), F.least(F.least(F.lit(2), x["most"] - whole), F.floor(want / x["size"] + F.lit(0.5))))
        else:
            extra = F.when((whole < x["most"]) & (want * 2 >= x["size"]), F.lit(1)).otherwise(F.lit(0))
        owed = F.when(held, done["owed"]).otherwise(want - extra * x["size"])
        return F.struct(owed.alias("owed"), F.concat(done["n"], F.array(F.when(~held, (whole + extra).cast("int")))).alias("n"))

    start = F.struct((F.col("owed") / F.lit(float(FINE))).alias("owed"), F.array().cast("array<int>").alias("n"))
    return grouped.select(*_GROUP, "all", F.aggregate("all", start, take).alias("done"))


def copies(sized: DataFrame, keys: list[str], most: int = MOST, group_rows: int = GROUP_ROWS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sized, a table of ``sized_rows``: ``keys``, source, size, row and turn. Adds source_size, target and copies, in place of turn."""
    sums = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    by_source = sums.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    targets = source_targets(by_source, weights, most)
    tilted = multipliers(sums.where("size > 0"), targets, most)
    part = lambda c: F.floor(F.log2(F.col(c).cast("double"))).cast("int")
    parts = sums.where("size > 0").groupBy("source", part("size").alias("part")).agg(F.sum("n").alias("n"))
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.ceil(F.col("n") / group_rows).alias("groups"))
    near = written(parts.join(tilted, F.col("source").eqNullSafe(F.col("of"))).drop("source", "documents"), "mix-parts")
    rate = F.when(F.col("multiplier").isNotNull(), tilt(F.col("multiplier"), F.col("size"), F.col("mean"), most))
    rate = F.coalesce(rate, F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0))
    # The fields of a document's struct have names of their own, so that keys may be called anything.
    names = [*keys, "source", "size", "row", "source_size", "target"]
    doc = F.struct("size", "turn", rate.alias("rate"), F.lit(most).alias("most"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(names)]).alias("doc")
    docs = sized.where("size > 0").join(near, F.col("source").eqNullSafe(F.col("of")) & (part("size") == F.col("of_part")))
    docs = docs.select("source", F.col("of_part").alias("part"), F.pmod("turn", F.col("groups")).alias("group"), "groups", F.lit(0).cast("long").alias("owed"), doc)
    final, done = [docs.where("groups = 1")], []
    level, groups = docs.where("groups > 1"), near.agg(F.max("groups")).first()[0] or 0
    while groups > 1:
        done.append(written(rounded(level, last=False), "mix-level"))
        up = done[-1].withColumns({"group": F.floor(F.col("group") / HELD), "groups": F.ceil(F.col("groups") / HELD)})
        held = F.filter(F.arrays_zip(F.col("all").alias("a"), F.col("done.n").alias("n")), lambda x: x["n"].isNull())["a"]
        moved = up.select(*_GROUP, F.lit(0).cast("long").alias("owed"), F.explode(held).alias("doc"))
        moved = moved.unionByName(up.select(*_GROUP, F.round(F.col("done.owed") * FINE).cast("long").alias("owed")), allowMissingColumns=True)
        final.append(moved.where("groups = 1"))
        level, groups = moved.where("groups > 1"), -(-groups // HELD)
    ends = reduce(DataFrame.unionByName, final).withColumns({"part": F.lit(0), "group": F.lit(0).cast("long")})
    done.append(written(rounded(ends, last=True), "mix-last"))
    discard(sums, tilted, near)
    out = []
    for x in done:
        one = x.select(F.explode(F.arrays_zip(F.col("all").alias("a"), F.col("done.n").alias("n"))).alias("x")).where("x.n is not null")
        out.append(one.select(*[F.col(f"x.a.k{i}").alias(c) for i, c in enumerate(names)], F.col("x.n").alias("copies")))
    own = targets.select(F.col("source").alias("of"), "source_size", "target")
    nothing = sized.where("size = 0").join(own, F.col("source").eqNullSafe(F.col("of"))).select(*names, F.lit(0).alias("copies"))
    return reduce(DataFrame.unionByName, [*out, nothing])


def sized_rows(docs: DataFrame, keys: list[str], text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """``keys``, source, size, row (a value of each row, from the column ``row`` if given) and turn (a hash of its contents), as a table.

    The turns of rows that repeat keys, source and text more than ``GROUP_ROWS`` times depend on their places as well, so that no group holds them all.
    """
    own = docs.select(*keys, F.col(text).alias("text"), F.col(source).alias("source"), *[F.col(c).alias("row") for c in [row] if c])
    own = own if row else numbered(own, "row")
    turn = F.xxhash64(*keys, "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = written(own.select(*keys, "source", size_of("text").alias("size"), "row", turn.alias("turn")), "mix-contents")
    often = sized.groupBy(F.col("turn").alias("same")).agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("same")
    at = F.when(F.col("same").isNull(), F.col("turn")).otherwise(F.xxhash64("turn", "row"))
    done = written(sized.join(often, F.col("turn") == F.col("same"), "left").withColumn("turn", at).drop("same"), "mix-sizes")
    discard(sized)
    return done


def op5_entropy_mix(spark, sf_dir: str) -> DataFrame:
    sized = sized_rows(table(spark, sf_dir, "documents"), ["doc_id"])
    return copies(sized, ["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))

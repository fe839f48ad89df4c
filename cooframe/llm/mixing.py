"""Mixing sources to target weights by Pareto order sampling.

Documents of one source have unequal chances of a further copy (shorter ones
greater chances); random odds over the odds of these chances rank them, and
the first by rank are taken until the words come nearest the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Weights of the sources in code point order, repeating; the size of the mix against all sizes; the most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents that a bucket of the order holds, about; only the bucket where a target is met is sorted.
BUCKET = 4096
#: A document weighs this less the binary digits of its size (31 for a word, 17 for 20,000 words), 1 at least.
LIGHTEST = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(doc_id, seed: str):
    """A number above 0 and below 1 that depends on doc_id and the seed alone."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target, docs``: a row for each source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh ``weights``, repeating, and
    share ``share`` times all sizes. A target stops at ``most`` times its
    source's size; the excess goes to the others by weight until none is
    above. With sources by their ratio of stop to weight, the ones that stop
    are the first few, so windows over this small table find the level.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    sources = sources.withColumn("stop", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("stop") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double") * share
    before = F.coalesce(F.sum("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (total - before) / left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    target = F.least(F.col("stop"), F.coalesce(level * F.col("w"), F.col("stop")))
    return sources.withColumn("target", target).select("source", "source_size", "target", "docs")


def binary_digits(size):
    return F.length(F.bin(size))


def weight(size):
    """Weight of a document for a copy that not all of its source get: long texts cost more and are repeated less."""
    return F.greatest(F.lit(1), LIGHTEST - binary_digits(size)).cast("long")


def plan(sizes: DataFrame, aims: DataFrame, seed: str, most: int = MOST) -> DataFrame:
    """``aims`` with ``whole``, ``scale``, and where the sample ends: ``last`` (bucket) and ``cut`` (rank, doc_id).

    Every document of a source has floor(target / source_size) certain copies.
    The words still wanted are the expected words of one more copy, which a
    document gets with the probability min(1, scale * weight): ``scale`` is
    found over the classes of equal weight, of which the first few may be
    certain (a row for each source and number of binary digits).
    """
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    aims = aims.withColumn("whole", F.floor(copies)).withColumn("rest", copies - F.col("whole"))
    aims = aims.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    aims = aims.withColumn("odds", F.col("rest") / (1 - F.col("rest"))).withColumn("buckets", F.ceil(F.col("docs") / BUCKET))
    classes = sizes.groupBy("source", binary_digits(F.col("size")).alias("digits")).agg(F.sum("size").alias("words"), F.max(weight(F.col("size"))).alias("weight"))
    classes = classes.join(aims.where("rest > 0").select(F.col("source").alias("s"), "wanted"), F.col("source").eqNullSafe(F.col("s")))
    by = Window.partitionBy("source").orderBy("digits")  # at most 64 rows a source
    certain = F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(F.col("words") * F.col("weight")).over(by.rowsBetween(0, Window.unboundedFollowing))
    scale = classes.withColumn("scale", F.try_divide(F.col("wanted") - certain, others)).where(F.col("scale") * F.col("weight") <= 1)
    scale = scale.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("digits", "scale"))["scale"].alias("scale"))
    aims = written(aims.join(scale, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "aims")
    ranked = with_rank(sizes, aims.where("rest > 0"), seed)
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))  # a row for every 4,096 documents or so
    ends = sums.withColumn("upto", run).join(aims.select(F.col("source").alias("s"), "wanted"), F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") >= F.col("wanted"))
    ends = ends.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "wanted")).alias("e")).select(F.col("source").alias("s"), F.col("e.bucket").alias("last"), F.col("e.before").alias("before"), F.col("e.wanted").alias("wanted"))
    ends = written(ends, "ends")
    within = ranked.drop("wanted").join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("last")))
    peers = F.sum("size").over(Window.partitionBy("source", "rank", "doc_id"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = within.withColumn("ok", F.col("before") + upto - peers / 2 <= F.col("wanted")).where("ok").groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("cut"))
    ends = ends.select("s", "last").join(cut.withColumnRenamed("source", "c"), F.col("s").eqNullSafe(F.col("c")), "left").select("s", "last", "cut")
    return written(aims.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "plan")


def with_rank(rows: DataFrame, aims: DataFrame, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, size) with their ``chance``, Pareto ``rank`` and its ``bucket``.

    A document's random odds u / (1 - u) are divided by the odds of its own
    chance. The rank is that quotient on a scale of 0 to 1 which the odds of
    the whole source set, so that ranks fill the buckets evenly; a certain copy
    ranks 0.
    """
    aims = aims.withColumnRenamed("source", "s")
    chance = F.least(F.lit(1.0), F.coalesce(F.col("scale") * weight(F.col("size")), F.lit(1.0)))
    u = draw(F.col("doc_id"), seed)
    pareto = F.when(F.col("chance") >= 1, F.lit(0.0)).otherwise(F.try_divide(u / (1 - u), F.col("chance") / (1 - F.col("chance"))))  # null where chance is 0
    found = rows.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("chance", chance)
    scaled = F.col("pareto") * F.col("odds")
    return found.withColumn("pareto", pareto).withColumn("rank", F.coalesce(scaled / (1 + scaled), F.lit(1.0))).withColumn("bucket", F.floor(F.col("rank") * F.col("buckets"))).drop("pareto")


def copies(rows: DataFrame, plan_: DataFrame, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, size) with ``source_size``, ``target``, ``chance`` and ``copies``, decided row by row."""
    ranked = with_rank(rows, plan_, seed)
    inside = (F.col("bucket") < F.col("last")) | ((F.col("bucket") == F.col("last")) & (F.struct("rank", "doc_id") <= F.col("cut")))
    taken = F.col("whole") + F.when(F.col("rest") > 0, F.coalesce(F.when(F.col("last").isNull(), F.lit(True)).otherwise(inside), F.lit(False)).cast("long")).otherwise(F.lit(0).cast("long"))
    return ranked.withColumn("copies", taken)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, chance, copies, taken`` for every row of ``docs`` (doc_id, text, source).

    A source gives every document its whole copies, and one more to those that
    come first by Pareto rank until its words come nearest its target;
    ``chance`` is the probability of that one aimed at. The sizes are counted
    once and written as a narrow table; sums by source and bucket of ranks show
    where each source ends, and only that bucket is put in order, so no task
    holds a source.

    Null text has size 0, a null source is a source. Rows of one doc_id share
    one draw and, where source and size are equal too, one decision; a source
    without words takes nothing. Texts of any length are one row. Other columns
    are ignored. An empty table gives an empty one.
    """
    sizes = written(_narrow(docs), "sizes")
    found = copies(sizes, plan(sizes, targets(sizes, weights, share, most), seed, most), seed)
    return found.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("rest") > 0, F.col("chance")).otherwise(0.0).alias("chance"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: each document as often as it is taken."""
    sizes = written(_narrow(docs), "sizes")
    plan_ = plan(sizes, targets(sizes, weights, share, most), seed, most)
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    found = copies(own, plan_, seed).where("copies > 0")
    return found.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")

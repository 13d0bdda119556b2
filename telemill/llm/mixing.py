"""Mix sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``most`` copies, as close to one copy as possible in the sense
of relative entropy (with room on both sides), so that the words taken from each source meet its
target. The dual of this convex problem has one multiplier per source; the rates are tilted
exponentially by document size: ``rate / (most - rate) = exp(multiplier * size / scale) / (most - 1)``.
The multipliers come from distributed Newton iterations, safeguarded by bisection, over the table of
distinct sizes of each source (the rates depend on nothing else). Rates become whole copies by
error diffusion down the sizes, which leaves each source off its target by about half of its largest
document at most; one further document of a fitting size takes up most of what is left. Large documents
(over a hundredth of the target) are settled first, and the others balanced anew around them.

Only DataFrame operations. No group is gathered: sums run over sizes in two levels, documents of one
size are ranked in hashed slices.

Reruns agree: slices and ranks come from a hash of the id and the text, never from where a row was
read, and the multipliers are rounded to ``DIGITS`` decimals, so that sums of doubles in another order
(other cores, other files) give the same rates. Rows equal in id and text share a slice; a large group
of them is ranked in one task, by a window that spills.

Nulls and ties: null text has size 0; documents of size 0 take one copy (they cost nothing). A null
source is a source of its own, weighted last. Repeated rows are rows of their own; equal ids share a
rank in no defined order, which changes no sum. An empty table gives an empty mix. Other columns are
ignored by ``rates`` and kept by ``mixed``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.staging import staged

SLICES = 64
DIGITS = 9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """Keys that sort by code point, the one of null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: weights 1, 2, 3, repeating by code
    point (keys of ``source_key``: null last); no target above ``most`` times its source, the excess shared again by weight.

    The share of one unit of weight is found exactly: sources ordered by size over weight reach
    their limit one after another, so it is the first point where the rest can take all that is left.
    One row per source.
    """
    by_name = Window.orderBy("source")
    ordered = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = ordered.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    ).withColumn(
        "level",
        (F.col("all_size") - most * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before")),
    )
    fits = F.col("level") * F.col("weight") <= most * F.col("source_size")
    level = F.min(F.when(fits, F.struct("weight_before", "level"))).over(everything)["level"]
    return levels.select(
        "source",
        "source_size",
        F.least(
            (most * F.col("source_size")).cast("double"), F.coalesce(level * F.col("weight"), F.lit(0.0))
        ).alias("target"),
    )


def _rate(multiplier: Column, size: Column, scale: Column, most: int) -> Column:
    tilt = F.least(F.greatest(multiplier * size / scale, F.lit(-700.0)), F.lit(700.0))
    return most / (1 + (most - 1) * F.exp(-tilt))


def multipliers(
    histogram: DataFrame, targets: DataFrame, most: int = 3, rounds: int = 8, steps: int = 6, tolerance: float = 1e-7
) -> DataFrame:
    """``source, scale, multiplier`` so that ``sum(n * size * rate) = target`` for each source.

    ``rounds`` times ``steps`` Newton iterations at most; a round ends with a stored table and a look
    at the largest error. A step that leaves the bracket of the root is replaced by its middle.
    """
    scale = histogram.groupBy("source").agg(
        F.greatest(F.sum(F.col("n") * F.col("size")) / F.sum("n"), F.lit(1.0)).alias("scale")
    )
    state = targets.join(scale, "source").select(
        "source",
        "source_size",
        "target",
        "scale",
        F.lit(0.0).alias("multiplier"),
        F.lit(-5000.0).alias("low"),
        F.lit(5000.0).alias("high"),
        F.lit(1.0).alias("error"),
    )
    for _ in range(rounds):
        for _ in range(steps):
            state = _newton_step(histogram, state, most)
        state = staged(state, "mixing-multipliers")
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
    return state.select("source", "scale", F.round("multiplier", DIGITS).alias("multiplier"))


def _newton_step(histogram: DataFrame, state: DataFrame, most: int) -> DataFrame:
    joined = histogram.join(state, "source")
    rate = _rate(F.col("multiplier"), F.col("size"), F.col("scale"), most)
    words = F.col("n") * F.col("size") * rate
    sums = joined.groupBy("source", "source_size", "target", "scale", "multiplier", "low", "high").agg(
        F.sum(words).alias("taken"),
        F.sum(words * (F.col("size") / F.col("scale")) * (1 - rate / most)).alias("slope"),
    )
    gap = F.col("taken") - F.col("target")
    low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
    high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
    step = F.col("multiplier") - gap / F.col("slope")
    inside = (F.col("slope") > 0) & (step > low) & (step < high)
    # At its limit a source takes every copy; at rate one nothing is to be done.
    return sums.select(
        "source",
        "source_size",
        "target",
        "scale",
        F.when(F.col("target") >= most * F.col("source_size"), F.lit(5000.0))
        .when(gap == 0, F.col("multiplier"))
        .when(inside, step)
        .otherwise((low + high) / 2)
        .alias("multiplier"),
        low.alias("low"),
        high.alias("high"),
        F.when(F.col("target") >= most * F.col("source_size"), F.lit(0.0))
        .otherwise(F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0)))
        .alias("error"),
    )


def _plan(histogram: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Whole copies for each ``source, size``: ``copies`` over its ``n`` documents."""
    rated = (
        histogram.join(multipliers(histogram, targets, most), "source")
        .join(targets, "source")
        .select(
            "source",
            "size",
            "n",
            "source_size",
            "target",
            F.when(F.col("size") == 0, F.lit(1.0))
            .otherwise(_rate(F.col("multiplier"), F.col("size"), F.col("scale"), most))
            .alias("rate"),
            F.floor(F.log2(F.col("size") + 1) * 8).alias("octave"),
        )
        .withColumn("mass", F.col("n") * F.col("rate"))
    )
    octaves = rated.groupBy("source", "octave").agg(F.sum("mass").alias("mass"))
    above = (
        Window.partitionBy("source").orderBy(F.desc("octave")).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = octaves.select(
        "source",
        "octave",
        F.coalesce(F.sum("mass").over(above), F.lit(0.0)).alias("start"),
    )
    down = Window.partitionBy("source", "octave").orderBy(F.desc("size"))
    running = rated.join(starts, ["source", "octave"]).withColumn(
        "reach", F.col("start") + F.sum("mass").over(down.rowsBetween(Window.unboundedPreceding, 0))
    )
    copies = F.least(
        F.greatest(F.round(F.col("reach")) - F.round(F.col("reach") - F.col("mass")), F.lit(0.0)),
        F.col("n") * F.lit(float(most)),
    )
    planned = staged(
        running.select("source", "size", "n", "source_size", "target", copies.cast("bigint").alias("copies")),
        "mixing-plan",
    )
    # What is left of the target is at most about half of the largest document: one more copy, or one
    # less, of the size that fits best.
    left = planned.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left")
    )
    unmet = planned.join(left, "source").withColumn(
        "turn", F.when(F.col("left") > 0, F.lit(1)).otherwise(F.lit(-1))
    )
    better = F.abs(F.col("left") - F.col("turn") * F.col("size"))
    can = F.when(F.col("turn") > 0, F.col("copies") < F.col("n") * most).otherwise(F.col("copies") > 0)
    fits = F.min(F.when(can & (better < F.abs(F.col("left"))) & (F.col("size") > 0), F.struct(better, "size", "turn")))
    chosen = unmet.groupBy("source").agg(fits.alias("fit")).select("source", "fit.size", "fit.turn")
    return planned.join(chosen, ["source", "size"], "left").select(
        "source", "size", "n", "source_size", "target", (F.col("copies") + F.coalesce("turn", F.lit(0))).alias("copies")
    )


def _two_plans(histogram: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """The plan of ``_plan``; with the copies of large documents (over a hundredth of the target) settled,
    the rates of the others are balanced anew for the words that are left."""
    columns = ["source", "size", "n", "source_size", "target", "copies"]
    large = staged(_plan(histogram, targets, most).where(F.col("size") * 100 > F.col("target")), "mixing-large")
    others = histogram.join(large.select("source", "size"), ["source", "size"], "left_anti")
    others = staged(others, "mixing-others")
    settled = large.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("settled"))
    sizes = others.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    left = staged(
        targets.drop("source_size")
        .join(sizes, "source")
        .join(settled, "source", "left")
        .select(
            "source",
            "source_size",
            F.greatest(
                F.lit(0.0),
                F.least(F.col("target") - F.coalesce("settled", F.lit(0)), (most * F.col("source_size")).cast("double")),
            ).alias("target"),
        ),
        "mixing-left",
    )
    rest = _plan(others, left, most).drop("source_size", "target").join(targets, "source")
    return large.select(columns).unionByName(rest.select(columns))


def rates(documents: DataFrame, most: int = 3) -> DataFrame:
    """``row, doc_id, size, source_size, target, copies`` of every document.

    ``documents`` has ``row`` (unique), ``doc_id``, ``source`` (a ``source_key``), ``size`` and ``content``
    (a hash of the text). Equal rows (same id and text) are interchangeable: which of them takes a copy
    changes no result.
    """
    slice_ = F.pmod(F.xxhash64("doc_id", "content"), F.lit(SLICES)).cast("int")
    rows = documents.select("row", "doc_id", "source", "size", "content", slice_.alias("slice"))
    sliced = staged(rows.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "mixing-slices")
    histogram = staged(sliced.groupBy("source", "size").agg(F.sum("n").alias("n")), "mixing-sizes")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = staged(source_targets(sizes, most), "mixing-targets")
    plan = _two_plans(histogram, targets, most)
    # Copies of a size class over its slices: what the running count of documents entitles a slice to.
    upto = Window.partitionBy("source", "size").orderBy("slice")
    shares = (
        sliced.withColumnRenamed("n", "n_slice")
        .join(plan, ["source", "size"])
        .withColumn("each", F.floor(F.col("copies") / F.col("n")))
        .withColumn("extra", F.col("copies") - F.col("each") * F.col("n"))
        .withColumn("reach", F.sum("n_slice").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "source",
            "size",
            "slice",
            "source_size",
            "target",
            "each",
            (
                F.floor(F.col("extra") * F.col("reach") / F.col("n"))
                - F.floor(F.col("extra") * (F.col("reach") - F.col("n_slice")) / F.col("n"))
            ).alias("extra"),
        )
    )
    rank = F.row_number().over(
        Window.partitionBy("source", "size", "slice").orderBy(
            F.xxhash64("doc_id", "content", F.lit(1)), "doc_id", "content", "row"
        )
    )
    return (
        rows.withColumn("rank", rank)
        .join(shares, ["source", "size", "slice"])
        .select(
            "row",
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("each") + (F.col("rank") <= F.col("extra")).cast("bigint")).alias("copies"),
        )
    )


def sized(documents: DataFrame) -> DataFrame:
    """``row, doc_id, source, size``, stored: ``row`` numbers are only stable in a stored table."""
    return staged(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            source_key(F.col("source")).alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("content"),
        ),
        "mixing-rows",
    )


def mix(documents: DataFrame, most: int = 3) -> DataFrame:
    """``doc_id, size, source_size, target, taken``."""
    return rates(sized(documents), most).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(documents: DataFrame, most: int = 3) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; same columns."""
    kept = staged(
        documents.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("document")),
        "mixing-documents",
    )
    rows = kept.select(
        "row",
        F.col("document.doc_id").alias("doc_id"),
        source_key(F.col("document.source")).alias("source"),
        word_count(F.col("document.text")).alias("size"),
        F.xxhash64(F.coalesce(F.col("document.text"), F.lit(""))).alias("content"),
    )
    copies = rates(staged(rows, "mixing-rows"), most).select("row", "copies").where("copies > 0")
    return (
        kept.join(copies, "row")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select("document.*")
    )

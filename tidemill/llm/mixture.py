"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most sources a table of targets may have, as the water level is found on the driver.
MOST_SOURCES = 10_000
#: The sampling hash has HASH_BITS bits, which are looked at STEP_BITS at a time.
HASH_BITS, STEP_BITS = 60, 12


def water_fill(sizes: dict[str, float], shares: dict[str, float], most: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Size that each source contributes.

    Every source gets its share of the total, at most its size times its
    repetitions. What a source at that limit can't give is shared among the
    others in proportion to their shares, until no further one reaches its limit.
    ``total`` is the size of all sources together unless given; it is lowered to
    the sum of the limits where it lies above. Sources without a positive share
    or size get 0.
    """
    limits = {s: max(sizes.get(s, 0.0), 0.0) * max(most[s], 0.0) for s, w in shares.items() if w > 0}
    wanted = sum(sizes.get(s, 0.0) for s in limits) if total is None else total
    left = min(wanted, sum(limits.values()))
    out = {s: 0.0 for s in shares}
    active = {s for s, limit in limits.items() if limit > 0}
    while active and left > 0:
        weight = sum(shares[s] for s in active)
        full = {s for s in active if shares[s] / weight * left >= limits[s]}
        if not full:
            for s in active:
                out[s] = shares[s] / weight * left
            break
        for s in full:
            out[s] = limits[s]
            left -= limits[s]
        active -= full
    return out


def canonical(source: Column) -> Column:
    """A source's name without blanks around it and in lower case."""
    return F.lower(F.trim(source))


def hash_bounds(docs: DataFrame, rest: dict[str, float]) -> dict[str, int]:
    """For each source the bound of ``h`` below which its documents have a total size nearest to ``rest``.

    docs has source, h (HASH_BITS bits) and size. The leading bits are binned
    first, then the next bits of the documents in the bin where the running size
    passes the rest, and so on until that bin holds one hash; every round has at
    most 2 ** STEP_BITS bins a source, of which one row a source is collected. So
    a rest is met to half a document, however small a part of its source it is.
    """
    out = {s: 0 for s in rest}
    open_ = {s: (0, r) for s, r in rest.items() if r > 0}  # the bits found so far, and what is left of the rest
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        if not open_:
            break
        near = docs.sparkSession.createDataFrame([(s, p, r) for s, (p, r) in open_.items()], "source string, prefix long, rest double")
        # one row a source
        rows = docs.join(F.broadcast(near), "source").where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        bins = rows.groupBy("source", "rest", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").cast("double").alias("bin_size"), (F.min("h") == F.max("h")).alias("one"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        passed = bins.withColumn("upto", F.sum("bin_size").over(upto)).where(F.col("upto") >= F.col("rest"))
        first = passed.groupBy("source").agg(F.min(F.struct("bin", "upto", "bin_size", "one")).alias("b")).select("source", "b.*").collect()
        found = {r.source: r for r in first}
        for s, (prefix, left) in list(open_.items()):
            if s not in found:  # all of the bin belongs to the rest
                out[s] = (prefix + 1) << (shift + STEP_BITS)
                del open_[s]
                continue
            r = found[s]
            left -= r.upto - r.bin_size
            if r.one or shift == 0:
                out[s] = (r.bin + (r.bin_size / 2 <= left)) << shift
                del open_[s]
            else:
                open_[s] = (r.bin, left)
    return out


def repetitions(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, report).

    documents: id, source, size and ``copies`` (at least 1) of every document in
    the mixture. report: a row per source of the targets and one of '' for
    documents of no target, with its size, target_share, the share after clamping
    (planned_share), ``epochs``, the copies' real size and actual_share.

    ``targets`` has source, target_share and max_repeats. A source's epochs are
    its contribution by its size: each document is taken that many whole times,
    and once more if its seeded hash lies below the bound at which the sizes of
    such documents come nearest to the fraction (``hash_bounds``). Documents with
    a null or unknown source, or without a positive size, are not taken. Repeated
    ids share their fate.
    """
    rows = targets.select(canonical(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("double")).where("source is not null").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = sized.sparkSession
    shares = {r.source: float(r.target_share or 0.0) for r in rows}
    most = {r.source: float(r.max_repeats or 0.0) for r in rows}
    docs = sized.select(F.col(id_col).alias("id"), canonical(F.col(source_col)).alias("source"), F.col(size_col).cast("long").alias("size"))
    docs = docs.withColumn("source", F.when(F.col("source").isin(list(shares)), F.col("source")).otherwise("")).where("size > 0")
    docs = docs.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 64 - HASH_BITS))
    sizes = {r.source: float(r.n) for r in docs.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    filled = water_fill(sizes, shares, most, total)
    planned = sum(filled.values())
    plan, rest = [], {}
    for s in shares:
        size = sizes.get(s, 0.0)
        epochs = filled[s] / size if size else 0.0
        whole = int(epochs + 1e-9)
        rest[s] = max(epochs - whole, 0.0) * size
        plan.append((s, size, shares[s], filled[s] / planned if planned else 0.0, epochs, whole))
    bounds = hash_bounds(docs.where("source <> ''"), rest)
    frame = spark.createDataFrame([(*p, bounds[p[0]]) for p in plan], "source string, size double, target_share double, planned_share double, epochs double, whole int, bound long")
    # one row a source of the targets, of which there are at most MOST_SOURCES
    copies = F.col("whole") + (F.col("h") < F.col("bound")).cast("int")
    taken = docs.join(F.broadcast(frame.select("source", "whole", "bound")), "source").withColumn("copies", copies).where("copies > 0")
    documents = taken.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("size").alias(size_col), "copies")
    real = taken.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("mixed_size"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    other = spark.createDataFrame([("", sizes.get("", 0.0), 0.0, 0.0, 0.0)], "source string, size double, target_share double, planned_share double, epochs double")
    base = frame.select("source", "size", "target_share", "planned_share", "epochs").unionByName(other).join(real, "source", "left")
    # one row a source
    every = F.sum("mixed_size").over(Window.partitionBy(F.lit(0)))
    report = base.select(
        "source", F.col("size").cast("long").alias("size"), "target_share", "planned_share", "epochs", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("mixed_size", F.lit(0)).alias("mixed_size"), F.coalesce(F.col("mixed_size") / every, F.lit(0.0)).alias("actual_share"),
    )
    return documents, report

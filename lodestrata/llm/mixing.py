"""Mixing sources to target shares of the total size.

Each source first gives as many complete passes as its target needs; the rest
of its budget is drawn without replacement by exponential keys, -ln(u) over the
document's quality weight, smallest first, up to the token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.columns import source_name, tokens
from lodestrata.session import materialize

#: Bins of the keys for each factor of e: only the bin that holds the end of a budget is sorted.
BINS = 512


def quality(text: Column) -> Column:
    """A document's weight in the draw, 0.05 to 1: the share of its characters that are letters, digits, or blanks; 0.05 for a null or empty text."""
    n = F.char_length(text)
    good = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N} ]", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.when(n > 0, good / n), F.lit(0.05)))


def shares(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of a mix.

    With T the tokens of all documents, a target source needs target_share * T
    and owns the tokens of its documents. sample(doc_id, source, tokens,
    repeats): the documents of the mix and how often each is in it. report(
    source, need, own, outcome, passes, fraction_tokens, actual_tokens,
    actual_share): one row per target source; outcome is 'short' if need exceeds
    max_repeats * own, else 'repeat' if it exceeds own, else 'once'.

    A source is compared plain, without trailing slash, with blanks and
    underscores as hyphens; targets whose names become equal must not occur.
    Documents with no or an unknown source count in T and are in no mix. A null
    share counts as 0, null or negative max_repeats as 0. A document of 0 tokens
    or a null id is in no mix, and of rows with one id each is drawn alike. The
    draw takes the documents, by key, as long as at least half of each fits into
    what is left of the budget, so it ends as near to it as the last one allows.
    Shares of a mix of nothing are null.

    Keys are binned per source by their logarithm. A weight only moves the
    logarithm of an exponential key, so whatever the weights, a bin holds less
    than 1 / (e * BINS) of a source's rows, but for chance. Bins before the one
    that holds the end of the budget are taken whole, and only that bin is
    sorted, so no task sees a whole source.
    """
    weight = quality(F.col(text_col)) if weight is None else weight
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_name(F.col(source_col)).alias("source"), tokens(F.col(text_col)).alias("tokens"), weight.cast("double").alias("weight"))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = rows.withColumn("key", -F.log(unit) / F.greatest(F.coalesce("weight", F.lit(1e-9)), F.lit(1e-9)))
    rows = rows.withColumn("bin", F.floor(F.log("key") * BINS).cast("int"))
    rows = materialize(rows.select("doc_id", "source", "tokens", "key", "bin"))
    # At most some 60 BINS rows a source: keys are of 53 bits.
    bins = materialize(rows.groupBy("source", "bin").agg(F.sum("tokens").alias("size"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("tokens"))).alias("usable")))
    total = bins.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    own = bins.groupBy("source").agg(F.sum("usable").alias("own"), F.sum("size").alias("all"))
    t = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    t = t.join(own, "source", "left").crossJoin(F.broadcast(total)).select("source", "max_repeats", (F.col("target_share") * F.col("total")).alias("need"), F.coalesce("all", F.lit(0)).alias("own"))
    t = t.withColumn("outcome", F.when(F.col("need") > F.col("max_repeats") * F.col("own"), "short").when(F.col("need") > F.col("own"), "repeat").otherwise("once"))
    t = t.withColumn("passes", F.when(F.col("outcome") == "short", F.col("max_repeats")).when(F.col("own") > 0, F.floor(F.col("need") / F.col("own"))).otherwise(0).cast("long"))
    t = materialize(t.withColumn("budget", F.when(F.col("outcome") == "short", 0.0).otherwise(F.col("need") - F.col("passes") * F.col("own"))))

    order = Window.partitionBy("source").orderBy("bin")
    placed = bins.withColumn("upto", F.sum("usable").over(order)).withColumn("before", F.col("upto") - F.col("usable"))
    placed = placed.join(t.select("source", "passes", "budget"), "source").select("source", "bin", "before", "upto", "passes", "budget")
    member = rows.where("doc_id is not null and tokens > 0").join(placed, ["source", "bin"])
    split = (F.col("before") < F.col("budget")) & (F.col("upto") > F.col("budget"))
    within = Window.partitionBy("source", "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = member.where(split).withColumn("sum", F.col("before") + F.sum("tokens").over(within)).withColumn("drawn", F.col("sum") - F.col("tokens") / 2 <= F.col("budget"))
    whole = member.where(~split).withColumn("drawn", F.col("upto") <= F.col("budget"))
    names = ["doc_id", "source", "tokens"]
    sample = edge.select(*names, "passes", "drawn").unionByName(whole.select(*names, "passes", "drawn"))
    sample = sample.withColumn("repeats", F.col("passes") + F.col("drawn").cast("long")).where("repeats > 0").select(*names, "repeats", "drawn")
    sample = materialize(sample)
    used = sample.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"), F.sum(F.when(F.col("drawn"), F.col("tokens"))).alias("fraction_tokens"))
    mixed = used.agg(F.sum("actual_tokens").alias("mixed"))
    report = t.join(used, "source", "left").crossJoin(F.broadcast(mixed))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = report.select("source", "need", "own", "outcome", "passes", zero("fraction_tokens"), zero("actual_tokens"), (F.coalesce("actual_tokens", F.lit(0)) / F.col("mixed")).alias("actual_share"))
    return sample.select(*names, "repeats"), report

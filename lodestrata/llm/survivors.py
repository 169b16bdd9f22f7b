"""One record for each group of duplicates.

Groups are connected by links between records. What the records of a group
claim (a value of a field) is judged by a latent two-sided quality model: every
source has a sensitivity, the share of true values it states, and a
specificity, the share of false ones it does not state; both and the truth of
every value are inferred by expectation maximisation over all groups, so a
field with several values keeps each that is judged true. The surviving record
has the title and status judged most likely true; which of a group's rows stands for it,
and which of them has the most trusted title and the latest time, follows the
order of trust that the data's owner states.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.columns import plain, stored_seconds
from lodestrata.operators.components import connected_components
from lodestrata.session import discard, materialize

#: Fixed: statuses from the most trusted on; any other comes last.
STATUS_ORDER = ("canonical", "plan", "duplicate", "stale", "superseded")
#: Pseudo-counts (true, false) of sensitivity, and of stating false values; share of values true at first.
SENSITIVE, WRONG, PRIOR = (4.0, 2.0), (1.0, 9.0), 0.5
#: Change of sensitivities and specificities at which the rounds end. Rounds draw near slowly: at 2e-3 the last verdicts are still to change.
SETTLED = 1e-6
#: Claims of classes that the driver holds at most, some 100 bytes each.
HELD = 1_000_000
KEYS = ["group_id", "field"]


def linked_groups(docs: DataFrame, id_col: str = "id", link_col: str = "dup_of_id") -> DataFrame:
    """(id, group_id) of the records connected to another by links that name an existing record; group_id is the smallest id."""
    links = docs.select(F.col(id_col).alias("src"), F.col(link_col).alias("dst")).where("src is not null and dst is not null and src <> dst")
    known = docs.select(F.col(id_col).alias("dst")).where("dst is not null").distinct()
    return connected_components(links.join(known, "dst", "left_semi")).select("id", F.col("component").alias("group_id"))


def source_quality(claims: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(truths, sources) of claims(group_id, field, value, source).

    truths(group_id, field, value, probability, n_claims): every value that a
    source states in a group. sources(source, sensitivity, specificity). A source
    takes part in a group's field if it states any value of it; what it then does
    not state of the values others do, it denies. Rows with a null take no part,
    repeated claims count once, no claims give no rows. The rounds end when no
    source's sensitivity or specificity moves by SETTLED any more, which is when
    the model has no more to say; with rounds, after so many at the latest.

    Only what a source states differs from what it denies by a term, so a value's
    evidence is the sum of its group's sources' denials, taken once per group and
    field, and of the terms of those that state it: no pair of values and sources
    is made. Groups' fields in which the same sources state alike are one class
    with a weight, which is all that the rounds read: on the driver while the
    classes have at most HELD claims, else as joins.
    """
    claims = materialize(claims.select("group_id", "field", "value", "source").dropna().distinct())
    classes = materialize(_classes(claims))
    sources = _settled_here(classes, rounds) if classes.count() <= HELD else _settled(classes, rounds)
    truths = materialize(_judged(claims, claims.select(*KEYS, "source").distinct(), sources))
    for done in (claims, classes):
        discard(done)
    return truths, sources


def _classes(claims: DataFrame) -> DataFrame:
    """The distinct claims of one group's field of each class, with the number of its groups' fields as weight.

    Two are of one class if their values are stated by the same sets of sources,
    told by sums of hashes, 128 bits in all, that combine before the shuffle.
    """
    total = lambda *of: F.sum(F.xxhash64(*of).cast("decimal(20,0)"))
    stated = claims.groupBy(*KEYS, "value").agg(total("source").alias("a"), total(F.lit(1), "source").alias("b"))
    fields = stated.groupBy(*KEYS).agg(total("a", "b").alias("a"), total(F.lit(1), "a", "b").alias("b"))
    chosen = fields.groupBy("a", "b").agg(F.min(F.struct(*KEYS)).alias("one"), F.count("*").alias("weight"))
    return claims.join(chosen.select("one.*", "weight"), KEYS)


def _judged(claims: DataFrame, members: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_id, field, value, n_claims, probability) of the values claimed, by the quality of the sources."""
    yes, no = F.log(F.col("sensitivity") / (1 - F.col("specificity"))), F.log((1 - F.col("sensitivity")) / F.col("specificity"))
    terms = sources.select("source", no.alias("denied"), (yes - no).alias("gained"))
    denied = members.join(terms, "source").groupBy(*KEYS).agg(F.sum("denied").alias("denied"))
    gained = claims.join(terms, "source").groupBy(*KEYS, "value").agg(F.sum("gained").alias("gained"), F.count("*").alias("n_claims"))
    odds = F.lit(PRIOR / (1 - PRIOR)) * F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("denied") + F.col("gained"))))
    return gained.join(denied, KEYS).select(*KEYS, "value", "n_claims", (odds / (1 + odds)).alias("probability"))


def _settled(classes: DataFrame, rounds: int | None) -> DataFrame:
    """The sources' quality by rounds over classes of any number."""
    members = materialize(classes.select(*KEYS, "source", "weight").distinct())
    many = members.groupBy(*KEYS).agg(F.count("*").alias("n_sources"))
    # The first truths: the share of the group's sources that state a value.
    truths = materialize(classes.groupBy(*KEYS, "value").agg(F.count("*").alias("n_claims")).join(many, KEYS).select(*KEYS, "value", (F.col("n_claims") / F.col("n_sources")).alias("probability")))
    sources, made = None, 0
    while True:
        stated = classes.join(truths, [*KEYS, "value"]).groupBy("source").agg(F.sum(F.col("weight") * F.col("probability")).alias("true_stated"), F.sum(F.col("weight") * (1 - F.col("probability"))).alias("false_stated"))
        expected = truths.groupBy(*KEYS).agg(F.sum("probability").alias("true_in"), F.sum(1 - F.col("probability")).alias("false_in"))
        met = members.join(expected, KEYS).groupBy("source").agg(F.sum(F.col("weight") * F.col("true_in")).alias("true_in"), F.sum(F.col("weight") * F.col("false_in")).alias("false_in"))
        sensitivity = (F.col("true_stated") + SENSITIVE[0]) / (F.col("true_in") + sum(SENSITIVE))
        wrong = (F.col("false_stated") + WRONG[0]) / (F.col("false_in") + sum(WRONG))
        before, sources, made = sources, materialize(stated.join(met, "source").select("source", sensitivity.alias("sensitivity"), (1 - wrong).alias("specificity"))), made + 1
        discard(truths)
        moved = None
        if before is not None:
            moved = sources.join(before.toDF("source", "s", "t"), "source").agg(F.max(F.greatest(F.abs(F.col("sensitivity") - F.col("s")), F.abs(F.col("specificity") - F.col("t"))))).first()[0]
            discard(before)
        if (moved is not None and moved < SETTLED) or (rounds is not None and made >= rounds):
            break
        truths = materialize(_judged(classes, members, sources).select(*KEYS, "value", "probability"))
    discard(members)
    return sources


def _settled_here(classes: DataFrame, rounds: int | None) -> DataFrame:
    """The same by arrays on the driver."""
    rows = classes.orderBy(*KEYS, "value", "source").toArrow()
    code = {name: rows[name].combine_chunks().dictionary_encode() for name in (*KEYS, "value", "source")}
    at = {name: c.indices.to_numpy().astype(np.int64) for name, c in code.items()}
    n, k = len(code["source"].dictionary), at["source"]
    group = np.unique(at["group_id"] * len(code["field"].dictionary) + at["field"], return_inverse=True)[1]
    width = max(1, len(code["value"].dictionary))
    values, value = np.unique(group * width + at["value"], return_inverse=True)
    of = values // width
    weight = np.zeros(group.max(initial=-1) + 1)
    weight[group] = rows["weight"].to_numpy()
    member, source = np.divmod(np.unique(group * n + k), max(1, n))
    probability = np.bincount(value, minlength=len(values)) / np.bincount(member, minlength=len(weight))[of]
    quality, made = np.full((2, n), np.inf), 0
    while n:
        true, false = probability * weight[of], (1 - probability) * weight[of]
        share = [(np.bincount(k, x[value], n) + a) / (np.bincount(source, np.bincount(of, x, len(weight))[member], n) + a + b) for x, (a, b) in ((true, SENSITIVE), (false, WRONG))]
        before, quality, made = quality, np.stack([share[0], 1 - share[1]]), made + 1
        if np.abs(quality - before).max() < SETTLED or (rounds is not None and made >= rounds):
            break
        yes, no = np.log(share[0] / share[1]), np.log((1 - share[0]) / (1 - share[1]))
        denied, gained = np.bincount(member, no[source], len(weight)), np.bincount(value, (yes - no)[k], len(values))
        odds = PRIOR / (1 - PRIOR) * np.exp(np.clip(denied[of] + gained, -30, 30))
        probability = odds / (1 + odds)
    found = pa.table({"source": code["source"].dictionary, "sensitivity": quality[0], "specificity": quality[1]})
    typed = classes.select("source", F.lit(0.0).alias("sensitivity"), F.lit(0.0).alias("specificity")).schema
    return materialize(classes.sparkSession.createDataFrame(found, typed))


def trust(status: Column) -> Column:
    """The place of a plain status in the order of trust."""
    out = F.lit(len(STATUS_ORDER))
    for k, name in reversed(list(enumerate(STATUS_ORDER))):
        out = F.when(status == name, F.lit(k)).otherwise(out)
    return out


def claimed_rows(docs: DataFrame) -> DataFrame:
    """(id, group_id, source, status, at, title, said) of the records of groups of two or more: status plain, at the known time in seconds, said the plain title or null where it is empty or 'untitled'."""
    at, title = stored_seconds(F.col("mtime")), plain(F.col("title"))
    said = F.when(~title.isin("", "untitled"), title)
    rows = docs.select("id", F.coalesce("source_id", F.lit("")).alias("source"), plain(F.col("status")).alias("status"), at.alias("at"), "title", said.alias("said"))
    return rows.join(linked_groups(docs), "id")


def _place() -> tuple[Column, ...]:
    """What records are ordered by, the most trusted first."""
    return trust(F.col("status")).alias("rank"), F.coalesce(-F.col("at"), F.lit(float("inf"))).alias("late"), (-F.col("id")).alias("minus")


def most_trusted(rows: DataFrame) -> DataFrame:
    """(group_id, n_docs, survivor_id, status, title_id, title, mtime_id, mtime) of claimed_rows() by the order of trust.

    Records are ordered by plain status (canonical, plan, duplicate, stale,
    superseded, then any other), later known time of mtime, unknown last, and
    larger id: survivor_id is the first, title_id the first with a title that is
    neither empty nor 'untitled' (null if there is none), mtime_id the one with
    the latest known time, the larger id on a tie (null if none is known). Each
    is an aggregate that combines before the shuffle.
    """
    place = _place()
    titled = F.when(F.col("said").isNotNull(), F.struct(*place, "id", "title"))
    dated = F.when(F.col("at").isNotNull(), F.struct("at", "id"))
    picked = rows.groupBy("group_id").agg(F.count("*").alias("n_docs"), F.min(F.struct(*place, "id", "status")).alias("first"), F.min(titled).alias("titled"), F.max(dated).alias("dated"))
    return picked.select("group_id", "n_docs", F.col("first.id").alias("survivor_id"), F.col("first.status").alias("status"), F.col("titled.id").alias("title_id"), F.col("titled.title").alias("title"), F.col("dated.id").alias("mtime_id"), F.col("dated.at").alias("mtime"))


def judged(rows: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """source_quality() of what claimed_rows() say of the fields title, status and mtime (to the second)."""
    field = lambda name, value: rows.select("group_id", F.lit(name).alias("field"), value.alias("value"), "source")
    claims = field("title", F.col("said")).unionByName(field("status", F.nullif(F.col("status"), F.lit("")))).unionByName(field("mtime", F.round("at").cast("long").cast("string")))
    return source_quality(claims, rounds)


def survivors(docs: DataFrame, rounds: int | None = None, keep: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, truths, sources) of docs(id, source_id, status, dup_of_id, mtime, title).

    records: one row per group of two or more records, as most_trusted() has it,
    but with the title and status that the model judges most likely true (on a
    tie the most trusted), the title as its most trusted record writes it, and
    title_probability, status_probability and mtime_probability of the values
    kept; where a group claims none, they are null. titles and statuses hold
    every plain value judged true with at least the probability keep, in order.
    truths: those values of every field, a row each; sources as source_quality()
    has them. A null source is a source of its own. Repeated rows change nothing
    but n_docs; no groups give no rows.
    """
    rows = materialize(claimed_rows(docs))
    truths, sources = judged(rows, rounds)
    kept = truths.where(F.col("probability") >= keep)
    out = most_trusted(rows).drop("title", "status")
    place = F.struct(*_place())
    for field, value, shown in (("title", "said", "title"), ("status", "status", "status")):
        said = rows.where(F.nullif(F.col(value), F.lit("")).isNotNull()).groupBy("group_id", F.col(value).alias("value")).agg(F.min(place).alias("place"), F.min_by(shown, place).alias("shown"))
        met = truths.where(F.col("field") == field).join(said, ["group_id", "value"])
        one = met.groupBy("group_id").agg(F.min_by(F.struct("shown", "probability"), F.struct(-F.col("probability"), "place")).alias("one"), F.sort_array(F.collect_list(F.when(F.col("probability") >= keep, F.col("value")))).alias("true"))
        out = out.join(one.select("group_id", F.col("one.shown").alias(field), F.col("one.probability").alias(f"{field}_probability"), F.col("true").alias(f"{field}s" if field == "title" else "statuses")), "group_id", "left")
    dated = truths.where(F.col("field") == "mtime").select("group_id", F.col("value").alias("_second"), F.col("probability").alias("mtime_probability"))
    out = out.withColumn("_second", F.round("mtime").cast("long").cast("string")).join(dated, ["group_id", "_second"], "left").drop("_second")
    none = F.array().cast("array<string>")
    return out.withColumns({"titles": F.coalesce("titles", none), "statuses": F.coalesce("statuses", none)}), kept, sources

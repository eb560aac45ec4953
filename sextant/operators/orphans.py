"""References to records that do not exist (problem 7).

Every change is a signed delta on a key: a record that appears is +1 existence, one that goes is -1,
a reference is +1 (or -1 when withdrawn). A key with positive references and zero existence is an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.runtime import materialise, running_total

#: Leading letters of a printed kind -> prefix of the unit's id.
KIND_PREFIX = {"art": "art", "ann": "anx", "anx": "anx", "rec": "rct", "rct": "rct", "sec": "sec", "act": "act"}


def existence_deltas(records: DataFrame, key: str, added: str, deleted: str) -> DataFrame:
    """(key, t, delta): +1 when a record is added, -1 when it is deleted; the same delivery twice counts once.

    Null keys and null times give no delta.
    """
    up = records.select(F.col(key).alias("key"), F.col(added).alias("t"), F.lit(1).alias("delta"))
    down = records.select(F.col(key).alias("key"), F.col(deleted).alias("t"), F.lit(-1).alias("delta"))
    return up.unionByName(down).dropna().distinct()


def apply_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts per key after one more batch of deltas.

    Both inputs are (key, n_references, n_existing); the sums are pre-aggregated map-side, so a hot key
    costs one row per task. Keys whose counts return to zero leave the state.
    """
    both = state.unionByName(deltas.select("key", "n_references", "n_existing"))
    summed = both.groupBy("key").agg(F.sum("n_references").alias("n_references"), F.sum("n_existing").alias("n_existing"))
    return summed.filter((F.col("n_references") != 0) | (F.col("n_existing") != 0))


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and no existence."""
    return state.filter((F.col("n_references") > 0) & (F.col("n_existing") <= 0))


def counted_at(references: DataFrame, existence: DataFrame) -> DataFrame:
    """``references`` (with key and t) that are orphans, with ``reason``: by the signed count of their key at their time.

    References (+1 reference) and ``existence`` (key, t, delta) are one stream of signed changes. Along each key, in order
    of time, the existence count runs; a reference at whose time it is not positive is an orphan. The running count is made
    over range partitions, so neither a key with a third of all references nor one with many changes is gathered. Changes
    at the time of a reference count; a reference without a time (null) comes after all changes, a change without one
    before all. ``reason`` is late if the key is added later, else deleted if it was, else missing.
    """
    cols = references.columns
    kept = references.withColumn("_id", F.monotonically_increasing_id())
    asked = materialise(kept)
    place = F.when(F.col("t").isNull(), F.when(F.col("_id").isNull(), 0).otherwise(2)).otherwise(1)
    signed = asked.select("key", "t", "_id", F.lit(0).alias("delta")).unionByName(existence.select("key", "t", F.lit(None).cast("long").alias("_id"), "delta"))
    # keys that nothing refers to need no count; of equal times the changes come first, the greater ones first of all
    live = running_total(
        signed.withColumn("_place", place), ["key"], [F.col("_place"), F.col("t"), F.col("_id").asc_nulls_first(), F.col("delta").desc()], F.col("delta"), "n_existing"
    ).filter("_id IS NOT NULL AND n_existing <= 0").select("_id")
    per_key = existence.groupBy("key").agg(F.max(F.when(F.col("delta") > 0, F.col("t"))).alias("_last"), F.min(F.when(F.col("delta") < 0, F.col("t"))).alias("_first"))
    orphan = asked.join(live, "_id", "left_semi").join(per_key, "key", "left")
    reason = F.when(F.col("_last") > F.col("t"), "late").when(F.col("_first").isNotNull() & (F.col("t").isNull() | (F.col("_first") <= F.col("t"))), "deleted").otherwise("missing")
    return orphan.select(*cols, reason.alias("reason"))


def unit_of_surface(doc: Column, surface: Column) -> Column:
    """Unit id meant by a printed reference such as ``Art. 7(2)(a)`` inside ``doc``; null if it names none.

    Letter case, the abbreviation of the kind and bracketed sub-points do not matter.
    """
    bare = F.trim(F.regexp_replace(surface, r"\([^)]*\)", ""))
    kind = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+)", 1))
    number = F.regexp_extract(bare, r"^[A-Za-z]+\.?\s*(\S+)$", 1)
    prefix = F.lit(None).cast("string")
    for lead, short in KIND_PREFIX.items():
        prefix = F.when(F.substring(kind, 1, 3) == lead, F.lit(short)).otherwise(prefix)
    known = F.lower(kind).rlike("^(art(icle)?|ann(ex)?|anx|rec(ital)?|rct|sec(tion)?|act(ion)?)$")
    plain = F.concat(doc, F.lit(":"), prefix, F.lit("_"), F.upper(number))
    sub = F.concat(doc, F.lit(":sub_"), F.upper(kind), F.lit("_"), number)
    return F.when((number == "") | surface.isNull(), None).when(known, plain).otherwise(sub)


def references(relations: DataFrame, found: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The single references of relations, the candidate lists, and the answers' keys.

    Records delivered twice count once (the whole reference is compared). Null and empty arrays hold none.
    """
    r = relations.select("relation_id", "unit_id", "structural_join", "prose_xrefs", "prose_xrefs_dropped", "recorded_at")
    doc = F.substring_index("unit_id", ":", 1)

    def of(name: str, array: str, ref: Column, target: Column, keep: Column | None = None) -> DataFrame:
        x = r.select("relation_id", "unit_id", "recorded_at", F.explode(array).alias("x"))
        x = x if keep is None else x.filter(keep)
        return x.select(
            F.lit(name).alias("source_table"), F.col("relation_id").cast("string").alias("source_key"),
            ref.alias("ref"), target.alias("key"), F.col("recorded_at").alias("t"),
        )

    single = (
        of("relations.structural_join", "structural_join", F.col("x.unit_id"), F.col("x.unit_id"))
        .unionByName(of("relations.prose_xrefs", "prose_xrefs", F.col("x.target"), F.col("x.target")))
        .unionByName(of("relations.prose_xrefs_dropped", "prose_xrefs_dropped", F.col("x.surface"), unit_of_surface(doc, F.col("x.surface")), F.col("x.classification") == "internal"))
        .filter(F.col("ref").isNotNull())
        .distinct()
    )
    several = found.select(
        F.lit("found_references").alias("source_table"), F.col("reference_id").cast("string").alias("source_key"),
        F.col("surface").alias("ref"), "candidates", F.col("seen_at").alias("t"),
    ).filter(F.size("candidates") > 0).distinct()
    asked = answers.select(
        F.lit("answers").alias("source_table"), F.col("custom_id").alias("source_key"),
        F.col("custom_id").alias("ref"), F.col("custom_id").alias("key"), F.col("collected_at").alias("t"),
    ).filter(F.col("ref").isNotNull())
    return single, several, asked


def orphan_references(relations: DataFrame, found: DataFrame, answers: DataFrame, units: DataFrame, requests: DataFrame) -> DataFrame:
    """(source_table, source_key, ref, reason, period): the references that point at nothing live at their time.

    All references, candidates and answers' keys go through the signed counts of ``counted_at`` together; requests exist
    from the beginning of time. References without a key name nothing and are missing. A list of candidates is an orphan
    if all of them are, with the first of late, deleted, missing that any has. A second delivery counts once, for answers
    with the earliest time. Empty tables give no rows.
    """
    single, several, asked = references(relations, found, answers)
    several = several.withColumn("n", F.size(F.array_distinct("candidates")))
    cand = several.select("source_table", "source_key", "ref", "t", "n", F.explode(F.array_distinct("candidates")).alias("key"))
    first = asked.groupBy("source_table", "source_key", "ref", "key").agg(F.min("t").alias("t"))
    none = F.lit(None).cast("int").alias("n")
    every = single.select("source_table", "source_key", "ref", "t", none, "key").unionByName(cand).unionByName(first.select("source_table", "source_key", "ref", "t", none, "key"))
    # units and requests have keys of different forms; the kind of key keeps them apart in any case
    kind = lambda df, k: df.withColumn("key", F.concat(F.lit(k), F.col("key")))
    mark = F.when(F.col("source_table") == "answers", "request ").otherwise("unit ")
    known = requests.select(F.col("custom_id").alias("key")).dropna().distinct().select("key", F.lit(None).cast(every.schema["t"].dataType).alias("t"), F.lit(1).alias("delta"))
    units_at = existence_deltas(units, "unit_id", "added_at", "deleted_at")
    existence = kind(units_at, "unit ").unionByName(kind(known, "request "))
    orphan = counted_at(every.filter("key IS NOT NULL").withColumn("key", F.concat(mark, F.col("key"))), existence)
    nameless = every.filter("key IS NULL").withColumn("reason", F.lit("missing"))
    orphan = orphan.unionByName(nameless)
    period = F.date_format("t", "yyyy-MM").alias("period")
    rank = F.when(F.col("reason") == "late", 1).when(F.col("reason") == "deleted", 2).otherwise(3)
    reason = F.element_at(F.array(F.lit("late"), F.lit("deleted"), F.lit("missing")), F.min(rank)).alias("reason")
    # a single reference printed twice by one record is one orphan; a list is one if none of its candidates is live
    out = orphan.groupBy("source_table", "source_key", "ref", "t", "n").agg(reason, F.count("*").alias("dead")).filter("n IS NULL OR dead = n")
    return out.select("source_table", "source_key", "ref", "reason", period).distinct()


def reference_state(relations: DataFrame, found: DataFrame, answers: DataFrame, units: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, n_references, n_existing): the signed counts of every key after all deltas."""
    single, several, asked = references(relations, found, answers)
    refs = single.select("key").unionByName(several.select(F.explode(F.array_distinct("candidates")).alias("key"))).unionByName(asked.select("key").distinct())
    refs = refs.filter(F.col("key").isNotNull()).select("key", F.lit(1).alias("n_references"), F.lit(0).alias("n_existing"))
    ex = existence_deltas(units, "unit_id", "added_at", "deleted_at").select("key", F.lit(0).alias("n_references"), F.col("delta").alias("n_existing"))
    rq = requests.select(F.col("custom_id").alias("key")).dropna().distinct().select("key", F.lit(0).alias("n_references"), F.lit(1).alias("n_existing"))
    return apply_deltas(refs, ex.unionByName(rq))

"""Silver + manual entries -> categorised Gold."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions import packed, unpacked
from passbook.operators import categories as cat
from passbook.operators.batching import assign_batches, shard_digits
from passbook.operators.dedupe import dedupe_keep_last, keep_first, union_sources
from passbook.operators.enrichment import CATEGORIZE_RETRIES, categorize_with_model
from passbook.operators.manual import has_explicit_category, manual_to_gold
from passbook.plans.workspace import Workspace
from passbook.scratch import scratch_folder
from passbook.schemas import GOLD, GOLD_CONTRACT, MANUAL_SOURCE, UNSET_CATEGORY, conform
from passbook.sources.tables import TableMissing

FIGURES = "already_categorized bigint, new_rows bigint, still_uncategorized bigint"


def source_rows(silver: DataFrame, manual: DataFrame) -> DataFrame:
    """Contract rows of both sources with the category a person chose and the priority of the source."""
    statements = conform(silver, GOLD_CONTRACT).withColumn("_chosen", F.lit(None).cast("string"))
    chosen = F.when(has_explicit_category(F.col("category")), F.col("category"))
    # the choice travels with the row, so no override join is needed
    logged = manual_to_gold(manual.withColumn("_chosen", chosen), keep=["_chosen"])
    return union_sources(statements, logged)


def last_entries(manual: DataFrame) -> DataFrame:
    """One row per manual entry, the one ``dedupe_keep_last`` keeps; ties are settled by the other columns."""
    order = ["merchant", "logged_at", "txn_date", "amount", "category"]
    return keep_first(manual, ["entry_id"], [F.desc(c) for c in order])


def resolve(combined: DataFrame, cache: DataFrame) -> DataFrame:
    """Chosen, else cached category; NULL and origin NULL where neither exists. One join."""
    known = cache.select("txn_key_hash", F.col("category").alias("_cached"))
    return (
        combined.join(known, "txn_key_hash", "left")
        .withColumn("category", F.coalesce("_chosen", "_cached"))
        .withColumn(
            "category_origin",
            F.when(F.col("_cached").isNotNull(), "cache").when(F.col("_chosen").isNotNull(), "override"),
        )
        .drop("_chosen", "_cached")
    )


def apply_rules(resolved: DataFrame) -> DataFrame:
    """Fill what is open from the keyword rules, in place."""
    rule = cat.rule_category(F.col("description"), F.col("amount"))
    return resolved.withColumns(
        {
            "category": F.coalesce("category", rule),
            "category_origin": F.coalesce("category_origin", F.lit("rule")),
        }
    )


def settled(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """``resolve`` of the row that counts for each key; keys are packed while rows are dealt by them."""
    key = "txn_key_hash"
    rows, cache = (df.withColumn(key, packed(F.col(key))) for df in (rows, cache))
    return resolve(dedupe_keep_last(rows), cache).withColumn(key, unpacked(F.col(key)))


def categorized_gold(silver: DataFrame, manual: DataFrame, cache: DataFrame) -> DataFrame:
    """Gold under the default rules, as one lazy plan."""
    return apply_rules(settled(source_rows(silver, manual), cache)).select(GOLD.names)


def apply_model(resolved: DataFrame, load: Callable, folder: str, policy, tasks, store=None) -> DataFrame:
    """Fill what is open from a model; only those rows are batched and sent."""
    spark = resolved.sparkSession
    resolved.write.parquet(f"{folder}/resolved")
    resolved = spark.read.parquet(f"{folder}/resolved")
    unknown = resolved.filter(F.col("category").isNull())
    n = unknown.count()
    if not n:
        return resolved
    batched = assign_batches(unknown.select("txn_key_hash", "description", "amount"), shard_digits(n))
    answers = categorize_with_model(batched, load, f"{folder}/model", policy, tasks, store=store)
    answered = answers.select(
        "txn_key_hash", F.col("category").alias("_answer"), F.col("origin").alias("_origin")
    )
    return (
        resolved.join(answered, "txn_key_hash", "left")
        .withColumn("category", F.coalesce("category", "_answer", F.lit(UNSET_CATEGORY)))
        .withColumn("category_origin", F.coalesce("category_origin", "_origin"))
        .drop("_answer", "_origin")
    )


def slice_marks(rows: DataFrame, slice_of: Column) -> dict[int, str]:
    """What the rows of every slice amount to: their number and two sums over hashes, whatever their order.

    Aggregated before the shuffle, so one small row per task and slice is sent.
    """
    values = [F.col(c) for c in rows.columns]
    first, second = (F.xxhash64(F.lit(i), *values) for i in (1, 2))
    marks = rows.groupBy(slice_of.alias("slice")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(first).alias("x"), F.sum(second.cast("decimal(20,0)")).alias("s")
    )
    return {r["slice"]: f"{r['n']}:{r['x']}:{r['s']}" for r in marks.collect()}


def cache_mark(cache: DataFrame) -> str:
    """Tells two states of the cache, a log, apart; reads one column."""
    n, last = cache.agg(F.count(F.lit(1)), F.max(F.unix_micros("decided_at"))).first()
    return f"{n}:{last}"


def redecided_slices(gold: DataFrame, known: DataFrame, slice_of: Column) -> set[int]:
    """Slices that hold a row whose decision is missing from ``known`` or another there. One join on the key."""
    now = known.select("txn_key_hash", F.col("category").alias("_known"))
    changed = gold.join(now, "txn_key_hash", "left").where(~F.col("category").eqNullSafe(F.col("_known")))
    return {r[0] for r in changed.select(slice_of).distinct().collect()}


def with_moved_entries(touched: set[int], manual: DataFrame, gold: DataFrame, slice_of: Column) -> set[int]:
    """``touched`` and every slice that a manual entry with a row there, now or in Gold, has other rows in:
    the row that counts may have moved. ``gold`` holds the touched slices."""
    logged = manual_to_gold(manual).select("txn_key_hash", slice_of.alias("slice"))
    here = logged.where(F.col("slice").isin(*touched)).select("txn_key_hash")
    there = gold.where(F.col("source_type") == MANUAL_SOURCE).select("txn_key_hash")
    found = logged.join(here.unionByName(there), "txn_key_hash", "left_semi")
    return touched | {r[0] for r in found.select("slice").distinct().collect()}


def build_gold(
    workspace: Workspace,
    load: Callable | None = None,
    retry_fallbacks: bool = False,
    policy=CATEGORIZE_RETRIES,
    tasks: int | None = None,
) -> DataFrame:
    """Publish Gold and append the newly decided categories to the cache; returns the figures.

    Gold lies in months. A month is made again if its rows in Silver and in the manual entries are not those
    it was made from, or if the cache holds other decisions for it; all others stay as they are, and with
    nothing to do nothing is written. Finding that out takes one pass without a shuffle. The keys of
    statements are hashes over the day, so only manual entries can have rows in several months; those months
    are made together. Decisions are compared only when the cache was changed since by others, when a model
    is given or fallbacks are to be retried.

    Within its month Gold is range-partitioned by date and key, so a month that holds a third of all rows is
    still split evenly. A run stopped before its decisions are in the cache is completed by the next.
    """
    if not workspace.silver.exists():
        raise TableMissing(f"{workspace.silver.path}: refine first")
    gold, month = workspace.gold, workspace.gold.slice_of
    silver, manual, stored_cache = workspace.silver.read(), workspace.manual.read(), workspace.cache.read()
    cache = cat.readable_cache(stored_cache, retry_fallbacks, with_model=load is not None)
    marks, version = slice_marks(source_rows(silver, manual), month), gold.latest()
    state = gold.slices(version) or {}
    known_cache, noted = cache_mark(stored_cache), gold.noted(version) if version else None

    touched = None  # everything
    if state and all(r.mark is not None for r in state.values()):
        touched = {s for s in marks.keys() | state.keys() if s not in state or s not in marks or state[s].mark != marks[s]}
        if touched:
            touched = with_moved_entries(touched, manual, gold.read(slices=touched), month)
        if load is not None or retry_fallbacks or noted != known_cache:
            touched |= redecided_slices(gold.read(slices=state.keys() - touched), cache, month)

    new = 0
    if touched is None or touched:
        rows = source_rows(silver, last_entries(manual))
        rows = rows if touched is None else rows.where(month.isin(*touched))
        resolved = settled(rows, cache)
        if load is None:
            done = apply_rules(resolved)
        else:
            done = apply_model(resolved, load, scratch_folder(workspace.spark, "gold"), policy, tasks, workspace.answers)
        version = gold.write(done, replaced=touched, marks=marks)
        gold.show(version)
        state = gold.slices(version)
        made = [s for s, r in state.items() if r.folder == version]
        new = sum(state[s].figures["new"] for s in made)
        decided = gold.read(stored=True, slices=made).filter(F.col("category_origin") != "cache")
        workspace.cache.append(cat.cache_entries(decided, F.col("category_origin")))
        gold.note(version, cache_mark(workspace.cache.read()))
    elif noted != known_cache:
        gold.note(version, known_cache)

    rows, unset = (sum(r.figures[name] for r in state.values()) for name in ("rows", "unset"))
    return workspace.spark.createDataFrame([(rows - new, new, unset)], FIGURES)

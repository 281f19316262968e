"""Keeping the search index in step with Gold."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from passbook.operators import index as ix
from passbook.operators.quality import require_rows
from passbook.plans.gold import slice_marks
from passbook.plans.workspace import Workspace
from passbook.schemas import require_columns, require_names
from passbook.sources.tables import TableMissing

GOLD_NEEDED = ("txn_key_hash", "txn_date", "description", "amount", "category", "source_type")


def build_index(gold: DataFrame, load=None) -> DataFrame:
    """A complete index of Gold, every document embedded."""
    return ix.embed(ix.index_documents(require_columns(gold, GOLD_NEEDED)), "document", load)


def sync_index(workspace: Workspace, load=None) -> dict:
    """Publish the index of the current Gold; only new or changed documents are embedded, only the
    buckets that hold a change are written, and an index that is up to date is left alone.

    Buckets are told apart by a count and two hash sums over the ids and hashes of either side, which needs no
    shuffle. The rows of both sides in the buckets that differ are dealt once; vectors of new documents are made there."""
    if not workspace.gold.exists():
        raise TableMissing(f"{workspace.gold.path}: build gold first")
    index = workspace.index
    require_names(workspace.gold.stored_columns(), GOLD_NEEDED)
    gold = require_rows(workspace.gold.read(), "gold")
    rows, buckets, figures = gold.count(), len(index.latest()), Observation()

    def finish(dealt: DataFrame) -> DataFrame:
        return ix.merged(dealt, figures, load)

    if not buckets:
        index.publish(ix.gold_side(gold), finish=lambda dealt: ix.all_new(dealt, load), rows=rows)
        return {"upserted": rows, "removed_stale": 0, "re_embedded": rows}
    if index.outgrown(rows):
        index.publish(ix.both_sides(index.read(), gold), finish=finish, rows=rows)
    else:
        bucket = index.bucket(buckets)
        was, now = (
            slice_marks(side.select("id", "document_hash"), bucket) for side in (index.read(), ix.index_documents(gold))
        )
        touched = sorted(b for b in was.keys() | now.keys() if was.get(b) != now.get(b))
        if not touched:
            return {"upserted": rows, "removed_stale": 0, "re_embedded": 0}
        here = gold.withColumn("id", F.col("txn_key_hash")).filter(bucket.isin(touched)).drop("id")
        index.replace(ix.both_sides(index.read(touched), here), touched, finish)
    return {**figures.get, "upserted": rows}

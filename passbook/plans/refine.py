"""Bronze -> Silver and quarantine, recomputed as a whole."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from passbook.operators.dedupe import dedupe_cleaned
from passbook.operators.quality import clean_rows, require_rows, split_valid
from passbook.plans.workspace import Workspace
from passbook.schemas import EmptyTable


class AllRowsInvalid(ValueError):
    """Every row was quarantined: the rules do not fit the data."""


@dataclass
class RefineResult:
    rows_read: int
    rows_valid: int
    rows_quarantined: int
    rows_published: int


def silver_rows(bronze: DataFrame) -> DataFrame:
    """Valid rows, one per business key."""
    return dedupe_cleaned(clean_rows(bronze))


def quarantined_rows(bronze: DataFrame) -> DataFrame:
    _, bad = split_valid(clean_rows(bronze))
    return bad


def refine(workspace: Workspace) -> RefineResult:
    """Publish both tables. The counts ride along with the Silver write.

    Quarantine is a second scan rather than a cached transform: cleaning is cheap next to storing
    a copy of every row, and the second pass neither shuffles nor touches the valid rows.
    """
    bronze = require_rows(workspace.bronze.read(), "bronze")
    seen = Observation()
    reason = F.col("quarantine_reason")
    cleaned = clean_rows(bronze).observe(
        seen,
        F.count(F.lit(1)).alias("read"),
        F.count_if(reason.isNull()).alias("valid"),
        F.count_if(reason.isNotNull()).alias("bad"),
    )
    try:
        version = workspace.silver.write(dedupe_cleaned(cleaned))
    except EmptyTable as error:
        workspace.quarantine.publish(quarantined_rows(bronze))
        raise AllRowsInvalid("no row passed the checks; see the quarantine table") from error
    workspace.quarantine.publish(quarantined_rows(bronze), allow_empty=True)
    workspace.silver.show(version)
    counts = seen.get
    published = workspace.silver.read().count()
    return RefineResult(counts["read"], counts["valid"], counts["bad"], published)

"""The two buttons: everything, or Gold and index only."""

import logging

from pyspark.sql import DataFrame

from passbook.plans.gold import build_gold
from passbook.plans.indexing import sync_index
from passbook.plans.ingest import ingest
from passbook.plans.refine import refine
from passbook.plans.workspace import Workspace

log = logging.getLogger(__name__)


def _sync_quietly(workspace: Workspace, load_embedder):
    try:
        return sync_index(workspace, load_embedder)
    except Exception:  # Gold is published and stays valid
        log.exception("index sync failed")
        return None


def quick_refresh(workspace: Workspace, load_model=None, load_embedder=None) -> dict:
    gold = build_gold(workspace, load_model)
    return {"gold": gold.first().asDict(), "index": _sync_quietly(workspace, load_embedder)}


def full_run(
    workspace: Workspace,
    folder: str,
    table_rows: DataFrame | None = None,
    load_model=None,
    load_embedder=None,
) -> dict:
    """Nothing new to ingest is not an error; the later layers run on what is there."""
    batch = ingest(workspace, folder, table_rows)
    counts = refine(workspace)
    return {"ingest": batch, "refine": counts, **quick_refresh(workspace, load_model, load_embedder)}

"""Statement analytics on Spark: ingest, clean, categorise, report, search."""

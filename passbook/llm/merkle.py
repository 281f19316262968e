"""Merkle manifest of a dataset: leaves, source roots, one root, and a proof for every row.

Leaves are numbered within their source. A run is ``FAN`` neighbouring nodes; the node at slot 0 of a run
computes the indices of its siblings, meets them in an equijoin of the level with itself, and emits the
parent. Levels shrink by ``FAN``; all sources climb together, each as far as its size takes it. The roots
of the sources are the leaves of one more tree. Proofs are handed down the same way: a run joins the path
of its parent, and its children add their siblings, so only the last step touches as many rows as there
are documents. Every level is a written table.

Defined results: any column may be null (written as ``-``); an empty text is ``0:``; leaves of a source are
in order of doc_id (null first), equal ids in order of their digests, so repeated rows are neighbours; a
source of one row is its own root; an empty table gives no rows. Other columns are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.order import numbered_sources, running
from passbook.scratch import scratch_folder, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A step of a proof: the siblings on the left and on the right, as the text that goes into the hash.
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*values: Column) -> Column:
    """sha256 over the values, each with its length in bytes, so that no two rows share their input."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _runs(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(g, run, n, digest, kids): the parents that the nodes at slot 0 emit, from nodes (g, i, n, digest).

    ``n`` is the number of nodes of the group on their level, so siblings beyond the end are not asked for.
    """
    offsets = F.sequence(F.lit(0), F.least(F.lit(FAN - 1), F.col("n") - 1 - F.col("i")).cast("int"))
    zero = nodes.where(F.col("i") % FAN == 0).select("g", "n", (F.col("i") / FAN).cast("long").alias("run"), F.col("i").alias("at"), F.explode(offsets).alias("slot"))
    asked = zero.select("g", "n", "run", "slot", (F.col("at") + F.col("slot")).alias("i"))
    met = asked.join(nodes.drop("n"), ["g", "i"])
    kids = F.array_sort(F.collect_list(F.struct("slot", "digest", *payload)))
    runs = met.groupBy("g", "n", "run").agg(kids.alias("kids"))
    return runs.withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256))


def climb(nodes: DataFrame, payload: list[str], folder: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, lowest first, and the tops (g, level, digest) of all groups."""
    levels, tops = [], nodes.where("n = 1").select("g", F.lit(0).alias("level"), "digest")
    while not nodes.where("n > 1").isEmpty():
        runs = written(_runs(nodes.where("n > 1"), payload), folder, f"{name}-{len(levels)}")
        levels.append(runs)
        payload = []
        nodes = runs.select("g", F.col("run").alias("i"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), "digest")
        tops = tops.unionAll(nodes.where("n = 1").select("g", F.lit(len(levels)).alias("level"), "digest"))
    return levels, tops


def _siblings(kids: str, kid: str) -> Column:
    """The step of a proof for one child of a run."""
    slot = F.col(f"{kid}.slot")
    side = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda k: k["digest"]), "")
    return F.struct(side(lambda k: k["slot"] < slot).alias("left"), side(lambda k: k["slot"] > slot).alias("right"))


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, kid, path, carried columns of ``tops``): the lowest nodes of all groups that have runs, with their proofs.

    ``tops`` has the group, the level of its top, the path from there on, and columns to carry down.
    """
    carried = [c for c in tops.columns if c not in ("g", "level", "path")]
    paths = None
    for level in range(len(levels), 0, -1):
        here = tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("run"), "path", *carried)
        if paths is not None:
            here = here.unionByName(paths.select("g", F.col("kid.slot").alias("slot"), "up", "path", *carried).select("g", (F.col("up") * FAN + F.col("slot")).alias("run"), "path", *carried))
        met = levels[level - 1].drop("digest", "n").join(here, ["g", "run"])
        each = met.select("g", F.col("run").alias("up"), "kids", F.explode("kids").alias("kid"), F.col("path").alias("_path"), *carried)
        path = F.concat(F.array(_siblings("kids", "kid")), "_path").cast(PATH)
        paths = each.select("g", "up", "kid", path.alias("path"), *carried)
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, found, subroot, root, path, for every row of ``docs``.

    ``found`` is the digest of the row as somebody else found it: of the text ``tampered`` instead of its
    own; the path is a proof of the row as it was.
    """
    folder = scratch_folder(docs.sparkSession, "merkle")
    values = [F.col(f) for f in FIELDS]
    found = leaf_digest(*values[:-1], F.col("text") if tampered is None else tampered)
    leaves = written(docs.select("doc_id", "source", leaf_digest(*values).alias("digest"), found.alias("found")), folder, "leaves")

    sources = written(numbered_sources(leaves.groupBy("source").agg(F.count("*").alias("n")), False, folder), folder, "numbered")
    known = sources.withColumnsRenamed({"source": "_source", "number": "g"})
    grouped = leaves.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    grouped = grouped.withColumns({"_one": F.lit(1), "_known": F.col("doc_id").isNotNull().cast("int")})
    placed = running(grouped, ["g"], ["_known", "doc_id", "digest"], "_one", folder, "placed")
    nodes = written(placed.withColumnRenamed("before", "i").drop("_one", "_known"), folder, "nodes")
    payload = ["doc_id", "source", "found"]
    levels, tops = climb(nodes, payload, folder, "runs")
    tops = written(tops, folder, "subroots")

    # The tree above the sources: one group, whose leaves are the subroots.
    count = sources.count()
    above = tops.select(F.lit(0).alias("g"), F.col("g").alias("i"), F.lit(count).cast("long").alias("n"), "digest", F.col("g").alias("source_no"), "level")
    upper, top = climb(above, ["source_no", "level"], folder, "upper")
    root = top.select("digest").first()
    root = F.lit(root[0] if root else None).cast("string")
    empty = F.array().cast(PATH)
    if upper:
        ends = top.select("g", "level", empty.alias("path"))
        ends = descend(upper, ends).select(F.col("kid.source_no").alias("g"), "kid.level", F.col("kid.digest").alias("subroot"), "path")
    else:
        ends = tops.select("g", "level", F.col("digest").alias("subroot"), empty.alias("path"))
    ends = written(ends, folder, "ends")

    alone = nodes.where("n = 1").join(ends.where("level = 0"), "g").select(*payload, F.col("digest").alias("leaf"), "subroot", "path")
    out = alone
    if levels:
        many = descend(levels, ends).select("kid.doc_id", "kid.source", "kid.found", F.col("kid.digest").alias("leaf"), "subroot", "path")
        out = many.unionByName(alone)
    return out.withColumn("root", root)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(touched, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    proofs = manifest(docs, text).withColumn("folded_root", fold(F.col("found"), F.col("path")))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

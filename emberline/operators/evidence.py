"""Evidence of a run: candidates with their documents, measures and the place that the signal map gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def own_documents(candidates: DataFrame, documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Each document that candidates (candidate, document_ids) name, with its position in the list; unknown ids drop out."""
    each = candidates.select("candidate", F.posexplode("document_ids").alias("pos", doc_id))
    return each.join(documents, doc_id)


def evidence(features: DataFrame, candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """features of those who are candidates (by term), with the term's statistics where there are some."""
    return features.join(candidates, "term").join(stats, "term", "left")


def signal_map(rows: DataFrame, cards: DataFrame, scored: DataFrame, excluded: DataFrame) -> DataFrame:
    """evidence rows with their status: top (has a card), else excluded, else below (has a score), else pending; and whether
    a measure is missing, so that the map can't place it. The other tables are read by their term."""
    out = rows
    for name, other in (("card", cards), ("scored", scored), ("excluded", excluded)):
        out = out.join(other.select("term", F.lit(True).alias(f"_{name}")).distinct(), "term", "left")
    status = F.when(F.col("_card"), "top").when(F.col("_excluded"), "excluded").when(F.col("_scored"), "below").otherwise("pending")
    unplaced = F.col("total_pubs").isNull() | F.col("recent_share").isNull()
    return out.withColumn("status", status).withColumn("unplaced", unplaced).drop("_card", "_scored", "_excluded")


def training_names(*sources: tuple[DataFrame, list[str] | None]) -> DataFrame:
    """(name, label, kind) of several sources, of each the given kinds (None: all); rows without a name drop out."""
    out = None
    for rows, kinds in sources:
        part = rows.select("name", F.col("label").cast("int").alias("label"), "kind")
        part = part if kinds is None else part.where(F.col("kind").isin(*kinds))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("name").isNotNull())


def labels_by_id_or_name(rows: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """rows (id, name, ...) with the label of their id, else that of their lower-cased name."""
    own = by_id.select("id", F.col("label").alias("_own"))
    named = by_name.select(F.lower("name").alias("_name"), F.col("label").alias("_named"))
    both = rows.join(own, "id", "left").join(named, F.lower(rows["name"]) == F.col("_name"), "left")
    return both.withColumn("label", F.coalesce("_own", "_named")).drop("_own", "_named", "_name")

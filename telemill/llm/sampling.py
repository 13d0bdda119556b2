"""A bounded sample of labelled documents, the same one at every run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 31


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, learnable: Column, rows: int, parts: int, inputs: tuple = ("text",)
) -> DataFrame:
    """About ``rows`` labelled documents (all, if there are fewer): ``part, place`` and ``label`` and the
    input columns, dealt into ``parts`` partitions and sorted by ``place`` within each.

    Rows are chosen by a hash of the id. Of several labels of an id the largest counts; null labels
    and null ids are ignored. The labels of the sample are broadcast: ``rows`` bounds them.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learnable)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(_RANGE))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.withColumn("place", place).where(F.col("place") < int(share * _RANGE))
    return (
        documents.select("doc_id", *inputs)
        .join(F.broadcast(chosen), "doc_id")
        .select((F.col("place") % parts).cast("int").alias("part"), "place", "label", *inputs)
        .repartition(parts, "part")
        .sortWithinPartitions("part", "place", F.xxhash64(*inputs))
    )

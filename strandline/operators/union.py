"""Union of a categorised and an uncategorised source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.text import stratum_key
from strandline.operators.vocab import NULL_CATEGORY, category_index, reserved_index


def mixed_union(
    categorised: DataFrame, plain: DataFrame, vocab: DataFrame,
    category: str = "Fatty_acid_chain", label: str = "Label",
) -> DataFrame:
    """All rows of both sources, with ``is_lipo``, an int label and ``chain_index``.

    Rows of ``plain`` have no category column (it becomes null) and get the index of
    the reserved null category.
    """
    first = category_index(categorised, category, vocab).withColumn("is_lipo", F.lit(1.0))
    second = plain.drop(category).withColumns(
        {"chain_index": reserved_index(vocab, NULL_CATEGORY), "is_lipo": F.lit(0.0)})
    return first.unionByName(second, allowMissingColumns=True).withColumn(
        label, F.col(label).cast("int"))


def sample_group(category: Column, label: Column, is_lipo: Column) -> Column:
    """Balancing group of a mixed row: ``category_label``, or ``Linear_label`` without one."""
    plain = F.concat(F.lit("Linear_"), label.cast("string"))
    return F.when(is_lipo == 1.0, stratum_key(category, label)).otherwise(plain)

"""Baskets and frequent itemsets (Spark ML FP-growth)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baskets(df: DataFrame, basket_col: str, item_col: str) -> DataFrame:
    """One row per basket with its set of items.  ``collect_set`` dedups on
    the map side, so even a basket holding a third of all lines carries a
    buffer bounded by the number of distinct items, never by its lines."""
    return df.groupBy(basket_col).agg(F.collect_set(item_col).alias("items"))


def frequent_itemsets(b: DataFrame, min_support: float, min_confidence: float = 0.5,
                      items_col: str = "items"):
    """FP-growth: conditional pattern trees, no enumeration of item pairs per
    basket.  Returns the fitted model (``freqItemsets``, ``associationRules``)."""
    return FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=min_confidence).fit(b)


def itemset_key(items_col: str = "items") -> F.Column:
    return F.array_join(F.array_sort(F.col(items_col)), ",")

"""Developer tool: write the formatted physical plans of selected queries
to docs/PLANS.md (long literal arrays are shortened)."""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

from kiln.plans import QUERIES
from kiln.session import get_session

SELECTED = ["minibatch_assign", "split_exact", "metric_accuracy", "sentiment_score", "fpgrowth_itemsets",
            "feature_stats", "scale_minmax"]


def _shorten(text: str) -> str:
    text = re.sub(r"\[(-?\d+\.\d+,){8,}-?\d+\.\d+\]", "[...literal weights...]", text)
    return "\n".join(line if len(line) < 600 else line[:600] + " ..." for line in text.splitlines())


def _graph_round_at_scale(spark, sf_dir):
    """One PageRank round as planned when nothing is small enough to
    broadcast (static threshold off, vertex values above the counted
    limit): the kept edges keep their (src, salt) layout, only the vertex
    values are shuffled."""
    from pyspark.sql import functions as F

    from kiln.operators import graph
    from kiln.plans.extras import supply_edges
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = graph.undirected(supply_edges(spark, sf_dir))
        deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
        salted, hubs = graph.hub_layout(e, deg, deg.agg(F.sum("deg")).first()[0], 8)
        shares = deg.select("src", (F.lit(1.0) / F.col("deg")).alias("share"))
        contrib = (graph.join_values(salted, graph.spread_to_salts(shares, hubs), 1 << 62)
                   .groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("s")))
        buf = io.StringIO()
        with redirect_stdout(buf):
            contrib.explain("formatted")
        salted.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return ["## graph round at scale (no broadcast)", "",
            "One PageRank round with broadcasting off: the kept edges (hash-partitioned by `(src, salt)`) are",
            "joined without an exchange of their own; only the vertex values are shuffled.", "",
            "```", _shorten(buf.getvalue()).strip(), "```", ""]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("kiln-plans", master="local[8]", shuffle_partitions=8)
    out = ["# Physical plans", "",
           f"`explain('formatted')` of selected registered queries on `{sf_dir}` (local[8], AQE on;",
           "plans show the initial physical plan).  Regenerate with `python tools_plans.py`.", ""]
    for name in SELECTED:
        buf = io.StringIO()
        with redirect_stdout(buf):
            QUERIES[name](spark, sf_dir).explain("formatted")
        out += [f"## {name}", "", "```", _shorten(buf.getvalue()).strip(), "```", ""]
    out += _graph_round_at_scale(spark, sf_dir)
    os.makedirs("docs", exist_ok=True)
    with open("docs/PLANS.md", "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()

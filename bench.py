"""Headline queries at one scale; prints one JSON line.

Every query starts from the given parquet files: tables that queries share are
dropped before each run.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from blastradius.plans.registry import forget  # noqa: E402
from blastradius.queries import QUERIES  # noqa: E402
from blastradius.session import local_session  # noqa: E402

HEADLINE = (
    "impact_bands band_floor join_reach trace_down consumed_nodes linked_only upstream_depth page_summary "
    "column_ancestry path_lineage_type resolve_relation cross_links mapping_rows measure_chain measure_impact "
    "column_impact source_consumers visual_lineage physical_columns field_resolve alias_index modifies_measure "
    "field_usage dax_column_refs connectors m_navigation visual_fields manifest_nodes mapping_scan folder_rollup "
    "search_rank"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in only:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 2)
        forget(spark)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 2),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from verification import catalog, compare

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = [
    "a1_cell_sums", "a3_fill_log", "a7_dispersion", "a11_residuals", "w6_ratio_scales", "w10_rank",
    "c5_peaks_three_scales", "c6_projected_points", "e6_parameters", "e8_initial_model", "m6_predictions",
    "m17_objective", "m19_score_draws", "r1_bootstrap_counts", "t10_summary", "p2_normal_qq",
    "p12_density",
]


def main() -> None:
    spark = compare.session(CPUS)
    catalog.QUERIES["a1_cell_sums"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in HEADLINE:
        t = time.perf_counter()
        catalog.QUERIES[key](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from calledzone.session import build_session
from harness import queries as Q

HEADLINE = (
    Q.called_pitches, Q.umpire_eval_list_monthly, Q.recent_n_per_window, Q.bucket_model,
    Q.bucket_area, Q.bucket_score, Q.nn_score, Q.umpire_uzr, Q.batter_zone, Q.area_report,
    Q.roc_scores, Q.roc_auc, Q.heatmap_zone, Q.fit_umpire_generic, Q.fit_umpire_individual,
    Q.fit_movement, Q.fit_batter,
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    Q.umpire_eval_list(spark, root).write.format("noop").mode("overwrite").save()
    seconds = {}
    for query in HEADLINE:
        start = time.perf_counter()
        query(spark, root).write.format("noop").mode("overwrite").save()
        seconds[query.__name__] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(root).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultline.plans.queries import QUERIES

#: Headline queries, and the table that each reads.
HEADLINE = {
    "t7_triage_documents": "documents", "t7_triage_events": "events", "l3_l4_smart_filter": "events", "l6_truncated": "events", "b1_regex_baseline": "events", "b2_heuristic_baseline": "events", "g4_scores": "events",
    "e2_metrics": "orders", "e3_metrics_by_type": "orders", "e13_models": "orders", "e15_aligned": "orders", "e19_baseline_report": "events", "r4_chunks": "documents", "r5_nearest": "embeddings", "h2_time": "orders",
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    size = {}  # rows, and MB of text (documents) or of the rows as JSON (other tables)
    for name in sorted({*HEADLINE.values()}):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        text = F.octet_length("text") if name == "documents" else F.octet_length(F.to_json(F.struct(*df.columns)))
        size[name] = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0)) / 1e6).first()
    QUERIES["s2_first_of_each"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # untimed: the session starts
    took, speed = {}, {}
    for name, table in HEADLINE.items():
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        speed[name] = {"rows_per_s": round(size[table][0] / took[name]), "mb_per_s": round(size[table][1] / took[name], 1)}
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "speed": speed, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()

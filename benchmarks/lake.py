"""Timers of the counting engine: discovery and first count, warm counts, a matrix as a loop and as a shared scan, many patterns.

python benchmarks/lake.py [folder of the test tables]; prints a line of JSON for each measurement.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from random import Random

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarn import catalogue
from tarn.functions.predicates import like_quantified
from tarn.operators.engine import Engine
from tarn.sources.lake import Catalog, discover, to_parquet


def main(sf_dir: str) -> None:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str, f, runs: int = 3) -> None:
        seconds = []
        for _ in range(runs):
            began = time.time()
            f()
            seconds.append(time.time() - began)
        print(json.dumps({"what": name, "first": round(seconds[0], 3), "best": round(min(seconds), 3)}), flush=True)

    root = catalogue.orders_lake(spark, sf_dir)
    line = "orders prio > '3-MEDIUM' column2 ANY_LIKE ['1995%','%-31','%-02-%']"
    timed("text lake: discovery, width and first count", lambda: Engine(discover(spark, root)).count(line).collect())
    warm = Engine(discover(spark, root, {"orders": 3}))
    warm.catalog.table("orders")
    timed("text lake: one count", lambda: warm.count(line).collect())
    stored = to_parquet(warm.catalog.table("orders"), tempfile.mkdtemp() + "/t", ("prio", "status"))
    catalog = Catalog(spark)
    catalog.add("orders", stored, ("prio", "status"))
    timed("Parquet lake: one count", lambda: Engine(catalog).count(line).collect())
    catalog.add("orders", stored.cache(), ("prio", "status"))
    timed("cached: one count", lambda: Engine(catalog).count(line).collect(), 4)
    part = catalogue._tables(spark, sf_dir)
    lines = catalogue.batch_lines()
    timed("12 queries on part, a loop", lambda: [part.count(x).collect() for x in lines])
    timed("12 queries on part, a shared scan", lambda: part.batch(lines).collect())
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").cache()
    text.count()
    r = Random(1)
    for n in (3, 40, 400):
        patterns = [f"{''.join(r.choice('abcdefgh') for _ in range(r.randrange(3, 7)))}%" for _ in range(n)]
        timed(f"OR of {n} prefixes on documents.text", lambda p=patterns: text.where(like_quantified(F.col("text"), "ANY_LIKE", p)).count(), 4)
        infixes = ["%" + p for p in patterns]
        timed(f"OR of {n} infixes on documents.text", lambda p=infixes: text.where(like_quantified(F.col("text"), "ANY_LIKE", p)).count(), 3)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")

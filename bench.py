"""Runtimes of the headline queries as one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query is run to the
end (noop sink) after one warm-up query; the value is the sum of all.
"""

from __future__ import annotations

import importlib
import json
import os
import re
import sys
import time

HEADLINE = [
    "term_freq",
    "vocab_ids",
    "ngrams_3",
    "skip_cooc_4",
    "selected_tokens",
    "sub_phrase_freq",
    "long_phrases_k0",
    "long_phrases_k2",
    "phrase_context_counts",
    "transition_probs",
    "bigram_llr",
    "key_tokens",
    "pattern_index",
    "normalise_dutch",
]


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = importlib.import_module("__spark_entry__").queries()
    names = [n for n in (os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else [*HEADLINE, *(n for n in known if n.startswith("op2_"))]) if n in known]
    known["doc_lengths"](spark, folder).write.format("noop").mode("overwrite").save()
    took: dict[str, float | None] = {}
    for name in names:
        began = time.perf_counter()
        try:
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
            spark.catalog.clearCache()
        except Exception as e:  # the line below must come out whatever happens, even without a JVM
            took.setdefault(name, None)
            print(f"{name}: {str(e)[:200]}", file=sys.stderr)
        print(f"{name}: {took[name]} s", file=sys.stderr, flush=True)
    try:
        spark.stop()
    except Exception as e:
        print(f"stop: {str(e)[:200]}", file=sys.stderr)
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(t for t in took.values() if t), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()

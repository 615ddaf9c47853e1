"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    from leafmill.plans.index import Index
    from leafmill.plans.rank import ranked
    from leafmill.plans.results import facets, sorted_hits
    from leafmill.queries import QUERIES, corpus, corpus_config
    from leafmill.sources import tables

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    def seconds(f) -> float:
        start = time.time()
        f()
        return time.time() - start

    base = f"/tmp/leafmill-bench-{os.getpid()}"
    spark.range(1).count()
    docs = tables.text_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    times = {"index": seconds(lambda: Index(spark, f"{base}/index", corpus_config()).add(docs))}
    # searches have stored values and fields of other tables too
    t = corpus(spark, sf_dir)
    t.postings.repartitionByRange(int(cpus), "term", "uri").sortWithinPartitions("term", "uri", "pos").write.parquet(f"{base}/postings")
    t.docs.write.parquet(f"{base}/docs")
    t.props.write.parquet(f"{base}/props")
    t.postings, t.docs, t.props = (spark.read.parquet(f"{base}/{n}") for n in ("postings", "docs", "props"))
    t.docs.count()
    cases = {
        "term": lambda: t.search("thing").count(),
        "and": lambda: t.search("the and thing").count(),
        "phrase": lambda: t.search('"in the"').count(),
        "wildcard": lambda: t.search("tion*").count(),
        "range": lambda: t.search("quality:1..1").count(),
        "facet": lambda: facets(t, t.search("the"), ["lang", "source"]).collect(),
        "bm25_top10": lambda: sorted_hits(t, ranked(t, "the thing"), max=10).collect(),
        "doc_word_counts": lambda: QUERIES["doc_word_counts"](spark, sf_dir).agg({"nwords": "sum"}).collect(),
        "top_terms": lambda: QUERIES["top_terms"](spark, sf_dir).collect(),
        "html_postings": lambda: QUERIES["html_postings"](spark, sf_dir).count(),
    }
    for name, f in cases.items():
        f()
        times[name] = median(seconds(f) for _ in range(RUNS))
    import shutil

    shutil.rmtree(base, ignore_errors=True)
    spark.stop()
    times = {k: round(v, 3) for k, v in times.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

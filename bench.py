"""Headline benchmark: prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 5)

  build_index         B3: documents -> postings, state, dictionary, gram index as Parquet (docs/s)
  search_scan         C1: one-term search on the written postings (plain filtered scan)
  search_dictionary   B2: the same search through the written term dictionary
  batch_queries       B1: one query per benchmark item, each token a clause (match all)
  date_range          C10-C12: ON / BEFORE / AFTER on the orders state
  changelog_fold      W3/W4: replay of the events change log (also events/s)
Each value is the median of BENCH_RUNS warm runs; every run executes the whole plan
(`noop` sink), nothing is collected.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from mailsift.operators import batch as B  # noqa: E402
from mailsift.operators import criteria as C  # noqa: E402
from mailsift.operators import maintain as M  # noqa: E402
from mailsift.operators.ingest import build_state, load_index, rebuild_index  # noqa: E402
from mailsift.operators.search import search  # noqa: E402
from mailsift.plans.queries_index import benchmark_criteria  # noqa: E402
from mailsift.session import get_session, new_scratch_path  # noqa: E402
from mailsift.sources.adapters import mail_changes, mail_docs, mail_orders, read_table  # noqa: E402


def run_noop(df):
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs):
    times = []
    for _ in range(runs):
        SparkSession.getActiveSession().catalog.clearCache()  # no run reads what another has cached
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return statistics.median(times)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = get_session(cores=cpus, shuffle_partitions=max(8, cpus), app="mailsift-bench")
    q = {}

    n_docs = read_table(spark, sf_dir, "documents").count()
    n_events = read_table(spark, sf_dir, "events").count()

    # Build and write the whole index (a new folder per run)
    # the test table is one file with one row group: the caller spreads it over the cores
    build = lambda: rebuild_index(mail_docs(spark, sf_dir).repartition(cpus), new_scratch_path(spark, "bench-index"))
    build()  # warm-up (JIT of the tokenizer and writers)
    build()
    roots, times = [], []
    for _ in range(runs):
        t0 = time.perf_counter()
        roots.append(build())
        times.append(time.perf_counter() - t0)
    q["build_index"] = statistics.median(times)
    ix = load_index(spark, roots[-1])
    postings, state = ix.postings, ix.state

    # C1 plain scan vs B2 dictionary (same answer: BODY terms containing THE in mailbox src1)
    scan = lambda: run_noop(search(postings, state, "src1", [C.body_contains("the")]))
    scan()
    q["search_scan"] = timed(scan, runs)

    dict_search = lambda: run_noop(search(postings, state, "src1", [C.body_contains("the")],
                                          dictionary=ix.dictionary, grams=ix.grams, gram_stats=ix.gram_stats))
    dict_search()
    q["search_dictionary"] = timed(dict_search, runs)

    # B1 batch
    crit = benchmark_criteria(spark, sf_dir, per_token=True)
    batch = lambda: run_noop(B.search_batch(postings, state, crit, match="all", dictionary=ix.dictionary,
                                            grams=ix.grams, gram_stats=ix.gram_stats))
    batch()
    q["batch_queries"] = timed(batch, runs)

    # C10-C12 on orders
    ost = build_state(mail_orders(spark, sf_dir))
    op = spark.createDataFrame([], "mailbox_id string, field string, term string, uid bigint")
    dates = lambda: run_noop(search(op, ost, None, [
        C.date_on(dt.datetime(1997, 5, 17), "month"), C.date_before(dt.datetime(1995, 3, 15), "day"),
        C.date_after(dt.datetime(2001, 6, 30), "day")]))
    dates()
    q["date_range"] = timed(dates, runs)

    # W3/W4 change-log fold
    fold = lambda: run_noop(M.live_flags(M.fold_changes(mail_changes(spark, sf_dir))))
    fold()
    q["changelog_fold"] = timed(fold, runs)

    q = {k: round(v, 3) for k, v in q.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "total_sec", "value": round(sum(q.values()), 3), "unit": "sec", "queries": q,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "docs_per_sec": round(n_docs / q["build_index"], 1),
        "events_per_sec": round(n_events / q["changelog_fold"], 1),
        "cpus": cpus, "runs": runs,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Every query is run in full through a sink that discards rows,
twice; the faster run counts, so that code generation is not what is measured.
With BENCH_SQL=1 the plain SQL of each query is timed in DuckDB as well.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scope_theme",
    "messages_over_time_day_messages",
    "messages_over_time_day_words",
    "activity_heatmap_conversations",
    "longest_gap",
    "longest_session",
    "conversation_table",
    "most_active_conversations",
    "top_people_words",
    "top_themes_messages",
    "message_tokens",
    "message_search_trigrams",
    "top_words",
    "word_over_time",
    "linked_domains",
    "search_ascii",
    "search_through_index",
    "reaction_events",
    "emoji_usage",
    "person_vocabulary",
    "person_exclusive_counts",
    "person_mtld",
    "names_at_time",
    "rename_history",
    "message_window",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from parlance.plans.registry import ORACLE, QUERIES
    from parlance.session import get_spark

    spark = get_spark("bench", cores=cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scope_default"](spark, folder).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    out = {
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_SQL") == "1":
        import duckdb

        con = duckdb.connect()
        con.execute(f"SET threads = {int(cores)}")
        for file in os.listdir(folder):
            con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{file}')")
        out["sql"] = {}
        for name in HEADLINE:
            start = time.perf_counter()
            con.execute(ORACLE[name]).to_arrow_table()
            out["sql"][name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()

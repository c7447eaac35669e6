"""Times headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel import catalog
from quernel.plans import engine
from quernel.session import get_session

#: Of each kind one at least; each runs to its last row, after a run that warms up.
#: The index of the documents is written first, as `index_write`; text requests look up its postings.
HEADLINE = "match_single match_scan batch_thousand segment_forward phonetic_mixed geo_places_in_shapes match_or_tokens bool_text_and_range bool_must batch_queries postings_build term_stats phrase_adjacent term_keyword range_gele sort_field_desc page_offset terminal_range geo_distance_default geo_point_in_polygon dedupe_latest_version upsert_delete_replay suggest_prefix correct_edit1 events_sliding events_session kv_range_order_limit kv_update_add shard_merge".split()


#: Requests that one job answers for the rate of batched queries, each of about two words that 2 to 40 documents have.
MANY = 100_000


def many_queries(store) -> DataFrame:
    """query_id and term: frequent enough words, repeated, dealt over MANY queries by hash."""
    words = store.stats.where("field = 'text' and df between 2 and 40").select("term")
    copies = F.explode(F.sequence(F.lit(1), F.lit(-(-2 * MANY // max(1, words.count())))))
    return words.select("term", copies.alias("copy")).select(F.pmod(F.xxhash64("term", "copy"), F.lit(MANY)).alias("query_id"), "term")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("match_scan")
    began = time.perf_counter()
    store = catalog.store_of(spark, sf_dir)
    took = {"index_write": round(time.perf_counter() - began, 3)}
    run("match_single")
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    engine.batch_lookup(store, many_queries(store), "text").write.format("noop").mode("overwrite").save()
    many = time.perf_counter() - began
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "documents_indexed_per_second": round(store.n_docs / took["index_write"], 1), "batched_queries_per_second": round(MANY / many, 1), "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()

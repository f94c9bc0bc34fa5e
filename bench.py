"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = ["f1_fold_all_predicates", "f11_beliefs_as_of_bitemporal", "t2_u5_belief_diff", "j9_source_policy_asof", "r1_j13_word_bm25", "r6_o2_dense_knn", "r15_u3_rrf_fuse", "g1_g3_bfs_depth3", "g5_g7_communities", "e3_e4_e6_j15_minhash_candidates", "b1_b5_entity_brief", "v1_v3_validate_claims", "s2_s5_html_to_text"]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from epistema.catalogue import every
    from epistema.session import session

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", max(8, int(cpus)), **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = every()
    queries["f1_fold_all_predicates"](spark, sf).write.format("noop").mode("overwrite").save()  # classes are loaded
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

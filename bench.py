"""Wall time of the headline jobs.

The documents are derived from the tables once and written to the scratch folder before the clock
starts, so that each figure is the time of the job itself: read, compute everything, write to nowhere.
Environment: BENCH_SF_DIR (folder of the tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from gridweft import get_session, materialize
from gridweft.operators import detection as DT
from gridweft.operators import text_scores as X
from gridweft.operators.annotations import nest_annotations
from gridweft.operators.linearize import linearize
from gridweft.operators.table_similarity import score_against_truth
from gridweft.plans import derived as D
from gridweft.plans.catalog_annotations import annotations
from gridweft.plans.catalog_evaluation import cell_layout, label_pairs
from gridweft.operators.layout_merge import assign_lines
from gridweft.operators.recognition import recognition_scores


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "gridweft-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(4 * int(cpus)),
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="gridweft-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    docs = D.html_tables(spark, sf)
    true = materialize(docs.select("file", F.col("true_html").alias("html")), "bench-true")
    pred = materialize(D.html_pred(spark, sf), "bench-pred")
    # small tables come as one file; spread them, as files of a large table would be
    files = 4 * int(cpus)
    pairs = materialize(D.sentences(spark, sf).repartition(files), "bench-pairs")
    turns = materialize(D.turn_pairs(spark, sf).repartition(files), "bench-turns")
    det = materialize(D.detected_boxes(spark, sf), "bench-det")
    gt = materialize(D.true_boxes(spark, sf), "bench-gt")
    texts, cells = (materialize(f, "bench-layout") for f in cell_layout(spark, sf))

    jobs = {
        "linearize_tables": lambda: linearize(true).select("file", "input"),
        "score_tables": lambda: score_against_truth(true, pred),
        "bleu": lambda: X.bleu(pairs),
        "rouge_stemmed": lambda: X.rouge(pairs),
        "rouge_turns": lambda: X.rouge(turns),
        "detection_scores": lambda: DT.detection_scores(det, gt),
        "top_boxes_per_image": lambda: DT.top_per_image(det, 100),
        "lines_to_cells": lambda: assign_lines(texts, cells),
        "nested_annotations": lambda: nest_annotations(D.images(spark, sf), annotations(spark, sf)),
        "recognition_scores": lambda: recognition_scores(label_pairs(spark, sf)),
    }
    times = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sizes = {"documents": true.count(), "predictions": pred.count(), "boxes": det.count()}
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "rows": sizes,
        "documents_scored_per_sec": round(sizes["documents"] / times["score_tables"], 1),
        "documents_linearized_per_sec": round(sizes["documents"] / times["linearize_tables"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

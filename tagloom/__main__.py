"""Command line: fit a model, label column files, segment text, or report on a model.

    python -m tagloom fit -p TEMPLATES [options] INPUT MODEL
    python -m tagloom test -m MODEL INPUT OUTPUT
    python -m tagloom segment -m MODEL [INPUT OUTPUT]     (lines from the terminal without paths)
    python -m tagloom prepare INPUT OUTPUT                (JSON lines to column files)
    python -m tagloom evaluate GOLD FOUND
    python -m tagloom stats -m MODEL
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tagloom.operators import metrics
from tagloom.operators.local import LocalModel
from tagloom.operators.templates import parse_file
from tagloom.operators.training import Params
from tagloom.plans.crf import CrfEstimator, CrfModel
from tagloom.sources import sequences as S
from tagloom.streaming.label import ENDS


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("tagloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("mode", choices=("fit", "test", "segment", "prepare", "evaluate", "stats"))
    p.add_argument("paths", nargs="*")
    p.add_argument("-m", "--model")
    p.add_argument("-p", "--pattern")
    d = Params()
    p.add_argument("-a", "--algorithm", default=d.algorithm)
    p.add_argument("-i", "--max-iter", type=int, default=d.max_iter)
    p.add_argument("-1", "--l1", type=float, default=d.l1)
    p.add_argument("-2", "--l2", type=float, default=d.l2)
    p.add_argument("-o", "--objective-window", type=int, default=d.objective_window)
    p.add_argument("-w", "--stop-window", type=int, default=d.stop_window)
    p.add_argument("-e", "--stop-eps", type=float, default=d.stop_eps)
    p.add_argument("--eta0", type=float, default=d.eta0)
    p.add_argument("--alpha", type=float, default=d.alpha)
    p.add_argument("--histsz", dest="history", type=int, default=d.history)
    p.add_argument("--maxls", dest="max_line_search", type=int, default=d.max_line_search)
    p.add_argument("--seed", type=int, default=d.seed)
    a = p.parse_intermixed_args(argv)
    need = {"fit": 2, "test": 2, "prepare": 2, "evaluate": 2, "stats": 0}.get(a.mode)
    if need is not None and len(a.paths) != need or a.mode == "segment" and len(a.paths) not in (0, 2):
        p.error(f"{a.mode} takes {need if need is not None else '0 or 2'} paths")
    if a.mode in ("test", "segment", "stats") and not a.model:
        p.error("a model is needed (-m)")
    return a


def main(argv: list[str]) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("tagloom").getOrCreate()
    if a.mode == "fit":
        names = Params.__dataclass_fields__
        params = Params(**{k: v for k, v in vars(a).items() if k in names})
        templates = None
        if a.pattern:
            text = "\n".join(r.value for r in spark.read.text(a.pattern).collect())
            templates = [t.source for t in parse_file(text)]
        model = CrfEstimator(templates, params).fit(S.read_sequences(spark, a.paths[0], True))
        model.log.orderBy("iter").show(params.max_iter, False)
        model.save(a.paths[1])
    elif a.mode == "test":
        S.write_labelled(CrfModel.load(spark, a.model).transform(S.read_sequences(spark, a.paths[0], False)), a.paths[1])
    elif a.mode == "segment" and a.paths:
        CrfModel.load(spark, a.model).segment(spark.read.text(a.paths[0]), "value").select("segmented").write.text(a.paths[1])
    elif a.mode == "segment":
        model = LocalModel.of(CrfModel.load(spark, a.model))
        for line in map(str.strip, sys.stdin):
            if line in ENDS:
                break
            if line:
                print(model.segment([line])[0], flush=True)
    elif a.mode == "prepare":
        lines = spark.read.text(a.paths[0]).withColumn("id", F.monotonically_increasing_id())
        S.write_sequences(S.from_segmented(S.from_json_lines(lines), "id", "cut"), a.paths[1])
    elif a.mode == "evaluate":
        gold = S.read_sequences(spark, a.paths[0], True).select("sent_id", "labels")
        found = S.read_sequences_of_results(spark, a.paths[1])
        pairs = gold.join(found, "sent_id")
        metrics.error_rates(pairs).show(truncate=False)
        metrics.word_scores(pairs).show(truncate=False)
        metrics.samples(pairs).show(truncate=False)
    else:
        model = CrfModel.load(spark, a.model)
        metrics.model_statistics(model.layout, model.labels.count()).orderBy("template").show(1000, False)
        metrics.active(model.weights).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    sys.exit(main(sys.argv[1:]))

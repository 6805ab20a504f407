"""Command line for the batch entry points (E1-E5), for spark-submit.

    spark-submit run_dendrospark.py linkage  POINTS OUT --k 3 --strategy avg
    spark-submit run_dendrospark.py evaluate POINTS MERGES OUT --k-min 2 --k-max 10
    spark-submit run_dendrospark.py build-evaluate POINTS OUT --strategy avg --k-min 2 --k-max 10
    spark-submit run_dendrospark.py grid OUT --data NAME=PATH ... --nv 1 20 --k 3 9
    spark-submit run_dendrospark.py bisecting-grid OUT --data NAME=PATH ... --nv 1 20 --k 3 9

POINTS are header-less delimited numeric text (every column a feature);
MERGES is a ``cluster,point1,point2`` table.  Iterative steps need
``spark.checkpoint.dir``; pass ``--checkpoint-dir`` when the cluster does
not name one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.pipelines import (bisecting_grid, build_and_evaluate, build_model, evaluate_grid,
                              evaluate_model)
from .session import checkpoint_dir
from .sources.io import read_merges, read_points, write_merges, write_report


def _session(args) -> SparkSession:
    spark = SparkSession.builder.appName(f"dendrospark-{args.cmd}").getOrCreate()
    if args.checkpoint_dir:
        spark.sparkContext.setCheckpointDir(args.checkpoint_dir)
    elif checkpoint_dir(spark) is None:
        raise SystemExit("set spark.checkpoint.dir (a shared folder) or pass --checkpoint-dir")
    return spark


def _datasets(spark, items, sep):
    out = {}
    for item in items:
        name, path = item.split("=", 1)
        out[name] = read_points(spark, path, sep).cache()
    return out


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="dendrospark")
    ap.add_argument("--checkpoint-dir")
    ap.add_argument("--sep", default=",")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("linkage", help="E1: points -> merge table")
    p.add_argument("points")
    p.add_argument("out")
    p.add_argument("--k", type=int, default=1)
    p.add_argument("--strategy", default="avg", choices=["min", "max", "avg", "wavg"])
    p = sub.add_parser("evaluate", help="E2: stored merge table -> index report")
    p.add_argument("points")
    p.add_argument("merges")
    p.add_argument("out")
    p.add_argument("--k-min", type=int, required=True)
    p.add_argument("--k-max", type=int, required=True)
    p = sub.add_parser("build-evaluate", help="E3: points -> dendrogram -> index report")
    p.add_argument("points")
    p.add_argument("out")
    p.add_argument("--strategy", default="avg", choices=["min", "max", "avg", "wavg"])
    p.add_argument("--k-min", type=int, required=True)
    p.add_argument("--k-max", type=int, required=True)
    for name in ("grid", "bisecting-grid"):
        p = sub.add_parser(name, help="E4 / E5: datasets x feature prefixes x K")
        p.add_argument("out")
        p.add_argument("--data", nargs="+", required=True, help="NAME=PATH")
        p.add_argument("--nv", type=int, nargs=2, required=True, metavar=("FIRST", "LAST"))
        p.add_argument("--k", type=int, nargs=2, required=True, metavar=("FIRST", "LAST"))
        if name == "grid":
            p.add_argument("--strategy", default="avg", choices=["min", "max", "avg", "wavg"])
    args = ap.parse_args(argv)
    spark = _session(args)

    if args.cmd == "linkage":
        pts = read_points(spark, args.points, args.sep)
        write_merges(build_model(pts, k=args.k, strategy=args.strategy), args.out)
    elif args.cmd == "evaluate":
        pts = read_points(spark, args.points, args.sep).cache()
        merges = read_merges(spark, args.merges)
        rep = evaluate_model(pts, merges, pts.count(), list(range(args.k_min, args.k_max + 1)))
        write_report(rep, args.out)
    elif args.cmd == "build-evaluate":
        pts = read_points(spark, args.points, args.sep).cache()
        write_report(build_and_evaluate(pts, args.strategy, args.k_min, args.k_max), args.out)
    else:
        data = _datasets(spark, args.data, args.sep)
        nvs = list(range(args.nv[0], args.nv[1] + 1))
        ks = list(range(args.k[0], args.k[1] + 1))
        if args.cmd == "grid":
            rep = evaluate_grid(data, nvs, ks, args.strategy)
        else:
            rep = bisecting_grid(data, nvs, ks)
        rep.orderBy("dataset", "nv", "k").coalesce(1).write.mode("overwrite") \
            .option("header", "true").csv(args.out)


if __name__ == "__main__":
    main()

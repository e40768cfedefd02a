"""python -m snapweave ls|verify|materialize|replicate: the store from a command line."""

from __future__ import annotations

import argparse
import json
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="snapweave")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, names in (("ls", ["store"]), ("verify", ["store"]), ("materialize", ["store", "dataset", "generation", "out"]), ("replicate", ["root", "store", "dataset", "generation"])):
        v = verbs.add_parser(verb)
        for n in names:
            v.add_argument(n, type=int if n == "generation" else str)
        if verb == "verify":
            v.add_argument("--deep", action="store_true")
    a = p.parse_args(args)
    from pyspark.sql import SparkSession

    from .plans.job import replicate
    from .plans.store import Store

    spark = SparkSession.builder.getOrCreate()
    store = Store.open(spark, a.store)
    if a.verb == "ls":
        for r in store.catalog().orderBy("dataset", "generation").collect():
            print(*r, sep="\t")
        print("store", *store.totals().first(), sep="\t")
    elif a.verb == "verify":
        report = store.verify(a.deep)
        print(json.dumps(report))
        return int(report["problems"] > 0)
    elif a.verb == "materialize":
        print(store.materialize(a.dataset, a.generation, a.out))
    else:
        print(json.dumps(replicate(spark, a.root, store, a.dataset, a.generation)))
    return 0


if __name__ == "__main__":
    sys.exit(main())

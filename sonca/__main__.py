"""python -m sonca telexify IN OUT [dense|spare|parts|utf8] [--grams] | telegram IN OUT | stats [FREQUENCIES]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.syllables import MODES
from .plans import jobs
from .sources import text as io


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="sonca", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("telexify")
    p.add_argument("path")
    p.add_argument("out")
    p.add_argument("mode", nargs="?", default="dense", type=lambda x: next((m for m in MODES if m[0] == x[:1]), x), choices=MODES)
    p.add_argument("--grams", action="store_true", help="count n-grams as well")
    p.add_argument("--unrouted", action="store_true", help="all lines to main")
    p.add_argument("--delimited", action="store_true", help="mark syllables with delimiter bytes")
    p = commands.add_parser("telegram")
    p.add_argument("path")
    p.add_argument("out")
    p = commands.add_parser("stats")
    p.add_argument("frequencies", nargs="?")
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("sonca").getOrCreate()
    if a.command == "telexify":
        print(jobs.telexify(io.lines(spark, a.path), a.out, a.mode, a.grams, not a.unrouted, not a.delimited))
    elif a.command == "telegram":
        print(jobs.telegram(spark, a.path, a.out))
    else:
        listed = io.frequencies(spark, a.frequencies).withColumn("category", F.lit("alphmark")) if a.frequencies else None
        print(jobs.stats(spark, listed))


if __name__ == "__main__":
    main()

"""Command line: list the queries, run one into files, or explain its plan.

    python -m pmx list
    python -m pmx run win_rate_by_price --data DIR --out FOLDER --format csv
    python -m pmx explain t1b_bars_1h --data DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pmx import registry


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pmx", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("action", choices=["list", "run", "explain"])
    p.add_argument("query", nargs="?")
    p.add_argument("--data", default="/root/testdata/sf0.01")
    p.add_argument("--out", help="folder to write to; without it the first rows are shown")
    p.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    a = p.parse_args(args)
    queries = registry.queries()
    if a.action == "list":
        print("\n".join(sorted(queries)))
        return
    if a.query not in queries:
        p.error(f"no query {a.query}")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = queries[a.query](spark, a.data)
    if a.action == "explain":
        df.explain("formatted")
    elif a.out:
        w = df.write.mode("overwrite").format(a.format)
        (w.option("header", True) if a.format == "csv" else w).save(a.out)
    else:
        df.show(20, truncate=False)


if __name__ == "__main__":
    main()

"""Command line: ``python -m lexigrid FOLDER (list | run NAME | sql TEXT | graph NAME HOPS)``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lexigrid.operators.graph import within_hops
from lexigrid.plans import catalog
from lexigrid.plans.bindings import bound
from lexigrid.plans.session import Session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in ("list", "run", "sql", "graph"):
        print(__doc__)
        return 2
    folder, command, *rest = args
    if command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("lexigrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if command == "run":
        df = catalog.QUERIES[rest[0]](spark, folder)
    elif command == "sql":
        df = Session(spark, folder).query(rest[0])
    else:
        df = within_hops(bound(spark, folder, "edges"), rest[0], int(rest[1])).orderBy("hop", "name")
    df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Run a registered query, or build and ask the index of a corpus.

    python -m docketry list
    python -m docketry query NAME FOLDER [OUT]
    python -m docketry build CASES.jsonl.gz OUT
    python -m docketry ask OUT "a question"
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from docketry.operators import chunks, index
from docketry.plans import catalogue
from docketry.session import build, ship
from docketry.sources import records


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(catalogue.queries())))
        return 0
    if args[:1] == ["query"] and len(args) in (3, 4):
        df = catalogue.queries()[args[1]](ship(build()), args[2])
        df.write.mode("overwrite").parquet(args[3]) if args[3:] else df.show(20, truncate=80)
        return 0
    if args[:1] == ["build"] and len(args) == 3:
        spark = ship(build())
        cases = records.read_cases(spark, args[1], partitions=spark.sparkContext.defaultParallelism)
        chunks.case_chunks(cases).write.mode("overwrite").parquet(f"{args[2]}/chunks")
        index.build(spark.read.parquet(f"{args[2]}/chunks"), args[2], "chunk_id", "content")
        return 0
    if args[:1] == ["ask"] and len(args) == 3:
        spark = ship(build())
        asked = spark.createDataFrame([(1, args[2])], "query_id int, query string")
        best = index.best(spark, args[1], asked, 10)
        found = best.join(spark.read.parquet(f"{args[1]}/chunks"), F.col("doc_id") == F.col("chunk_id"))
        found.select("rank", "score", "case_id", "section", "content_preview").orderBy("rank").show(10, truncate=80)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

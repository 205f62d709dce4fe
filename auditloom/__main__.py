"""python -m auditloom PAPERS LEDGERS OUT: the audit of a folder of manuscripts, as Parquet tables."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from auditloom.plans.engine import Audit
from auditloom.session import local_session
from auditloom.sources import files


def session(cpus: int) -> SparkSession:
    """The session at hand, or that of spark-submit; a local one where there is neither."""
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    return SparkSession.getActiveSession() or (SparkSession.builder.appName("auditloom").getOrCreate() if submitted else local_session(cpus))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="auditloom", description=__doc__)
    parser.add_argument("papers", help="folder of .md files")
    parser.add_argument("ledgers", help="folder with a folder of ledgers for each paper")
    parser.add_argument("out", help="folder for the tables")
    parser.add_argument("--cpus", type=int, default=8)
    options = parser.parse_args(argv)
    spark = session(options.cpus)
    audit = Audit(files.manuscripts(spark, options.papers).where("text IS NOT NULL").select("doc_id", "text"), files.ledgers(spark, options.ledgers))
    for name in ("findings", "verdicts", "summary", "digests"):
        files.write(getattr(audit, name), f"{options.out}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

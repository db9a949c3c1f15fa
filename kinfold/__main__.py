"""``python -m kinfold PARAMETERS [OUT]``: resolve the references that a parameter file names."""

import sys

from pyspark.sql import SparkSession

from kinfold.plans.resolve import run

if __name__ == "__main__":
    if len(sys.argv) not in (2, 3):
        sys.exit(__doc__)
    session = SparkSession.builder.appName("kinfold").getOrCreate()
    result = run(session, sys.argv[1], sys.argv[2] if len(sys.argv) == 3 else None)
    result.run_stats(session).show(truncate=False)

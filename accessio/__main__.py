"""python -m accessio STEP --input .. --output ..: runs a linkage step and prints its counts as a JSON line."""

from __future__ import annotations

import argparse
import inspect
import json
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from accessio.steps import STEPS


def parser() -> argparse.ArgumentParser:
    """An option for each parameter of a step: those without a default are required, those of a boolean one are flags."""
    top = argparse.ArgumentParser(prog="accessio", description=__doc__)
    steps = top.add_subparsers(dest="step", required=True)
    for name, step in STEPS.items():
        own = steps.add_parser(name, help=step.__doc__.splitlines()[0])
        for p in list(inspect.signature(step).parameters.values())[1:]:
            flag, needed = "--" + p.name.replace("_", "-"), p.default is p.empty
            if p.default is False:
                own.add_argument(flag, action="store_true")
            else:
                own.add_argument(flag, required=needed, default=None if needed else p.default, type=str if needed else type(p.default))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = vars(parser().parse_args(argv))
    step = STEPS[options.pop("step")]
    if "api_key" in options:
        options["api_key"] = options["api_key"] or os.environ.get("NCBI_API_KEY", "")
    try:
        counts = step(spark or SparkSession.builder.appName("accessio").getOrCreate(), **options)
    except ValueError as problem:  # a table without rows
        print(problem, file=sys.stderr)
        return 1
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"input not found: {problem.getMessageParameters()['path']}", file=sys.stderr)
        return 1
    print(json.dumps(counts))
    return 0


if __name__ == "__main__":
    sys.exit(main())

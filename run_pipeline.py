"""Command line: run_pipeline.py --config settings.yaml --operators operators.parquet --subjects subjects.parquet --output folder,
or run_pipeline.py COMMAND ..., with one of the commands that run_pipeline.py --help lists."""

from __future__ import annotations

import sys

from gramweave.plans.commands import execute
from gramweave.session import session


def main() -> None:
    arguments = sys.argv[1:]
    if arguments and arguments[0] == "--config":
        arguments = ["pipeline", *arguments]
    execute(session("gramweave-pipeline"), arguments)


if __name__ == "__main__":
    main()

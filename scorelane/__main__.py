"""python -m scorelane validate|evaluate: exit code 2 and one line on an error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from scorelane import evaluate as E
from scorelane.sources import sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scorelane")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "evaluate"):
        sub = commands.add_parser(name)
        sub.add_argument("--records", required=True)
        sub.add_argument("--manifest", required=True)
        if name == "evaluate":
            sub.add_argument("--predictions", required=True)
            sub.add_argument("--output", required=True)
            sub.add_argument("--temperature", type=float, default=1.0)
            sub.add_argument("--calibration-id")
            sub.add_argument("--min-confidence", type=float)
    args = parser.parse_args(argv)
    try:
        if args.command == "evaluate":
            sinks.apart(args.output, [args.records, args.manifest, args.predictions])
        spark = SparkSession.builder.getOrCreate()
        if args.command == "validate":
            got = E.validate(spark, args.records, args.manifest)
            print(f"{got['record_count']} records of {got['dataset_count']} datasets ({got['data_kind']}): " + ", ".join(f"{s} {n}" for s, n in got["split_counts"].items() if n))
            return 0
        report = E.evaluate(spark, args.records, args.predictions, args.manifest, args.temperature, args.calibration_id, args.min_confidence)
        E.write(report, args.output, [args.records, args.manifest, args.predictions])
        print(f"{report['overall']['record_count']} {report['data_kind']} records of {report['model_revision']}: accuracy {report['overall']['micro_accuracy']:.3f}, coverage {report['overall']['coverage']:.3f}, in {args.output}")
        return 0
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

"""python -m pairloom.cli run | generate | compare | domains | capabilities | version"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pairloom import __version__
from pairloom.model import CAPABILITIES, Benchmark, Judge, Model, Output, Settings


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pairloom")
    sub = out.add_subparsers(dest="command", required=True)
    p = sub.add_parser("run", help="compare two models")
    p.add_argument("--dataset", required=True)
    p.add_argument("--config")
    p.add_argument("--models", help="provider/model,provider/model")
    p.add_argument("--domain", default="dining_room")
    p.add_argument("--capabilities", default="chat_completion")
    p.add_argument("--judge", default="openai/gpt-4o")
    p.add_argument("--max-items", type=int)
    p.add_argument("--sleep", type=float, default=0.2)
    p.add_argument("--output", default="./results")
    p.add_argument("--formats", default="json")
    p = sub.add_parser("generate", help="make test cases")
    p.add_argument("--num", type=int, default=100)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--output", required=True)
    p.add_argument("--single", action="store_true", help="one file, for small results")
    p = sub.add_parser("compare", help="compare result documents")
    p.add_argument("files", nargs="+")
    p.add_argument("--format", choices=("table", "json", "markdown"), default="table")
    p.add_argument("--output")
    for name in ("domains", "capabilities", "version"):
        sub.add_parser(name)
    return out


def config_of(args: argparse.Namespace) -> Benchmark:
    """The file's settings if one is named (it must exist), else those of the options."""
    if args.config:
        return Benchmark.from_yaml(args.config)
    models = tuple(Model.parse(s.strip()) for s in (args.models or "").split(",") if s.strip())
    judge = Model.parse(args.judge)
    return Benchmark("benchmark", models, args.domain, capabilities=tuple(args.capabilities.split(",")), judge=Judge(judge.provider, judge.model), settings=Settings(sleep_between_calls=args.sleep, max_items=args.max_items), output=Output(tuple(args.formats.split(",")), args.output))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pairloom.sources import files

    if args.command == "version":
        print(__version__)
    elif args.command == "domains":
        print("\n".join(files.domains()))
    elif args.command == "capabilities":
        print("\n".join(CAPABILITIES))
    else:
        from pyspark.sql import SparkSession

        from pairloom.operators import engine, evaluate, generate, report

        try:
            config = config_of(args).check() if args.command == "run" else None
            spark = SparkSession.builder.getOrCreate()
            if config:
                done = engine.run(files.read_cases(spark, args.dataset), config)
                for f, at in report.save(done, config.output.formats, config.output.directory, f"results_{done.started:%Y%m%d_%H%M%S}").items():
                    print(f"{f}: {at}")
                print(report.console(done.document()))
            elif args.command == "generate":
                files.write_lines(generate.generate(spark, args.num, args.seed).drop("idx"), args.output, single=args.single)
            else:
                told = report.comparison(evaluate.compare(files.read_results(spark, *args.files)), args.format)
                Path(args.output).write_text(told, encoding="utf-8") if args.output else print(told)
        except (ValueError, FileNotFoundError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

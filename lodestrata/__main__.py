"""python -m lodestrata run|validate|explain|info|operators ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def main() -> int:
    p = argparse.ArgumentParser(prog="lodestrata")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "explain"):
        s = sub.add_parser(name)
        s.add_argument("pipeline")
        s.add_argument("layers", nargs="+", help="name=path, the first is the input")
        if name == "run":
            s.add_argument("--output", required=True)
    sub.add_parser("validate").add_argument("pipeline")
    sub.add_parser("info").add_argument("path")
    sub.add_parser("operators")
    a = p.parse_args()

    from .operators import OPERATORS
    from .plans import pipeline

    if a.command == "operators":
        for o in OPERATORS.values():
            print(f"{o.family:15} {o.name}({', '.join(o.params)})")
        return 0
    if a.command == "validate":
        spec = json.loads(Path(a.pipeline).read_text())
        names = {x for s in (spec if isinstance(spec, list) else spec.get("steps", [])) for x in [s.get("ref_layer")] if x}
        problems = pipeline.validate(spec, {"input", *names})
        print("\n".join(problems) or "valid")
        return int(bool(problems))

    from pyspark.sql import SparkSession

    from .sources.vector import read_vector, write_vector

    spark = SparkSession.builder.appName("lodestrata").getOrCreate()
    if a.command == "info":
        from .operators.attribute import describe_report

        describe_report(read_vector(spark, a.path)).show(1000, False)
        return 0
    layers = {}
    for i, x in enumerate(a.layers):
        name, _, path = x.rpartition("=")
        layers[name or ("input" if not i else f"layer{i}")] = read_vector(spark, path)
    spec = json.loads(Path(a.pipeline).read_text())
    if a.command == "explain":
        for k, text in pipeline.explain(spec, layers).items():
            print(f"== {k}\n{text}")
        return 0
    write_vector(pipeline.run(spec, layers), a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

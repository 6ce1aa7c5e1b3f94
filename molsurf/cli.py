"""Benchmarks from the command line: ``python -m molsurf.cli run|compare|profiles|sweep|summary``.

run measures the samplers on structure files or demonstration molecules and appends
records; compare, profiles, sweep and summary read such records.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import COUNT_TOLERANCE, IMPROVEMENT, REGRESSION
from .operators import bench
from .operators.store import checkpointed
from .runs import METHODS, record_load_error, run, variants
from .sources.bench_json import read_payload, read_profiles, read_records
from .sources.structures import demo_molecules, read_demo, read_pdb


def records(spark: SparkSession, path: str):
    return bench.normalized(read_payload(spark, path) if path.endswith(".json") else read_records(spark, path))


def main(argv: list[str] | None = None) -> int:
    """Exit 1 with --fail-on-regression where a case is slower, changed its point count or is missing."""
    parser = argparse.ArgumentParser(description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare")
    c.add_argument("baseline")
    c.add_argument("current")
    c.add_argument("--regression-threshold", type=float, default=REGRESSION)
    c.add_argument("--improvement-threshold", type=float, default=IMPROVEMENT)
    c.add_argument("--point-count-tolerance", type=float, default=COUNT_TOLERANCE)
    c.add_argument("--fail-on-regression", action="store_true")
    s = sub.add_parser("sweep")
    s.add_argument("path")
    f = sub.add_parser("profiles")
    f.add_argument("path")
    f.add_argument("--profile-dir")
    t = sub.add_parser("summary")
    t.add_argument("path")
    for p in (c, s, f, t):
        p.add_argument("--output-json", help="a folder: a table of the report each")
        p.add_argument("--limit", type=int, default=50)
    r = sub.add_parser("run")
    r.add_argument("structures", nargs="+", help="PDB files, or names of demonstration molecules")
    r.add_argument("--records", required=True)
    r.add_argument("--methods", default=",".join(METHODS))
    r.add_argument("--interfaces", default="points")
    r.add_argument("--sweep", action="append", default=[], metavar="METHOD.KEY=V1,V2", help="values of a parameter, one at a time")
    r.add_argument("--repeats", type=int, default=1)
    r.add_argument("--version", default="1")
    r.add_argument("--most-atoms", type=int)
    r.add_argument("--surfaces", help="a folder of reference surfaces, <molecule>.ply")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "run":
        axes: dict[str, dict[str, list]] = {}
        for text in args.sweep:
            name, _, values = text.partition("=")
            method, _, key = name.partition(".")
            axes.setdefault(method, {})[key] = [float(v) if "." in v else int(v) for v in values.split(",")]
        demos = set(demo_molecules())
        todo, new = variants(args.methods.split(","), axes, args.interfaces.split(",")), 0
        for name in args.structures:  # one at a time, so a file that cannot be read costs its own runs only
            try:
                own = read_demo(spark, name) if name in demos else read_pdb(spark, name)
                own = checkpointed(own.select(own["mol_id"].cast("string").alias("mol_id"), "atom_idx", "x", "y", "z", "radius"))
            except Exception as e:  # recorded, and the other structures go on
                new += record_load_error(spark, name, e, todo, args.records, args.repeats, args.version)
                continue
            new += run(spark, own, todo, args.records, args.repeats, args.version, args.most_atoms, args.surfaces)
        print(f"{new} new records")
        return 0
    failed, report = False, {}
    if args.command == "compare":
        base, now = records(spark, args.baseline), records(spark, args.current)
        cases = bench.compare(base, now, args.regression_threshold, args.improvement_threshold, args.point_count_tolerance).persist()
        report = {kind: bench.top(cases, kind, args.limit) for kind in ("regression", "improvement", "points_changed")}
        report |= {"cases": cases, "unmatched": bench.unmatched(base, now), "variants": bench.variant_rollup(cases)}
        missing = report["unmatched"].where("side = 'baseline'")
        failed = args.fail_on_regression and not (cases.where("regression OR points_changed").isEmpty() and missing.isEmpty())
    elif args.command == "profiles":
        payloads, errors = read_profiles(spark, args.path, args.profile_dir)
        functions = payloads.select("internal_profile.top_functions")
        calls = payloads.select("pdb_id", "method", "interface_mode", "internal_profile.top_calls").where("top_calls is not null")
        report = {"errors": errors, "calls": bench.slowest_calls(calls, args.limit), "ops": bench.profile_ops(payloads.select("torch_profile.top_ops"), args.limit), "functions": bench.profile_rollup(functions, args.limit)}
        failed = not errors.isEmpty()
    elif args.command == "summary":
        report = {"summary": bench.summarize(records(spark, args.path)), "status": bench.status_counts(records(spark, args.path)), "reference": bench.reference_status(records(spark, args.path)), "fastest": bench.fastest(records(spark, args.path))}
    else:
        report = {"variants": bench.sweep(records(spark, args.path))}
    for name, table in report.items():
        print(name)
        table.show(args.limit, False)
        if args.output_json:
            table.write.mode("overwrite").json(f"{args.output_json}/{name}")
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())

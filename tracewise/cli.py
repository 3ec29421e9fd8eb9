"""Stages from the command line: `python -m tracewise.cli STAGE ...`. Each stage can show its settings, or check its data, and stop."""

from __future__ import annotations

import argparse
import json
import sys

from tracewise.functions import rewards as M
from tracewise.operators import evaluate as E
from tracewise.operators import sampling as B
from tracewise.session import session
from tracewise.sources import files, loaders, reports

STAGES = ("tables", "evaluate", "split")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewise", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--caption", default="", help="caption score files, comma-separated")
    p.add_argument("--numeric", default="", help="numeric score files, comma-separated")
    p.add_argument("--best", help="calibration document")
    p.add_argument("--kappa", type=float, default=0.0)
    p.add_argument("--data", help="JSON-line file of examples")
    p.add_argument("--input-mode", choices=("pair", "context"), default="pair")
    p.add_argument("--max-samples", type=M.positive_int)
    p.add_argument("--train-ratio", type=M.ratio, default=0.8)
    p.add_argument("--val-ratio", type=M.ratio, default=0.1)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--output", required=True)
    p.add_argument("--config-only", action="store_true", help="print the settings and stop")
    p.add_argument("--validate-data-only", action="store_true", help="read the data, print counts and stop")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    M.check_kappa(args.kappa)
    if args.config_only:
        print(json.dumps(vars(args), sort_keys=True))
        return 0
    spark = session(f"tracewise-{args.stage}")
    if args.stage == "tables":
        caption, numeric = files.split_list(args.caption), files.split_list(args.numeric)
        if args.validate_data_only:
            good, bad = loaders.load_scores(spark, [*caption, *numeric])
            print(json.dumps({"rows": good.count(), "errors": bad.count()}))
        else:
            print(json.dumps(reports.rebuild_tables(spark, caption, numeric, args.output, best=args.best, kappa=args.kappa), sort_keys=True))
    elif args.stage == "evaluate":
        rows = loaders.load_evaluation(spark, args.data, args.input_mode, args.max_samples)
        if args.validate_data_only or "p_positive" not in rows.columns:
            counts = rows.groupBy("data_source").count().orderBy("data_source").collect()
            print(json.dumps({r["data_source"]: r["count"] for r in counts}))
        else:
            files.write_csv(E.metrics_by_dimension(E.predictions(rows), ["data_source", "policy_model"]), args.output, ["dimension", "value", "accuracy", "macro_f1"])
    else:
        rows = loaders.load_reward_examples(spark, args.data)
        if args.validate_data_only:
            print(json.dumps({"rows": rows.count()}))
        else:
            B.grouped_split(rows, "source_sample_id", args.train_ratio, args.val_ratio, args.seed).write.partitionBy("split").mode("errorifexists").json(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())

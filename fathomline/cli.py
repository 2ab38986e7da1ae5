"""Command line: ``backtest`` single, batch, compare, optimize, walk-forward; ``research`` stage by stage."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import factors
from fathomline.operators import folds, metrics, search, signals
from fathomline.plans.stages import OUTPUTS, STAGES, Config, backtests, load_stage, research
from fathomline.sources import prices as source

#: Options that name the artefacts of a stage, in the order of the stages.
ARTEFACTS = ("--preprocess-path", "--factor-selection-path", "--stability-analysis-path", "--dedup-selection-path", "--factor-combination-path")
BACKTESTS = ("single", "batch", "compare", "optimize", "walk-forward")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fathomline")
    kinds = top.add_subparsers(dest="kind", required=True)
    for kind, commands in (("backtest", BACKTESTS), ("research", STAGES)):
        sub = kinds.add_parser(kind).add_subparsers(dest="command", required=True)
        for command in commands:
            p = sub.add_parser(command)
            p.add_argument("--prices", required=True, help="table of date, code, nav")
            p.add_argument("--fund-code")
            p.add_argument("--fund-codes", help="comma-separated")
            p.add_argument("--output-dir", default="outputs")
            p.add_argument("--strategy-name", choices=list(signals.STRATEGIES), default="multi_factor_score")
            p.add_argument("--init-cash", type=float)
            p.add_argument("--fees", type=float)
            p.add_argument("--ma-fast", type=int)
            p.add_argument("--ma-slow", type=int)
            p.add_argument("--momentum-window", type=int)
            p.add_argument("--n-trials", type=int)
            p.add_argument("--wf-window-size", type=int)
            p.add_argument("--wf-step-size", type=int)
            p.add_argument("--factor-groups", help="comma-separated")
            p.add_argument("--full-grid", action="store_true")
            p.add_argument("--train-min-spearman-ic", type=float)
            p.add_argument("--train-min-spearman-icir", type=float)
            p.add_argument("--ic-exp-weighted", action="store_true")
            p.add_argument("--dedup-root-topk", type=int)
            for name in ARTEFACTS:
                p.add_argument(name, help="comma-separated artefacts to go on from")
    return top


def config_of(args: argparse.Namespace) -> Config:
    params = {"ma_cross": {k: v for k, v in (("fast", args.ma_fast), ("slow", args.ma_slow)) if v is not None}, "momentum": {"window": args.momentum_window} if args.momentum_window is not None else {}}
    groups = tuple(args.factor_groups.split(",")) if args.factor_groups else None
    return Config().override(output_dir=args.output_dir, strategy=args.strategy_name, params=params, init_cash=args.init_cash, fees=args.fees, n_trials=args.n_trials, window=args.wf_window_size, step=args.wf_step_size, factor_groups=groups, full_grid=args.full_grid or None, min_ic=args.train_min_spearman_ic, min_icir=args.train_min_spearman_icir, exp_weighted=args.ic_exp_weighted or None, root_topk=args.dedup_root_topk)


def chosen(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = source.read_prices(spark, args.prices).select(source.pad_code(F.col("code")).alias("code"), F.col("date").cast("date").alias("date"), F.col("nav").cast("double").alias("nav")).dropna()
    wanted = args.fund_codes.split(",") if args.fund_codes else [args.fund_code] if args.fund_code else None
    return rows if wanted is None else rows.where(F.col("code").isin(wanted))


def run(spark: SparkSession, argv: list[str]) -> DataFrame | dict:
    """Runs a command and returns its table, or the artefact paths of a research stage."""
    args = parser().parse_args(argv)
    config, rows = config_of(args), chosen(spark, args)
    if args.kind == "research":
        named = [(k, vars(args)[a.removeprefix("--").replace("-", "_")]) for k, a in enumerate(ARTEFACTS)]
        start = {}
        for stage, paths in ((k, v) for k, v in named if v):
            if stage >= STAGES.index(args.command):
                raise ValueError(f"{ARTEFACTS[stage]} belongs to a later stage than {args.command}")
            start = {load_stage(p, stage)[OUTPUTS[stage]]["fund_code"]: p for p in paths.split(",")}
        return research(spark, rows, config, args.command, start or None)
    if args.command in ("single", "batch"):
        return backtests(rows, config)
    if args.command == "compare":
        return backtests(rows, config, list(signals.STRATEGIES))
    prepared = factors.prepare(rows).drop("ret")
    sizes = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    if args.command == "optimize":
        table = folds.fold_table(spark, rows, lambda n: [(1, s, a, b) for s, (a, b) in folds.ratio_split(n).items()])
        return search.optimize(spark, prepared, sizes.join(F.broadcast(table), "n").drop("n", "fold_id"), config.strategy, config.n_trials, config.params.get(config.strategy))
    table = folds.fold_table(spark, rows, lambda n: folds.walk_forward(n, config.window, config.step))
    return metrics.walk_forward_summary(search.walk_forward(spark, prepared, sizes.join(F.broadcast(table), "n").drop("n"), config.n_trials, config.strategy, config.params.get(config.strategy)))


def main() -> None:
    import sys

    spark = SparkSession.builder.getOrCreate()
    out = run(spark, sys.argv[1:])
    out.show(200, False) if isinstance(out, DataFrame) else print(out)


if __name__ == "__main__":
    main()

"""Command line: ``python -m edgeprobe.cli COMMAND CONFIG [--set a.b=v]``; it computes nothing itself."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import api, config, ledger_view, report
from .errors import EdgeprobeError
from .operators import ledger
from .sources import coverage

COMMANDS = ("run", "budget", "audit", "robust", "sweep", "features", "ablate", "log", "fetch", "xsec")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="edgeprobe")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("config")
    p.add_argument("--set", action="append", default=[], metavar="a.b=v", help="change one key of the configuration")
    p.add_argument("--strategy", default=None, help="the strategy of robust and sweep")
    p.add_argument("--symbols", nargs="*", default=None, help="only these symbols")
    p.add_argument("--universe", default=None, metavar="yyyy-MM", help="the symbols that had bars in that month, for xsec")
    p.add_argument("--reference", default=None, help="the symbol of the books that need no model, for xsec")
    p.add_argument("--trials", type=int, default=None, help="how many variants were tried, instead of what the ledger says, for run and xsec")
    p.add_argument("--save", default=None, metavar="FOLDER", help="write the measures as JSON, too")
    p.add_argument("--group", nargs="*", default=["vol_24"], help="the features that ablate leaves out")
    p.add_argument("--end", default="", metavar="yyyy-MM", help="the last month of the sample, for xsec")
    p.add_argument("--top", type=int, default=None, help="only so many of the most traded symbols, for xsec")
    p.add_argument("--verify", action="store_true", help="the controls of a cross-section, too")
    p.add_argument("--verdict", default=None, help="only runs with this verdict, for log")
    p.add_argument("--last", type=int, default=20, help="how many of the latest runs, for log")
    p.add_argument("--no-record", action="store_true")
    return p


def _rows(frame, most: int = 1000):
    return [r.asDict() for r in frame.limit(most).collect()]


def _show(a, spark, cfg, record: bool) -> None:
    if a.command == "audit":
        print(report.checks(api.audit(spark, cfg, record=record)))
    elif a.command == "robust":
        verdict, gates = api.robust(spark, cfg, record=record, strategy=a.strategy or "sma_cross")
        print(report.gates(verdict, gates))
    elif a.command == "xsec":
        found = api.xsec(spark, cfg, a.end, top_n=a.top, record=record, universe_month=a.universe, symbols=a.symbols, reference=a.reference, n_trials=a.trials)
        print(report.panel(_rows(found.folds.orderBy("fold")), _rows(found.measures), _rows(found.costs)))
        if a.verify:
            print(report.checks(api.verify_panel(cfg, found)))
        if a.save:
            print(coverage.save_metrics(found.measures, a.save, f"{cfg.name}-xsec"))
    elif a.command == "ablate":
        print(report.ablation(api.ablate(spark, cfg, a.group, record=record)))
    elif a.command == "log":
        ledger_view.summary(spark, cfg.ledger).show(truncate=False)
        runs = ledger.load(spark, cfg.ledger)
        print(report.runs(_rows(ledger.recent(runs, a.verdict, a.last)), ledger.unrecorded(runs).first()[0]))
    else:
        frame = {
            "run": lambda: api.run(spark, cfg, record, a.trials), "budget": lambda: api.budget(spark, cfg), "features": lambda: api.feature_importance(spark, cfg),
            "sweep": lambda: api.sweep(spark, cfg, strategy=a.strategy or "ml_direction", record=record), "fetch": lambda: api.fetch(spark, cfg),
        }[a.command]()
        rows = _rows(frame)
        if a.command == "sweep":
            print(report.sweep(rows))
        else:
            print({"run": report.measures, "budget": report.budget}.get(a.command, report.table)(rows))
        if a.command == "run":
            print("\n".join(f"warning: {x}" for x in api.warnings(spark, cfg)))
        if a.save:
            print(coverage.save_metrics(frame, a.save, f"{cfg.name}-{a.command}"))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        cfg = config.load(a.config, dict(x.split("=", 1) for x in a.set))
        spark = SparkSession.builder.appName("edgeprobe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        _show(a, spark, cfg, not a.no_record)
    except EdgeprobeError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Results as text: small tables of measures that have been collected, nothing computed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def _cell(x) -> str:
    if x is None:
        return "-"
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, float):
        return f"{x:.4g}"
    return str(x)


def table(rows: Iterable[Mapping], columns: list[str] | None = None) -> str:
    """Rows as aligned columns; numbers to the right."""
    rows = [dict(r) for r in rows]
    if not rows:
        return "(nothing)"
    columns = columns or list(rows[0])
    cells = [[_cell(r.get(c)) for c in columns] for r in rows]
    wide = [max(len(c), *(len(r[k]) for r in cells)) for k, c in enumerate(columns)]
    right = [any(isinstance(r.get(c), (int, float)) and not isinstance(r.get(c), bool) for r in rows) for c in columns]
    line = lambda r: "  ".join(x.rjust(w) if n else x.ljust(w) for x, w, n in zip(r, wide, right, strict=True)).rstrip()
    return "\n".join([line(columns), "  ".join("-" * w for w in wide), *map(line, cells)])


def grid(rows: Iterable[Mapping], down: str, across: str, value: str) -> str:
    """One value over two parameters."""
    rows = [dict(r) for r in rows]
    names = sorted({r[across] for r in rows})
    lines = [{down: a} | {str(b): next((r[value] for r in rows if r[down] == a and r[across] == b), None) for b in names} for a in sorted({r[down] for r in rows})]
    return table(lines)


def checks(found) -> str:
    """An audit: a line for each check."""
    mark = {True: "pass", False: "FAIL", None: "  ? "}
    return "\n".join(f"{mark[c.passed]}  {c.name}" + (f": {c.detail}" if c.detail else "") for c in found)


def gates(verdict: str, found) -> str:
    """A verdict and the gates that led to it."""
    return "\n".join([f"verdict: {verdict}", *(f"{g.outcome:5} {g.name}" + (f": {g.reason}" if g.reason else "") for g in found)])


def measures(rows: Iterable[Mapping]) -> str:
    """A run: what matters of each strategy, the deflated ratio beside the plain one, and how often the ledger says one has tried."""
    keep = ["strategy", "symbol", "bars", "total_return", "cagr", "ann_vol", "sharpe", "deflated_sharpe", "p_value", "max_drawdown", "n_trades", "cost_drag"]
    rows = [dict(r) for r in rows]
    return table(rows, [c for c in keep if rows and c in rows[0]] or None)


def sweep(rows: Iterable[Mapping]) -> str:
    """Sharpe ratios over entries and holds, a grid for each symbol; a lone peak among losses is a fit to noise."""
    rows = [dict(r) for r in rows]
    parts = []
    for symbol in sorted({r["symbol"] for r in rows}):
        mine = [r for r in rows if r["symbol"] == symbol]
        good = sum((r["sharpe"] or 0) > 0 for r in mine)
        parts.append(f"{symbol}: {good} of {len(mine)} cells above 0\n{grid(mine, 'long_entry', 'min_hold', 'sharpe')}")
    return "\n\n".join(parts) or "(nothing)"


def budget(rows: Iterable[Mapping]) -> str:
    """What a bet must win at each hold: the move, the accuracy needed, and the edge at given accuracies, which is negative where costs win."""
    rows = [dict(r) for r in rows]
    lines = {}
    for r in rows:
        line = lines.setdefault((r["symbol"], r["hold"]), {"symbol": r["symbol"], "hold": r["hold"], "move": r["move"], "needed": r["needed"]})
        line[f"at {r['accuracy']:.0%}"] = r["edge"]
    return table(lines[k] for k in sorted(lines))


def panel(folds: Iterable[Mapping], books: Iterable[Mapping], costs: Iterable[Mapping]) -> str:
    """A cross-section: its folds, its books, and their Sharpe ratios as trading grows dearer."""
    keep = ["book", "bars", "total_return", "sharpe", "deflated_sharpe", "p_value", "max_drawdown", "turnover_per_year", "cost_drag"]
    return "\n\n".join(["folds\n" + table(folds), "books, out of sample\n" + table(books, keep), "Sharpe by slippage (hundredths of a percent)\n" + grid(costs, "slippage_bps", "book", "sharpe")])


def ablation(found: Mapping) -> str:
    """Mean AUC with and without the features, and whether the folds tell them apart."""
    better = found["with"] - found["without"]
    told = "can be told from chance" if found["p"] is not None and found["p"] < 0.05 else "can't be told from chance"
    return f"AUC with {found['with']:.4f}, without {found['without']:.4f}: {better:+.4f} over {found['folds']} folds, which {told} (t {found['t']:.2f}, p {found['p']:.3f})"


def runs(rows: Iterable[Mapping], unrecorded: int = 0) -> str:
    """The latest runs of a ledger, and how many of all runs don't say what they tried."""
    keep = ["timestamp", "command", "config_hash", "verdict", "variants", "notes"]
    return table(rows, keep) + (f"\n{unrecorded} runs don't say how many variants they tried, and count as one" if unrecorded else "")

"""The ledger of runs: how many hypotheses were tried, and which earlier ones were nearly the same."""

from __future__ import annotations

import hashlib
import json
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that name a run and don't change it.
COSMETIC = ("name", "run.name", "run.out_dir", "run.notes")


def flatten(config: dict, prefix: str = "") -> dict[str, str]:
    """A nested configuration as dotted keys with text values; lists are joined by commas."""
    out: dict[str, str] = {}
    for k, v in config.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    return out


def fingerprint(config: dict) -> str:
    """Twelve hex digits of what matters in a configuration."""
    flat = {k: v for k, v in flatten(config).items() if k not in COSMETIC}
    return hashlib.sha256(json.dumps(flat, sort_keys=True).encode()).hexdigest()[:12]


def record(folder: str, command: str, config: dict, metrics: dict, verdict: str | None = None, variants: int | None = None, notes: str = "") -> str:
    """Append one run as a JSON file; nothing is overwritten."""
    now = datetime.now(UTC)
    run = {"timestamp": now.isoformat(), "command": command, "config_hash": fingerprint(config), "config": flatten(config), "metrics": metrics, "verdict": verdict, "variants": variants, "notes": notes}
    run["git_sha"], run["git_dirty"] = git_state()
    name = f"{now:%Y%m%d-%H%M%S}-{hashlib.sha256(json.dumps(run, sort_keys=True, default=str).encode()).hexdigest()[:8]}"
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    with (path / f"{name}.json").open("x") as f:
        json.dump({"id": name, **run}, f, indent=1, default=str)
    return name


def load(spark: SparkSession, folder: str) -> DataFrame:
    """All runs that can be read; damaged files are left out."""
    schema = "id string, timestamp string, command string, config_hash string, config map<string,string>, verdict string, variants int, notes string, git_sha string, git_dirty boolean, _corrupt_record string"
    runs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    return runs.where("config_hash is not null").drop("_corrupt_record")


def count_trials(runs: DataFrame, prior: int = 0) -> DataFrame:
    """One number: variants tried, repeated runs of one configuration counted once, synthetic data not at all."""
    real = runs.where(F.coalesce(F.col("config")["data.source"], F.lit("")) != "synthetic")
    each = real.groupBy("config_hash", "command").agg(F.max(F.greatest(F.coalesce("variants", F.lit(1)), F.lit(1))).alias("v"))
    return each.agg((F.coalesce(F.sum("v"), F.lit(0)) + prior).alias("trials"))


def near_misses(runs: DataFrame, config: dict[str, str], most: int = 3) -> DataFrame:
    """Runs whose configuration differs from this one in one to ``most`` keys, none of them of the data."""
    mine = F.create_map(*[F.lit(x) for kv in config.items() for x in kv])
    keys = F.array_union(F.map_keys("config"), F.map_keys(mine))
    differ = F.filter(keys, lambda k: ~F.element_at("config", k).eqNullSafe(F.element_at(mine, k)))
    b = runs.withColumn("_d", differ).where((F.size("_d") >= 1) & (F.size("_d") <= most) & ~F.exists("_d", lambda k: k.startswith("data.")))
    return b.withColumn("distance", F.size("_d")).drop("_d").orderBy("distance", *[c for c in ("config_hash", "timestamp") if c in b.columns])


def recent(runs: DataFrame, verdict: str | None = None, n: int = 20) -> DataFrame:
    """The last ``n`` runs, perhaps only those with a verdict, the latest first."""
    return (runs.where(F.col("verdict") == verdict) if verdict else runs).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def unrecorded(runs: DataFrame) -> DataFrame:
    """One number: runs that don't say how many variants they tried, and so count as one."""
    return runs.agg(F.count_if(F.col("variants").isNull()).alias("unrecorded"))


def warning(similar: DataFrame, most: int = 5) -> str:
    """What to say of runs that were nearly the same as this one; empty if there are none."""
    rows = similar.limit(most + 1).collect()
    if not rows:
        return ""
    lines = [f"  {r['config_hash']} ({r['command']}) differs in {r['distance']} keys" + (f", verdict {r['verdict']}" if "verdict" in r and r["verdict"] else "") for r in rows[:most]]
    return "\n".join(["nearly the same has been run before:", *lines, *(["  and more"] if len(rows) > most else [])])


def git_state(folder: str = ".") -> tuple[str, bool | None]:
    """The commit of a working tree and whether it has changes; ("", None) where there is none."""
    try:
        ask = lambda *words: subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        return ask("rev-parse", "--short=12", "HEAD"), bool(ask("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        return "", None

"""Configuration of a scan and its rules, from TOML, and diffs from git."""

from __future__ import annotations

import subprocess
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .scan import IGNORED_DIRS, IGNORED_FILES, MAX_BYTES


@dataclass
class Rules:
    forbidden: list[dict] = field(default_factory=list)
    instability: list[dict] = field(default_factory=list)
    max_complexity: int = 20
    max_risk: float | None = None


@dataclass
class ScanConfig:
    ignored_dirs: tuple[str, ...] = IGNORED_DIRS
    ignored_files: tuple[str, ...] = IGNORED_FILES
    max_file_size_bytes: int = MAX_BYTES
    enable_cache: bool = True
    rules: Rules = field(default_factory=Rules)


def load(root: str, name: str = "strandline") -> ScanConfig:
    """<name>.toml at the root, else [tool.<name>] of pyproject.toml, else the defaults; unreadable files give the defaults.

    Folders and files to ignore come on top of the defaults.
    """
    own, project = Path(root) / f"{name}.toml", Path(root) / "pyproject.toml"
    try:
        if own.exists():
            data = tomllib.loads(own.read_text("utf-8"))
        elif project.exists():
            data = tomllib.loads(project.read_text("utf-8")).get("tool", {}).get(name, {})
        else:
            data = {}
    except (tomllib.TOMLDecodeError, OSError, UnicodeDecodeError):
        data = {}
    rules = data.get("rules", {})
    forbidden = [
        {"from": r.get("from", r.get("from_pattern", "")), "to": r.get("to", r.get("to_pattern", "")), "message": r.get("message", r.get("description")), "severity": r.get("severity", "error")} for r in rules.get("forbidden_imports", [])
    ]
    unstable = [{"module": r.get("module", ""), "max_i": float(r.get("max_i", 0.5))} for r in rules.get("max_instability", [])]
    risk = rules.get("max_risk_gate")
    return ScanConfig(
        tuple(dict.fromkeys([*IGNORED_DIRS, *data.get("ignored_dirs", [])])), tuple(dict.fromkeys([*IGNORED_FILES, *data.get("ignored_files", [])])), int(data.get("max_file_size_bytes", MAX_BYTES)), bool(data.get("enable_cache", True)),
        Rules(forbidden, unstable, int(rules.get("max_complexity", rules.get("max_cyclomatic_complexity", 20))), None if risk is None else float(risk)),
    )


def git_diff(spark: SparkSession, root: str, base: str = "HEAD~1", staged: bool = False) -> DataFrame:
    """One row (diff_id, text); a failing git gives an empty text."""
    args = ["git", "diff", "--unified=0", "--staged" if staged else base]
    try:
        done = subprocess.run(args, cwd=root, capture_output=True, text=True, timeout=60, check=False)
        text = done.stdout if done.returncode == 0 else ""
    except (OSError, subprocess.SubprocessError):
        text = ""
    return spark.createDataFrame([("staged" if staged else base, text)], "diff_id string, text string")

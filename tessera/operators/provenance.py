"""Provenance: configuration hashes, versions, commit, result routing. Driver side, but for the hash, which is a column too."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import re
import subprocess
import time
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(value: object) -> object:
    """A JSON-safe copy of nested values with NumPy numbers, arrays and tuples."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset, np.ndarray)):
        return [plain(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, np.generic):
        return value.item()
    return value


def config_hash(config: dict) -> str:
    """First twelve hexadecimal digits of the SHA-256 of sorted, compact JSON."""
    text = json.dumps(plain(config), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def config_hash_column(json_text: Column) -> Column:
    """config_hash of a column of JSON text that is already sorted and compact."""
    return F.substring(F.sha2(json_text, 256), 1, 12)


def stable_repr(value: object) -> str:
    """repr without memory addresses."""
    return re.sub(r" at 0x[0-9a-fA-F]+", "", repr(value))


def git_hash(folder: str | Path = ".", ignore: tuple[str, ...] = ("results", "figures", "splits")) -> str:
    """HEAD, with -dirty if files outside the ignored folders changed; nocommit without commits, nogit without a repository.

    Read from one porcelain report: its header names the commit, every other line is a change.
    """
    where = ["--", ".", *(f":(exclude){name}" for name in ignore)]
    try:
        report = subprocess.run(["git", "-C", str(folder), "status", "--porcelain=v2", "--branch", *where], capture_output=True, text=True)
    except FileNotFoundError:
        return "nogit"
    if report.returncode:
        return "nogit"
    lines = report.stdout.splitlines()
    commit = next((line.split()[-1] for line in lines if line.startswith("# branch.oid")), "(initial)")
    if commit == "(initial)":
        return "nocommit"
    return commit + "-dirty" * any(not line.startswith("#") for line in lines)


def package_versions(names: list[str]) -> dict[str, str | None]:
    def version(name: str) -> str | None:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return None

    return {name: version(name) for name in names}


def pinned_versions(text: str) -> dict[str, str]:
    """name==version lines of a requirements text."""
    return dict(m.groups() for line in text.splitlines() if (m := re.match(r"\s*([A-Za-z0-9_.-]+)\s*==\s*([^\s;#]+)", line)))


class EnvironmentError_(RuntimeError):
    """A pinned package is missing."""


def check_environment(pins: dict[str, str]) -> list[str]:
    """Warnings for versions other than pinned; raises if a pinned package is missing."""
    found = package_versions(list(pins))
    if missing := [n for n, v in found.items() if v is None]:
        raise EnvironmentError_(f"missing packages: {missing}")
    return [f"{n} is {found[n]}, pinned {v}" for n, v in pins.items() if found[n] != v]


def output_groups(names: Column, routes: list[tuple[str, str]]) -> Column:
    """Folder of the first (pattern, folder) whose pattern a result name begins with, "" for none."""
    case = F.when(F.lit(False), F.lit(""))
    for pattern, folder in routes:
        case = case.when(names.rlike(f"^(?:{pattern})"), F.lit(folder))
    return case.otherwise(F.lit(""))


def routed_path(root: str | Path, name: str, routes: list[tuple[str, str]]) -> Path:
    """Where the result or figure `name` belongs under root; its folder is made if it is not there."""
    whole = re.compile("|".join(f"(?P<g{k}>{pattern})" for k, (pattern, _) in enumerate(routes)) or "(?!)")
    hit = whole.match(name)
    path = Path(root, routes[int(hit.lastgroup[1:])][1] if hit else "", name)
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


@contextmanager
def timed(label: str, log=print):
    began = time.time()
    yield
    log(f"{label}: {time.time() - began:.1f} s")

"""Path rules: normal form, containment on component borders, workspace root."""

from __future__ import annotations

import os
import posixpath
import subprocess

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_path(path: str | None) -> str | None:
    """The lexical normal form of an absolute or relative POSIX path; None and '' stay as they are."""
    if not path:
        return path
    out = posixpath.normpath(path.strip())
    return out[1:] if out.startswith("//") else out


def _normalize_all(path: pd.Series) -> pd.Series:
    return path.map(normalize_path, na_action="ignore")


def normalized(column: Column) -> Column:
    """Normal form of a path column; only untidy paths leave the JVM's expressions."""
    tidy = ~column.rlike(r"//|(^|/)\.\.?(/|$)|.+/$|^\s|\s$")
    return F.when(column.isNull() | tidy, column).otherwise(F.pandas_udf(_normalize_all, T.StringType())(column))


def is_within(child: Column | str, root: str) -> Column:
    """child equals root or lies below it on a component border; / contains every absolute path."""
    c = F.col(child) if isinstance(child, str) else child
    base = normalize_path(root)
    if base == "/":
        return c.startswith("/")
    return (c == base) | c.startswith(f"{base}/")


def workspace_root(explicit: str | None, cwd: str) -> str:
    """An explicit root, else the top of the git worktree around cwd, else cwd."""
    if explicit:
        return os.path.realpath(explicit)
    try:
        top = subprocess.run(["git", "-C", cwd, "rev-parse", "--show-toplevel"], capture_output=True, text=True, timeout=10)
        if top.returncode == 0 and top.stdout.strip():
            return os.path.realpath(top.stdout.strip())
    except (OSError, subprocess.SubprocessError):
        pass
    return os.path.realpath(cwd)

"""YAML configuration with environment variables, and sessions from it."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Mapping
from pathlib import Path
from typing import TextIO

import yaml
from pyspark.sql import SparkSession

_VARIABLE = re.compile(r"\$\{([^}:]+)(?::([^}]*))?\}")


def load_config(source: Path | str | TextIO | None = None, unsafe: bool = False) -> dict:
    """A path, a YAML text, an open file, or standard input. ``${NAME}`` and ``${NAME:default}`` stand for variables; unset ones without a default are empty."""
    if source is None:
        text = sys.stdin.read()
    elif isinstance(source, Path):
        text = source.read_text()
    elif isinstance(source, str):
        text = Path(source).read_text() if "\n" not in source and Path(source).is_file() else source
    else:
        text = source.read()
    filled = _VARIABLE.sub(lambda m: os.environ.get(m[1], m[2] or ""), text)
    return yaml.load(filled, Loader=yaml.UnsafeLoader if unsafe else yaml.FullLoader)


def create_session(settings: Mapping | None = None) -> SparkSession:
    """A session by ``master``, ``remote``, ``appName``, ``getOrCreate`` and the free mapping ``config``.

    The master is local[*] unless another is given or the session is remote. Without getOrCreate a session of its own
    state shares the context that runs.
    """
    given = dict(settings or {})
    builder = SparkSession.builder.appName(given.get("appName") or "graphloom")
    if remote := given.get("remote"):
        builder = builder.remote(remote)
    else:
        builder = builder.master(given.get("master") or "local[*]")
    for k, v in (given.get("config") or {}).items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    return session if given.get("getOrCreate", True) else session.newSession()

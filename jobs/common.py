"""What the jobs share: configuration, the command line's session, logging."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable
from typing import Any

import yaml

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.errors import ConfigError  # noqa: E402
from corpusloom.session import get_session, share_code  # noqa: E402


def load_config(path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """``defaults`` with what the YAML file at ``path`` says; other keys than those of ``defaults`` are an error."""
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    if not isinstance(found, dict):
        raise ConfigError(f"{path}: settings by name are expected")
    return settings(found, defaults)


def settings(given: dict[str, Any] | None, defaults: dict[str, Any]) -> dict[str, Any]:
    unknown = sorted(set(given or {}) - set(defaults))
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(unknown)}; known are {', '.join(defaults)}")
    return defaults | (given or {})


def command_line(run: Callable, paths: tuple[str, ...], defaults: dict[str, Any], doc: str) -> int:
    """Parses plain paths and ``--config``, and calls ``run`` with a session that it stops afterwards."""
    parser = argparse.ArgumentParser(description=doc)
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=os.path.splitext(sys.modules[run.__module__].__file__)[0] + ".yaml")
    parser.add_argument("--master", help="for a run on one machine; on a cluster spark-submit names it")
    options = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = get_session(f"job-{os.path.basename(sys.argv[0])}", options.master)
    try:
        share_code(spark)
        run(spark, *[getattr(options, p) for p in paths], config=load_config(options.config, defaults))
    finally:
        spark.stop()
    return 0

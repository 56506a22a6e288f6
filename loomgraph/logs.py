"""Logging of the driver: the console, and a file with the stage and the source file of each line."""

from __future__ import annotations

import logging
import os
import sys

NAME = "loomgraph"


class _Fields(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.stage, record.source_file = getattr(record, "stage", "-"), getattr(record, "source_file", "-")
        return True


def setup_logging(out_dir: str | None = None, verbose: bool = False) -> logging.Logger:
    """The library's logger with fresh handlers; out_dir (local) gets build.log, which takes all levels from DEBUG on."""
    log = logging.getLogger(NAME)
    log.setLevel(logging.DEBUG)
    log.propagate = False
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    console = logging.StreamHandler(sys.stderr)
    console.setLevel(logging.DEBUG if verbose else logging.WARNING)
    console.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    handlers: list[logging.Handler] = [console]
    if out_dir is not None:
        os.makedirs(out_dir, exist_ok=True)
        file = logging.FileHandler(os.path.join(out_dir, "build.log"), encoding="utf-8")
        file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s [%(stage)s] [%(source_file)s] %(message)s"))
        handlers.append(file)
    for handler in handlers:
        handler.addFilter(_Fields())
        log.addHandler(handler)
    return log

"""Logging for applications that use this library."""

from __future__ import annotations

import logging
import sys


def set_up_logging(level: int = logging.INFO) -> logging.Logger:
    """Sends the library's messages to standard output; called again it only sets the level."""
    log = logging.getLogger("candlewick")
    log.setLevel(level)
    if not log.handlers:
        out = logging.StreamHandler(sys.stdout)
        out.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(out)
    return log

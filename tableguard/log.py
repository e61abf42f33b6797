"""Package logging: one handler, level from TABLEGUARD_LOG_LEVEL."""

from __future__ import annotations

import logging
import os

ROOT = "tableguard"
LEVEL_VARIABLE = "TABLEGUARD_LOG_LEVEL"


def configure(level: str | None = None) -> logging.Logger:
    """Set the package logger up; calling it again only changes the level."""
    root = logging.getLogger(ROOT)
    if not any(getattr(h, "_tableguard", False) for h in root.handlers):
        handler = logging.StreamHandler()
        handler._tableguard = True
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        root.addHandler(handler)
        root.propagate = False
    wanted = (level or os.environ.get(LEVEL_VARIABLE) or "INFO").upper()
    root.setLevel(wanted if isinstance(logging.getLevelName(wanted), int) else "INFO")
    return root


configure_logging = configure


def get_logger(name: str | None = None) -> logging.Logger:
    """The package logger, or one below it; a name inside the package stays as it is."""
    if not name or name == ROOT:
        return logging.getLogger(ROOT)
    return logging.getLogger(name if name.startswith(f"{ROOT}.") else f"{ROOT}.{name}")

"""Log output as text, logfmt or JSON lines, by Python's logging."""

from __future__ import annotations

import json
import logging
import sys
import time

LOGGER = "fluxmere"
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR, "off": logging.CRITICAL + 10}


class Formatter(logging.Formatter):
    """``extra={"fields": {...}}`` of a record is written beside its message."""

    def __init__(self, form: str):
        super().__init__()
        self.form = form

    def format(self, record: logging.LogRecord) -> str:
        stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created))
        fields = {"time": stamp, "level": record.levelname.lower(), "msg": record.getMessage(), **getattr(record, "fields", {})}
        if self.form == "json":
            return json.dumps(fields, default=str)
        if self.form == "logfmt":
            return " ".join(f"{k}={json.dumps(str(v)) if set(str(v)) & set(' =\"') else v}" for k, v in fields.items())
        more = "".join(f" {k}={v}" for k, v in getattr(record, "fields", {}).items())
        return f"[{stamp}] [{record.levelname}] {record.getMessage()}{more}"


def logger(level: str = "warn", form: str = "text", stream=None) -> logging.Logger:
    """The engine's logger, set to one level, form (text, logfmt, json) and stream."""
    if level not in LEVELS or form not in ("text", "logfmt", "json"):
        raise ValueError(f"unknown log level or form: {level}, {form}")
    out = logging.getLogger(LOGGER)
    out.setLevel(LEVELS[level])
    out.propagate = False
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(Formatter(form))
    out.handlers[:] = [handler]
    return out

"""Log destinations with a level each; handles can be removed."""

from __future__ import annotations

import logging
import sys
from typing import TextIO

LEVELS = {"TRACE": 5, "DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
logging.addLevelName(5, "TRACE")
_root = logging.getLogger("tideflow")
_root.setLevel(5)
_root.addHandler(logging.NullHandler())
_root.propagate = False


def _add(handler: logging.Handler, level: str) -> logging.Handler:
    handler.setLevel(LEVELS[level])
    handler.setFormatter(logging.Formatter("[%(asctime)s] [%(threadName)s] [%(levelname)s] %(message)s"))
    _root.addHandler(handler)
    return handler


def add_destination_stream(stream: TextIO = sys.stderr, level: str = "INFO") -> logging.Handler:
    return _add(logging.StreamHandler(stream), level)


def add_destination_text_file(path: str, level: str = "INFO") -> logging.Handler:
    return _add(logging.FileHandler(path), level)


def remove_destination(handle: logging.Handler) -> None:
    _root.removeHandler(handle)
    handle.close()


def log(level: str, message: str) -> None:
    _root.log(LEVELS[level], message)

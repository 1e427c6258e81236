"""Logging levels and scope timers."""

from __future__ import annotations

import logging
import time

LEVELS = {"trace": 5, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "err": logging.ERROR, "critical": logging.CRITICAL, "off": logging.CRITICAL + 1}


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"tomolith.{name}")


def set_level(level: str) -> None:
    logging.getLogger("tomolith").setLevel(LEVELS[level])


def add_file(path: str) -> None:
    logging.getLogger("tomolith").addHandler(logging.FileHandler(path))


class Timer:
    """Logs how long a scope took: ``with Timer("CGLS", "solve"): ...``"""

    def __init__(self, what: str, action: str):
        self.what, self.action, self.seconds = what, action, 0.0

    def __enter__(self) -> Timer:
        self._start = time.perf_counter()
        return self

    def __exit__(self, *exc: object) -> None:
        self.seconds = time.perf_counter() - self._start
        logger(self.what).log(LEVELS["debug"], "%s took %.3f s", self.action, self.seconds)

"""Settings, retries, remembered results, timing and logs of driver-side code.

Work on data is retried and cached by Spark; these serve what the driver does
itself: reading schema files, asking catalogs, writing reports.
"""

from __future__ import annotations

import functools
import hashlib
import logging
import logging.handlers
import os
import pickle
import random
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from schemaloom.functions.errors import StoreError

# ANSI codes of red, green, yellow, cyan and the end of a colour.
COLORS = ("\033[91m", "\033[92m", "\033[93m", "\033[96m", "\033[0m")
#: Status codes that pass by themselves.
TRANSIENT = (429, 500, 503)


@dataclass(frozen=True)
class Settings:
    """What the commands may vary."""

    infer_datetimes: bool = False
    color: bool = True
    show_presence: bool = True

    def colors(self) -> tuple[str, ...]:
        return COLORS if self.color else ("",) * len(COLORS)


def is_transient(error: BaseException) -> bool:
    """Too many requests, server errors and timeouts."""
    code = getattr(error, "code", None)
    return isinstance(error, TimeoutError) or code in TRANSIENT or any(f"{n} " in f"{error} " for n in TRANSIENT) or "timed out" in str(error).lower()


def retrying(attempts: int = 3, delay: float = 1.0, factor: float = 2.0, on: type[BaseException] | tuple = Exception, only: Callable[[BaseException], bool] | None = None, jitter: float = 0.0, sleep: Callable[[float], None] = time.sleep):
    """A decorator: call again on errors of the kinds `on` (and for which `only` holds), after a growing wait.

    jitter is the most by which a wait is lengthened at random, as a share of it.
    """

    def decorate(fn):
        @functools.wraps(fn)
        def call(*args, **kwargs):
            wait = delay
            for left in range(attempts - 1, -1, -1):
                try:
                    return fn(*args, **kwargs)
                except on as e:
                    if not left or only is not None and not only(e):
                        raise
                    sleep(wait * (1 + random.uniform(0, jitter)))
                    wait *= factor

        return call

    return decorate


def on_transient(fn):
    """Calls of a warehouse: up to five attempts, waits lengthened by up to a quarter."""
    return retrying(5, 1.0, 2.0, Exception, is_transient, 0.25)(fn)


def timed(fn):
    """Log how long a call takes."""

    @functools.wraps(fn)
    def call(*args, **kwargs):
        began = time.perf_counter()
        try:
            return fn(*args, **kwargs)
        finally:
            log("timing").info("%s took %.3f s", fn.__name__, time.perf_counter() - began)

    return call


def needs_file(fn):
    """The first argument must name a file that exists."""

    @functools.wraps(fn)
    def call(path, *args, **kwargs):
        if not Path(path).is_file():
            raise StoreError("no such file", path=path)
        return fn(path, *args, **kwargs)

    return call


class Memory:
    """Results by function and arguments, in memory and, with a folder, on disk.

    A file among the arguments counts with its size and time of change, so a
    changed file is read anew. Entries older than `seconds` count as missing.
    """

    def __init__(self, folder: str | None = None, seconds: float | None = None):
        self.folder, self.seconds, self.held = Path(folder) if folder else None, seconds, {}

    def key(self, name: str, args: tuple, kwargs: dict) -> str:
        parts = [name, repr(args), repr(sorted(kwargs.items()))]
        for x in [*args, *kwargs.values()]:
            if isinstance(x, str | os.PathLike) and len(str(x)) < 4096 and "\0" not in str(x) and Path(x).is_file():
                found = Path(x).stat()
                parts.append(f"{x}:{found.st_size}:{found.st_mtime_ns}")
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()

    def get(self, key: str):
        """(found, value)"""
        if key not in self.held and self.folder and (file := self.folder / key).is_file():
            with file.open("rb") as f:
                self.held[key] = pickle.load(f)  # written by this class, into a folder of its own
        made, value = self.held.get(key, (None, None))
        fresh = made is not None and (self.seconds is None or time.time() - made <= self.seconds)
        return fresh, value if fresh else None

    def put(self, key: str, value) -> None:
        self.held[key] = (time.time(), value)
        if self.folder:
            self.folder.mkdir(parents=True, exist_ok=True)
            part = self.folder / f"{key}.{os.getpid()}"
            with part.open("wb") as f:
                pickle.dump(self.held[key], f)
            part.replace(self.folder / key)

    def clear(self) -> None:
        self.held.clear()
        if self.folder and self.folder.is_dir():
            for file in self.folder.iterdir():
                file.unlink()

    def remember(self, fn):
        """A decorator."""

        @functools.wraps(fn)
        def call(*args, **kwargs):
            key = self.key(f"{fn.__module__}.{fn.__qualname__}", args, kwargs)
            found, value = self.get(key)
            if not found:
                value = fn(*args, **kwargs)
                self.put(key, value)
            return value

        return call


class _Colored(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        red, green, yellow, _, end = COLORS
        tint = red if record.levelno >= logging.ERROR else yellow if record.levelno >= logging.WARNING else green
        return f"{tint}{super().format(record)}{end}"


def log(name: str = "") -> logging.Logger:
    return logging.getLogger("schemaloom" + (f".{name}" if name else ""))


def set_up_logging(level: str = "WARNING", file: str | None = None, color: bool | None = None, most_bytes: int = 10 << 20, keep: int = 5) -> logging.Logger:
    """Log to standard error (coloured on a terminal) and, if named, to a file that is rotated."""
    top = log()
    for old in list(top.handlers):
        top.removeHandler(old)
        old.close()
    plain = "%(asctime)s %(name)s %(levelname)s %(message)s"
    stream = logging.StreamHandler(sys.stderr)
    tinted = sys.stderr.isatty() if color is None else color
    stream.setFormatter((_Colored if tinted else logging.Formatter)("%(levelname)s %(message)s"))
    top.addHandler(stream)
    if file:
        rotated = logging.handlers.RotatingFileHandler(file, maxBytes=most_bytes, backupCount=keep, encoding="utf-8")
        rotated.setFormatter(logging.Formatter(plain))
        top.addHandler(rotated)
    top.setLevel(level.upper())
    top.propagate = False
    return top

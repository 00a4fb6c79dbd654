"""Progress and cancellation of long actions, and the engine's own log."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from logging.handlers import RotatingFileHandler
from threading import Event, Thread

from pyspark.sql import SparkSession

#: Size and number of rotated log files.
LOG_BYTES, LOG_FILES = 10 * 1024 * 1024, 5


@contextmanager
def watched(spark: SparkSession, report: Callable[[int, int], None] | None = None, every: float = 0.5) -> Iterator[Callable[[], None]]:
    """Runs the actions of a with-block under a tag of their own, and yields what cancels them (nothing after the block).

    report gets the finished and all tasks of the stages that run just then, every so many seconds. A cancelled
    action raises in the thread that started it.
    """
    sc, tag, done = spark.sparkContext, f"emberwall-{uuid.uuid4().hex}", Event()
    sc.addJobTag(tag)

    def follow() -> None:
        status = sc.statusTracker()
        while not done.wait(every):
            stages = [s for k in status.getActiveStageIds() if (s := status.getStageInfo(k))]
            report(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))

    if report:
        Thread(target=follow, daemon=True).start()
    try:
        yield lambda: None if done.is_set() else sc.cancelJobsWithTag(tag)
    finally:
        done.set()
        sc.removeJobTag(tag)


def set_up_log(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The engine's logger, to the console and, if path is given, to a rotating file."""
    log = logging.getLogger("emberwall")
    log.setLevel(level)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers = [logging.StreamHandler()]
    if path:
        handlers.append(RotatingFileHandler(path, maxBytes=LOG_BYTES, backupCount=LOG_FILES, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log


def log_exception(error: BaseException, context: str = "") -> None:
    """Logs an error with its trace and, for this engine's own errors, its details."""
    details = getattr(error, "details", None)
    logging.getLogger("emberwall").error("%s%s%s", f"{context}: " if context else "", error, f" {details}" if details else "", exc_info=error)


def log_user_action(action: str, **details) -> None:
    shown = " ".join(f"{k}={v!r}" for k, v in details.items())
    logging.getLogger("emberwall").info("user action: %s %s", action, shown)


@contextmanager
def timed(what: str) -> Iterator[None]:
    """Logs how long a with-block took."""
    began = time.perf_counter()
    try:
        yield
    finally:
        logging.getLogger("emberwall").info("%s took %.3f s", what, time.perf_counter() - began)

import logging
from threading import Timer

import pytest

from emberwall.errors import SourceError
from emberwall.jobs import log_exception, log_user_action, set_up_log, timed, watched


def test_progress_and_cancel(spark):
    seen = []
    with watched(spark, lambda done, all_: seen.append((done, all_)), every=0.05) as cancel:
        for wait in (1, 3, 6):
            Timer(wait, cancel).start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(0, 10**12, 1, 4).selectExpr("sum(hash(id))").collect()
    assert any(a for _, a in seen)
    assert spark.range(3).count() == 3


def test_log(tmp_path):
    log = set_up_log(str(tmp_path / "x.log"))
    with timed("work"):
        log.warning("ü")
    assert "work took" in (tmp_path / "x.log").read_text(encoding="utf-8")
    set_up_log()
    assert log.level == logging.INFO


def test_errors_and_actions_are_logged(tmp_path):
    set_up_log(str(tmp_path / "y.log"))
    log_user_action("export", path="out.json")
    log_exception(SourceError("gone", path="x"), "reading")
    set_up_log()
    text = (tmp_path / "y.log").read_text(encoding="utf-8")
    assert "user action: export path='out.json'" in text and "reading: gone {'path': 'x'}" in text

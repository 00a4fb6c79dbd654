"""Rule descriptions from a rules dump: label "HASH" # description."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConnectionFailed
from ..functions.text import strip

#: Fixed value: how a dump marks a rule's hash and description.
LABEL = r'(?dm)label\s+"([^"]+)"\s*#\s*(.+?)(?:\n|$)'
#: Fixed value: where the firewall keeps the dump.
DUMP = "/tmp/rules.debug"
#: Fixed value: the menu's entry that opens a shell.
SHELL_ENTRY = "8"
#: How a menu or a shell waits for input.
PROMPT = r"[:#$%>] ?$"


def extract_labels(dumps: DataFrame, text: Column | str = "value") -> DataFrame:
    """(rid, description) from whole dumps; the last description of a hash wins."""
    text = F.col(text) if isinstance(text, str) else text
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(LABEL), F.lit(1)).alias("rid"), F.regexp_extract_all(text, F.lit(LABEL), F.lit(2)).alias("description"))
    rows = dumps.select(F.monotonically_increasing_id().alias("dump"), F.posexplode(pairs).alias("pos", "p"))
    rows = rows.select("p.rid", strip(F.col("p.description")).alias("description"), F.struct("dump", "pos").alias("ord"))
    return rows.groupBy("rid").agg(F.max_by("description", "ord").alias("description"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The labels of a dump that was saved to a file."""
    return extract_labels(spark.read.text(path, wholetext=True))


def fetch_rules(spark: SparkSession, host: str, user: str, password: str, **options) -> DataFrame:
    """The labels of a firewall's own dump, read over SSH; options are fetch_dump's."""
    return extract_labels(spark.createDataFrame([(fetch_dump(host, user, password, **options),)], "value string"))


def try_fetch_rules(spark: SparkSession, host: str, user: str, password: str, **options) -> tuple[bool, str, DataFrame | None]:
    """(True, message, labels), or (False, what went wrong, None); a timeout or a refused login still raises."""
    try:
        labels = fetch_rules(spark, host, user, password, **options)
    except ConnectionFailed as e:
        if e.details.get("reason") in ("timeout", "authentication"):
            raise
        return False, str(e), None
    return True, f"{labels.count()} rule labels from {host}", labels


def fetch_dump(host: str, user: str, password: str, *, port: int = 22, timeout: float = 10.0, accept_unknown: bool = False, menu: bool = False) -> str:
    """The text of the dump; needs paramiko.

    accept_unknown takes host keys that aren't known yet; else they are refused. menu is for accounts whose
    login shows the firewall's menu: its shell is opened first. Without it the command runs directly.
    """
    try:
        import paramiko
    except ImportError as e:
        raise ConnectionFailed("paramiko is not installed; save the dump to a file and use read_rules", reason="other") from e
    client = paramiko.SSHClient()
    client.load_system_host_keys()
    if accept_unknown:
        client.set_missing_host_key_policy(paramiko.AutoAddPolicy())
    try:
        client.connect(host, port=port, username=user, password=password, timeout=timeout)
        if menu:
            return _through_menu(client.invoke_shell(), timeout)
        _, out, _ = client.exec_command(f"cat {DUMP}", timeout=timeout)
        return out.read().decode("utf-8", "ignore")
    except Exception as e:
        reason = "timeout" if isinstance(e, TimeoutError) else "authentication" if isinstance(e, paramiko.AuthenticationException) else "other"
        raise ConnectionFailed(f"cannot read rules from {host}: {e}", host=host, port=port, reason=reason) from e
    finally:
        client.close()


def _through_menu(shell, timeout: float) -> str:
    """Opens the menu's shell and prints the dump between two marks, which no prompt can be taken for."""
    mark = uuid.uuid4().hex
    _read_until(shell, PROMPT, timeout)
    shell.send(f"{SHELL_ENTRY}\n")
    _read_until(shell, PROMPT, timeout)
    shell.send(f"echo {mark}; cat {DUMP}; echo {mark}\n")
    # The command's own echo has the mark too, but never alone on a line.
    return _read_until(shell, rf"(?ms)^{mark}\r?\n(.*?)^{mark}\r?$", timeout).replace("\r\n", "\n")


def _read_until(shell, pattern: str, timeout: float) -> str:
    """Reads until the pattern is found; its first group, or all that was read."""
    shell.settimeout(timeout)
    end, seen = time.monotonic() + timeout, b""
    while time.monotonic() < end:
        more = shell.recv(1 << 16)
        seen += more
        text = seen.decode("utf-8", "ignore")
        if found := re.search(pattern, text):
            return found[1] if found.re.groups else text
        if not more:
            raise ConnectionError("the connection was closed")
    raise TimeoutError("no answer in time")


def label_stats(labels: DataFrame) -> dict[str, int]:
    return {"total_labels": labels.count()}

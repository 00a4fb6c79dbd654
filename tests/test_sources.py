import sys
import types

import pytest

from emberwall.errors import ConnectionFailed
from emberwall.sources import rules, text


def test_head_and_tail_read_from_the_ends(spark, tmp_path, monkeypatch):
    data = b"".join(b"%d \xc3\xbc\xff%s" % (k, (b"\n", b"\r\n", b"\r")[k % 3]) for k in range(3000))
    (tmp_path / "a b.log").write_bytes(b"\xef\xbb\xbf" + data)
    (tmp_path / "b.log").write_bytes(b"x\n\nlast")
    want = [f"{k} ü" for k in range(3000)] + ["x", "", "last"]
    for step in (1, 7, 1 << 16):
        monkeypatch.setattr(text, "STEP_BYTES", step)
        assert text.read_tail(spark, str(tmp_path), 5) == want[-5:]
        assert text.read_tail(spark, str(tmp_path), 9999) == want
        got = text.read_lines(spark, str(tmp_path), max_lines=3002).orderBy("row_idx").collect()
        assert [r["value"] for r in got] == want[:3002]


@pytest.mark.parametrize("near", [0, 10_000])
def test_a_cap_reads_the_first_files(spark, tmp_path, monkeypatch, near):
    monkeypatch.setattr(text, "NEAR_LINES", near)
    for k in range(5):
        (tmp_path / f"{k}.log").write_text("".join(f"{k} {j}\n" for j in range(10)))
    lines = text.read_lines(spark, str(tmp_path), max_lines=15)
    rows = lines.orderBy("row_idx").collect()
    assert [r["value"] for r in rows] == [f"{j // 10} {j % 10}" for j in range(15)] and [r["row_idx"] for r in rows] == list(range(15))
    assert text.read_lines(spark, str(tmp_path), max_lines=99).count() == 50


def test_compressed_files(spark, tmp_path):
    import gzip

    (tmp_path / "z.log.gz").write_bytes(gzip.compress(b"".join(b"%d\n" % k for k in range(500))))
    assert text.read_tail(spark, str(tmp_path), 3) == ["497", "498", "499"]
    assert [r["value"] for r in text.read_lines(spark, str(tmp_path), max_lines=2).collect()] == ["0", "1"]


class Shell:
    """A menu, then a shell that echoes what is typed."""

    def __init__(self, dump):
        self.dump, self.out, self.sent = dump, ["0) Leave\r\n8) Shell\r\n", "Choice: "], []

    def settimeout(self, seconds):
        pass

    def send(self, line):
        self.sent.append(line)
        if line == "8\n":
            self.out += ["8\r\n", "admin@wall:~ # "]
        else:
            mark = line.split()[1].rstrip(";")
            self.out += [line.strip() + "\r\n", f"{mark}\r\n" + self.dump.replace("\n", "\r\n")[:30], self.dump.replace("\n", "\r\n")[30:] + mark, "\r\nadmin@wall:~ # "]

    def recv(self, size):
        if not self.out:
            raise TimeoutError("timed out")
        return self.out.pop(0).encode()


DUMP = 'pass in label "aa11" # Night shift\nblock label "bb22" # Gate 4: cameras #\n'


@pytest.fixture
def client(monkeypatch):
    class Client:
        error, policy, closed, dump = None, None, 0, DUMP

        def load_system_host_keys(self):
            pass

        def set_missing_host_key_policy(self, policy):
            Client.policy = policy

        def connect(self, host, **options):
            if Client.error:
                raise Client.error

        def invoke_shell(self):
            return Shell(Client.dump)

        def exec_command(self, command, timeout):
            return None, types.SimpleNamespace(read=lambda: Client.dump.encode()), None

        def close(self):
            Client.closed += 1

    fake = types.ModuleType("paramiko")
    fake.SSHClient, fake.AutoAddPolicy = Client, lambda: "add"
    fake.AuthenticationException = type("AuthenticationException", (Exception,), {})
    monkeypatch.setitem(sys.modules, "paramiko", fake)
    return Client


@pytest.mark.parametrize("menu", [False, True])
def test_rules_over_ssh(spark, client, menu):
    ok, message, labels = rules.try_fetch_rules(spark, "wall", "admin", "x", menu=menu)
    assert ok and message.startswith("2 ") and {r["rid"]: r["description"] for r in labels.collect()} == {"aa11": "Night shift", "bb22": "Gate 4: cameras #"}
    assert client.closed == 1 and client.policy is None
    assert rules.fetch_dump("wall", "admin", "x", menu=menu, accept_unknown=True) == DUMP and client.policy == "add"


def test_ssh_errors(spark, client):
    client.error = OSError("no route")
    assert rules.try_fetch_rules(spark, "wall", "admin", "x") == (False, "cannot read rules from wall: no route", None)
    for error, reason in ((TimeoutError("slow"), "timeout"), (sys.modules["paramiko"].AuthenticationException("no"), "authentication")):
        client.error = error
        with pytest.raises(ConnectionFailed) as e:
            rules.try_fetch_rules(spark, "wall", "admin", "x")
        assert e.value.details["reason"] == reason
    assert client.closed == 3


def test_without_paramiko(monkeypatch):
    monkeypatch.setitem(sys.modules, "paramiko", None)
    with pytest.raises(ConnectionFailed):
        rules.fetch_dump("wall", "admin", "x")

"""Models behind a program and a server, both started here."""

import json
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from foliospark.operators import models

ECHO = "import sys; t = sys.stdin.read(); print(t.upper())"


def run(code, prompt="hi", idle=5.0, hard=20.0):
    return models.program(lambda name: [sys.executable, "-c", code], hard)("structure", prompt, idle)


def test_a_program_answers():
    assert run(ECHO, "x" * 300_000) == "X" * 300_000
    assert run("print('no input read')", "y" * 300_000) == "no input read"
    with pytest.raises(RuntimeError, match="ended with 3: oops"):
        run("import sys; sys.stderr.write('oops'); sys.exit(3)")
    with pytest.raises(RuntimeError, match="empty answer"):
        run("pass")


def test_a_program_is_given_up():
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        run("import time; time.sleep(30)", idle=0.5)
    with pytest.raises(models.HardTimeout):
        run("import time\nwhile True: print(1, flush=True); time.sleep(0.05)", idle=2, hard=1)
    assert time.monotonic() - began < 15


class Answers(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(200)
        self.end_headers()
        say = lambda **k: self.wfile.write(json.dumps(k).encode() + b"\n")
        if asked["prompt"] == "wait":
            time.sleep(2)
        if asked["prompt"] == "fail":
            say(error="no such model")
        if asked["prompt"] == "on":
            try:
                for _ in range(100):
                    say(response="x")
                    self.wfile.flush()
                    time.sleep(0.05)
            except OSError:
                return
        say(response=f"{asked['model']}: ")
        self.wfile.write(b"\n")
        say(response=asked["prompt"], done=True)
        say(response="not read")

    def log_message(self, *_):
        pass


def test_a_server_answers():
    with HTTPServer(("127.0.0.1", 0), Answers) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{http.server_port}"
        ask = models.server(url, {"structure": "m"}, hard=10)
        assert ask("structure", "hello", 5) == "m: hello"
        with pytest.raises(TimeoutError):
            ask("structure", "wait", 0.3)
        with pytest.raises(RuntimeError, match="no such model"):
            ask("structure", "fail", 5)
        with pytest.raises(models.HardTimeout):
            models.server(url, {"structure": "m"}, hard=0.5)("structure", "on", 5)
        http.shutdown()
    with pytest.raises(RuntimeError, match="can't reach"):
        models.server("http://127.0.0.1:9", {"structure": "m"})("structure", "x", 1)

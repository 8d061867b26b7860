"""Models that passes.run() can ask: a program that reads a prompt and prints its answer, or a server that streams JSON lines.

Both give up when nothing has come for the seconds that the pass allows (a TimeoutError, after which the next attempt waits longer) and when
the whole answer takes more than `hard` seconds (HardTimeout). 0 stands for no limit. An empty answer is an error.
"""

from __future__ import annotations

import json
import os
import selectors
import subprocess
import time
from collections.abc import Callable, Iterable
from urllib import error, request

Model = Callable[[str, str, float], str]


class HardTimeout(Exception):
    """The answer as a whole took too long; waiting longer for its next piece wouldn't help."""


def _answer(pieces: Iterable[str], who: str) -> str:
    text = "".join(pieces).strip()
    if not text:
        raise RuntimeError(f"empty answer from {who}")
    return text


def _wait(began: float, idle: float, hard: float) -> float | None:
    """Seconds to wait for the next piece; None without a limit."""
    left = [idle] * (idle > 0) + [hard - (time.monotonic() - began)] * (hard > 0)
    return max(0.0, min(left)) if left else None


def _late(began: float, idle: float, hard: float) -> Exception:
    if hard > 0 and time.monotonic() - began >= hard:
        return HardTimeout(f"no whole answer after {hard} s")
    return TimeoutError(f"nothing came for {idle} s")


def _pieces(proc: subprocess.Popen, prompt: bytes, idle: float, hard: float) -> tuple[bytes, bytes]:
    """What a program prints to its two outputs; either counts as a sign of life."""
    began, out = time.monotonic(), {proc.stdout: [], proc.stderr: []}
    with selectors.DefaultSelector() as ready:
        for pipe in (proc.stdin, *out):
            os.set_blocking(pipe.fileno(), False)
            ready.register(pipe, selectors.EVENT_WRITE if pipe is proc.stdin else selectors.EVENT_READ)
        while ready.get_map():
            events = ready.select(_wait(began, idle, hard))
            if not events:
                raise _late(began, idle, hard)
            if hard > 0 and time.monotonic() - began >= hard:
                raise _late(began, idle, hard)
            for key, _ in events:
                pipe = key.fileobj
                if pipe is proc.stdin:
                    try:
                        prompt = prompt[os.write(pipe.fileno(), prompt[:65536]) :] if prompt else b""
                    except BrokenPipeError:
                        prompt = b""
                    if not prompt:
                        ready.unregister(pipe)
                        pipe.close()
                elif piece := os.read(pipe.fileno(), 65536):
                    out[pipe].append(piece)
                else:
                    ready.unregister(pipe)
    return b"".join(out[proc.stdout]), b"".join(out[proc.stderr])


def program(command: Callable[[str], list[str]], hard: float = 900) -> Model:
    """A model that is a program: command(pass) is what to run; the prompt goes to its input."""

    def ask(name: str, prompt: str, idle: float) -> str:
        with subprocess.Popen(command(name), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True) as proc:
            try:
                out, err = _pieces(proc, prompt.encode(), idle, hard)
            except BaseException:
                proc.kill()
                raise
            if proc.wait():
                raise RuntimeError(f"{command(name)[0]} ended with {proc.returncode}: {err.decode('utf-8', 'replace').strip()}")
        return _answer([out.decode("utf-8", "replace")], command(name)[0])

    return ask


def server(url: str, models: dict[str, str], hard: float = 900) -> Model:
    """A model behind HTTP: a POST of {model, prompt, stream} to url is answered by JSON lines with `response`, `error` and `done`. models: the model of each pass."""

    def lines(name: str, prompt: str, idle: float) -> Iterable[str]:
        began = time.monotonic()
        body = json.dumps({"model": models[name], "prompt": prompt, "stream": True}).encode()
        asked = request.Request(url, data=body, headers={"Content-Type": "application/json"}, method="POST")
        try:
            with request.urlopen(asked, timeout=_wait(began, idle, hard)) as answer:
                for line in answer:
                    if hard > 0 and time.monotonic() - began >= hard:
                        raise _late(began, idle, hard)
                    event = json.loads(line) if line.strip() else {}
                    if event.get("error"):
                        raise RuntimeError(f"{models[name]}: {event['error']}")
                    yield str(event.get("response") or "")
                    if event.get("done"):
                        return
        except TimeoutError as e:
            raise _late(began, idle, hard) from e
        except error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise _late(began, idle, hard) from e
            raise RuntimeError(f"can't reach {url}: {e}") from e

    return lambda name, prompt, idle: _answer(lines(name, prompt, idle), models[name])

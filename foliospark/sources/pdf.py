"""PDF by the programs that a machine may have: pdftotext, pdfinfo and ocrmypdf, all of them through pipes, without files.

Give text and ocr to containers.extracted() on a cluster whose executors have these programs.
"""

from __future__ import annotations

import shutil
import subprocess


def _run(command: list[str], content: bytes) -> bytes:
    if not shutil.which(command[0]):
        raise RuntimeError(f"{command[0]} is not installed")
    done = subprocess.run(command, input=content, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{command[0]}: {(done.stderr or done.stdout).decode('utf-8', 'replace').strip()}")
    return done.stdout


def text(content: bytes) -> str:
    """The text of a PDF in its layout."""
    return _run(["pdftotext", "-layout", "-", "-"], content).decode("utf-8", "replace")


def ocr(content: bytes) -> bytes:
    """The PDF with a text layer on pages that have none."""
    return _run(["ocrmypdf", "--skip-text", "-", "-"], content)


def pages_in(info: str) -> int | None:
    """The number on the first line `Pages:` of what pdfinfo prints."""
    for line in info.splitlines():
        name, _, value = line.partition(":")
        if name.lower() == "pages":
            return int(value) if value.strip().isdigit() else None
    return None


def page_count(content: bytes) -> int | None:
    """How many pages a PDF has; null if that can't be told."""
    try:
        return pages_in(_run(["pdfinfo", "-"], content).decode("utf-8", "replace"))
    except RuntimeError:
        return None

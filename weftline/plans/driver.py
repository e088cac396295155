"""What a run does on the driver, beside its plans: files fetched once, arguments, probes, steps and conversations."""

from __future__ import annotations

import shutil
import sys
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame


def fetch_once(url: str, path: str, force: bool = False) -> str:
    """Downloads a raw file unless it is there already; a broken download leaves nothing behind under its name."""
    target = Path(path)
    if force or not target.exists() or not target.stat().st_size:
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")
        with urllib.request.urlopen(url) as source, part.open("wb") as out:
            shutil.copyfileobj(source, out)
        part.replace(target)
    return str(target)


def text_argument(text: str | None = None, file: str | None = None, stdin: TextIO | None = None) -> str:
    """The text given, or a file's, or what standard input holds; stripped, and an error if empty."""
    found = text if text is not None else Path(file).read_text(encoding="utf-8") if file else (stdin or sys.stdin).read()
    if not found.strip():
        raise ValueError("no text given")
    return found.strip()


def probe(readers: Mapping[str, Callable[[], DataFrame]], rows: int = 2) -> dict[str, tuple[bool, str]]:
    """Whether each reader gives a few rows; its columns, or what went wrong."""
    out = {}
    for name, read in readers.items():
        try:
            df = read()
            n = len(df.limit(rows).collect())
            out[name] = (n > 0, ", ".join(df.columns) if n else "no rows")
        except Exception as error:
            out[name] = (False, str(error).split("\n")[0])
    return out


def run_steps(steps: Sequence[tuple[str, Callable[[], object]]], skip: Sequence[str] = ()) -> dict[str, object]:
    """Runs named steps in turn but for those to skip; an error ends the run and names its step."""
    out = {}
    for name, step in steps:
        if name not in skip:
            try:
                out[name] = step()
            except Exception as error:
                raise RuntimeError(f"step {name} failed") from error
    return out


def chat(ask: Callable[[list[dict]], str], read: Callable[[], str | None], write: Callable[[str], None], system: str | None = None, prompt: Callable[[str], str] | None = None, ends: Sequence[str] = ("/exit", "/quit"), forget: str = "/reset") -> list[dict]:
    """A conversation: lines are asked in turn with all before them, or each by itself as prompt(line) where that is given. Returns the history."""
    start = [{"role": "system", "content": system}] if system else []
    history = list(start)
    while (line := read()) is not None and line.strip() not in ends:
        if line.strip() == forget:
            history = list(start)
        elif line.strip():
            asked = {"role": "user", "content": prompt(line.strip()) if prompt else line.strip()}
            answer = ask([*start, asked] if prompt else [*history, asked])
            history += [asked, {"role": "assistant", "content": answer}]
            write(answer)
    return history

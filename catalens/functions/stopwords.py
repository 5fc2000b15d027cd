"""The stop-word list is a parameter; the default, a fixed list of 318 words in natural order, is the file beside this one."""

from __future__ import annotations

from pathlib import Path

DEFAULT_SOURCE = Path(__file__).with_name("stop_words.txt")


def load_stop_words(path: str | Path = DEFAULT_SOURCE) -> list[str]:
    """Words of a plain list file, separated by white space."""
    return sorted(Path(path).read_text(encoding="utf-8").split())

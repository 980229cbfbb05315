"""Whole-file writes on the driver's file system."""

from __future__ import annotations

import os
import tempfile
from contextlib import suppress
from pathlib import Path


def write_text(path: Path, text: str) -> None:
    """Write ``path`` as a whole or not at all: a synced temporary file beside it is renamed over it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        with suppress(FileNotFoundError):
            os.unlink(temporary)
        raise

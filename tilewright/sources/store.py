"""Files of shared storage as Python tasks see them: any file system that pyarrow opens by its address."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyarrow import fs

#: Fixed values of uploads: 5 tries, waits of 2 ** n seconds up to 20.
TRIES, MOST_WAIT = 5, 20.0


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of an address; one without a scheme is a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def exists(at: fs.FileSystem, path: str) -> bool:
    return at.get_file_info(path).type != fs.FileType.NotFound


def size_of(at: fs.FileSystem, path: str) -> int | None:
    """Bytes of a file, None if there is none."""
    info = at.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def retried(f: Callable, wait: float = 1.0, tries: int = TRIES):
    """(result, tries used) of ``f``, called again after an OSError, ``tries`` times in all.

    Waits double, with a little jitter so that tasks do not come back at once; ``wait`` scales them.
    """
    for n in range(1, tries + 1):
        try:
            return f(), n
        except OSError:
            if n == tries:
                raise
            time.sleep(wait * min(2.0**n, MOST_WAIT) * random.uniform(0.9, 1.0))


def put(at: fs.FileSystem, path: str, data: bytes) -> None:
    """Write whole files only: under a temporary name beside it, then renamed over what may be there."""
    folder, _, name = path.rpartition("/")
    at.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with at.open_output_stream(temporary) as out:
        out.write(data)
    at.move(temporary, path)

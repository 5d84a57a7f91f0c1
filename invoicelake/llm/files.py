"""Binary files that tasks write into the shared folder."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow.fs
from pyspark import TaskContext


def write_file(folder: str, name: str, parts: Iterable[bytes]) -> None:
    """Writes a file whole or not at all: under a name of this attempt first, then moved to its own.

    A task that is run again writes the same bytes under the same name, so lost executors leave no half files.
    """
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    hidden = f"{path}/_{name}.{attempt}"
    with system.open_output_stream(hidden) as out:
        for part in parts:
            out.write(part)
    system.move(hidden, f"{path}/{name}")


def with_scheme(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder}"

"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; Spark writes local ones as file:/path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def whole_file(folder: str, name: str) -> Iterator[object]:
    """Stream to a file that gets its name only when it is complete.

    A task that is run again, here or elsewhere, writes the same bytes and replaces the file.
    """
    files, base = store(folder)
    files.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        yield out
    files.move(part, f"{base}/{name}")

"""Files that tasks write to and read from a shared folder by themselves."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; Spark writes local ones as file:/path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def add_lines(folder: str, rows: list[dict]) -> None:
    """One more file of JSON lines; it gets its name only when it is complete."""
    files, base = store(folder)
    files.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with files.open_output_stream(f"{base}/.{name}") as out:
        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    files.move(f"{base}/.{name}", f"{base}/{name}.jsonl")


def read_lines(folder: str) -> Iterator[dict]:
    """Rows of all complete files of a folder; none if there is no such folder."""
    files, base = store(folder)
    for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.extension == "jsonl" and not info.base_name.startswith("."):
            with files.open_input_stream(info.path) as stream:
                yield from map(json.loads, stream.readall().decode().splitlines())

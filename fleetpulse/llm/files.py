"""Files that tasks write to and read from the shared folder, whatever store it lies in."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("file:/", "file:///", 1) if path.startswith(("s3a:", "file:/")) and not path.startswith("file://") else path)


@contextmanager
def written(path: str) -> Iterator:
    """A stream to a new file that gets its name only when it is complete, so that a lost attempt leaves no half file."""
    fs, inner = store(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    draft = f"{inner}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        yield out
    fs.move(draft, inner)


def opened(path: str):
    """A seekable stream of a file."""
    fs, inner = store(path)
    return fs.open_input_file(inner)


def removed(path: str) -> None:
    """Deletes a folder that nothing reads any longer."""
    fs, inner = store(path)
    if fs.get_file_info(inner).type != pafs.FileType.NotFound:
        fs.delete_dir(inner)

"""Binary files in the shared folder, from inside tasks: any store that Arrow opens by URI."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def _filesystem(uri: str):
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def open_stream(uri: str):
    """A file read once, front to back."""
    store, path = _filesystem(uri)
    return store.open_input_stream(path, compression=None)


def open_file(uri: str):
    """A file read at any offset."""
    store, path = _filesystem(uri)
    return store.open_input_file(path)


@contextmanager
def written_whole(uri: str):
    """A new file that appears under its name only when complete, so that lost or repeated tasks do no harm."""
    store, path = _filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(part, compression=None) as out:
        yield out
    store.move(part, path)

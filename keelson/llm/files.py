"""Whole files in the shared folder, written and read by executors."""

from __future__ import annotations

import uuid

#: Hadoop's names of stores that pyarrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasbs": "abfss"}


def _filesystem(path: str):
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}")


def put(path: str, data: bytes) -> None:
    """Write a file of the shared folder under a name of its own, then give it its name."""
    store, name = _filesystem(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    temporary = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, name)


def get(path: str) -> bytes:
    store, name = _filesystem(path)
    with store.open_input_stream(name) as f:
        return f.read()

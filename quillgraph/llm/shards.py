"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Shard:
    """One attempt's file, of a name that no other attempt has: rows name the file whose offsets they hold, so whichever attempt's
    rows are committed, its file stands. What other attempts leave goes with the folder."""

    def __init__(self, folder: str, number: int, attempt: int):
        self.name = f"shard-{number:06d}-{attempt}-{uuid.uuid4().hex[:8]}.bin"
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.size = 0
        self.out = self.fs.open_output_stream(f"{path}/{self.name}")

    def write(self, data: bytes) -> int:
        """Where data begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


class Reader:
    """Byte ranges of the files of a folder; the last file stays open."""

    def __init__(self, folder: str):
        self.fs, self.folder = filesystem(folder)
        self.name, self.file = None, None

    def read(self, name: str, at: int, n: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.folder}/{name}")
        return self.file.read_at(n, at)

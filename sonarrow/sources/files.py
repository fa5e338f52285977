"""Files of any store that Arrow opens (local and shared folders, hdfs, s3, gs), read at given places."""

from __future__ import annotations

import pyarrow.fs as pafs

#: Bytes that are fetched at once while headers are read.
BLOCK = 1 << 20


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files under a folder that end in `suffix`, by path; hidden ones are left out."""
    fs, inner = store(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))


class Places:
    """A file opened for reading at places, a block at a time."""

    def __init__(self, path: str):
        fs, inner = store(path)
        self.file = fs.open_input_file(inner)
        self.size, self.at, self.begin, self.block = self.file.size(), 0, 0, b""

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        if n > BLOCK:
            self.file.seek(self.at)
            out = self.file.read(n)
        else:
            if not self.begin <= self.at <= self.at + n <= self.begin + len(self.block):
                self.file.seek(self.at)
                self.begin, self.block = self.at, self.file.read(BLOCK)
            out = self.block[self.at - self.begin : self.at - self.begin + n]
        self.at += len(out)
        return out

    def close(self) -> None:
        self.file.close()

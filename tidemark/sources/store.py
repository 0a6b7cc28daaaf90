"""Files on any file system that pyarrow opens: local paths, and hdfs://, s3:// or gs:// addresses.

What is read and written is counted by process in IO, and failures of the system become LogErrors.
"""

from __future__ import annotations

import ctypes
import errno
import os
import time
import uuid
from collections import Counter
from contextlib import contextmanager, suppress

from pyarrow import fs

IO: Counter = Counter()
FEW = 8  # files that are forced out one by one
SYNCFS = getattr(ctypes.CDLL(None, use_errno=True), "syncfs", None)


class LogError(Exception):
    """A log that can't be read or written; ``reason`` is one word."""

    def __init__(self, reason: str, what: str = ""):
        super().__init__(f"{reason}: {what}" if what else reason)
        self.reason, self.what = reason, what

    def __reduce__(self):
        return type(self), (self.reason, self.what)


class Conflict(LogError):
    """Rows that lie below a log's end, or a second writer."""


def of_system(e: OSError) -> LogError:
    """The kind of a failure of the file system."""
    known = {errno.ENOENT: "DeviceGone", errno.ENODEV: "DeviceGone", errno.ENOSPC: "OutOfSpace", errno.EDQUOT: "OutOfSpace", errno.EACCES: "Denied", errno.EROFS: "Denied"}
    return LogError(known.get(e.errno, "Io"), str(e))


class Store:
    def __init__(self, root: str):
        if root.startswith("file:"):
            root = "/" + root[5:].lstrip("/")
        if "://" in root:
            self.fs, self.root = fs.FileSystem.from_uri(root)
        else:
            self.fs, self.root = fs.LocalFileSystem(), os.path.abspath(root)
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def at(self, *parts: str) -> str:
        return "/".join((self.root.rstrip("/"), *parts))

    def entries(self, path: str) -> list[tuple[str, int | None]]:
        """(name, size) of what lies in a folder, in order; size is None for a folder. A missing folder has nothing."""
        IO["lists"] += 1
        found = self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((x.base_name, None if x.type == fs.FileType.Directory else x.size) for x in found)

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != fs.FileType.NotFound

    def read(self, path: str, begin: int = 0, end: int | None = None) -> bytes:
        """The bytes [begin, end) of a file; none of a missing one."""
        try:
            with self.fs.open_input_file(path) as f:
                to = f.size() if end is None else min(end, f.size())
                out = f.read_at(max(0, to - begin), begin) if begin < to else b""
        except FileNotFoundError:
            return b""
        except OSError as e:
            raise of_system(e) from e
        IO["reads"] += 1
        IO["bytes_read"] += len(out)
        return out

    @contextmanager
    def create(self, path: str, forced: bool = True):
        """A new file to write to; on a local disk it is forced out when it is closed, unless the caller does so with force()."""
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        try:
            if self.local:
                with open(path, "wb") as f:
                    yield f
                    if forced:
                        f.flush()
                        os.fsync(f.fileno())
                        IO["syncs"] += 1
            else:
                with self.fs.open_output_stream(path) as f:
                    yield f
        except OSError as e:
            raise of_system(e) from e
        IO["writes"] += 1

    def force(self, paths: list[str]) -> None:
        """Force files out that create() has left to the caller; many of them by one call for their file system."""
        if not self.local or not paths:
            return
        many = len(paths) > FEW and SYNCFS is not None
        try:
            for path in [os.path.dirname(paths[0])] if many else paths:
                fd = os.open(path, os.O_RDONLY)
                try:
                    if not many:
                        os.fsync(fd)
                    elif SYNCFS(fd):
                        raise OSError(ctypes.get_errno(), "syncfs", path)
                finally:
                    os.close(fd)
                IO["syncs"] += 1
        except OSError as e:
            raise of_system(e) from e

    def put(self, path: str, data: bytes) -> None:
        """A whole small file, replaced in one step."""
        new = f"{path}.{uuid.uuid4().hex}"
        with self.create(new) as f:
            f.write(data)
        IO["bytes_written"] += len(data)
        self.fs.move(new, path)

    def move(self, old: str, new: str) -> None:
        try:
            self.fs.move(old, new)
        except OSError:  # the folder may be missing
            self.fs.create_dir(os.path.dirname(new), recursive=True)
            self.fs.move(old, new)

    def remove(self, path: str) -> None:
        if self.local:
            with suppress(FileNotFoundError):
                os.remove(path)
        elif self.exists(path):
            self.fs.delete_file(path)

    def remove_tree(self, path: str) -> None:
        if self.exists(path):
            self.fs.delete_dir(path)

    @contextmanager
    def lock(self, path: str, seconds: float):
        """Keeps a second writer off while it is held. A lock older than ``seconds`` was left by a writer that is gone.

        Object stores can't create a file only if it is missing: there one writer at a time is up to the caller.
        """
        if not self.local:
            yield
            return
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            if time.time() - os.path.getmtime(path) > seconds:
                os.remove(path)
        except FileNotFoundError:
            pass
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            raise Conflict("Locked", path) from None
        try:
            yield
        finally:
            os.remove(path)

"""Files that tasks write and the driver publishes, so that failed, repeated and speculative attempts leave nothing behind.

Each attempt writes into a folder of its own under `.staging-<job>` beside the files. The driver publishes what the attempts that Spark
accepted have named, never over an existing file, takes all of them back if one is in the way, and sweeps the staging folder.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage


class OutputExists(FileExistsError):
    pass


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (name, place in the staging folder or None where nothing was written, what to tell of it)."""

    files: list[tuple[str, str | None, dict]] = field(default_factory=list)


class StagedWriter(DataSourceWriter):
    """Options: path, and manifest (a file that gets one JSON line for each file of the job). Subclasses write rows by `open` and `told`."""

    def __init__(self, options: dict):
        self.folder, self.manifest = options["path"].rstrip("/"), options.get("manifest")
        self.job = uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.folder}/.staging-{self.job}"

    def attempt(self) -> str:
        """A new folder for the attempt that calls."""
        path = f"{self.staging}/{uuid.uuid4().hex}"
        store, root = resolve(path)
        store.create_dir(root)
        return path

    def commit(self, messages: list[Written | None]) -> None:
        found = sorted((name, staged, told) for m in messages if m for name, staged, told in m.files)
        store, root = resolve(self.folder)
        done: list[str] = []
        try:
            for name, staged, _ in found:
                if staged:
                    final = f"{root}/{name}"
                    store.create_dir(os.path.dirname(final))
                    publish(store, resolve(staged)[1], final)
                    done.append(final)
            if self.manifest:
                store, path = resolve(self.manifest)
                store.create_dir(os.path.dirname(path))
                with store.open_output_stream(path) as out:
                    out.write("".join(json.dumps(told) + "\n" for _, _, told in found).encode())
        except BaseException:
            for final in done:
                resolve(self.folder)[0].delete_file(final)
            raise
        finally:
            self.sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self.sweep()

    def sweep(self) -> None:
        store, root = resolve(self.staging)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def publish(store: fs.FileSystem, staged: str, final: str) -> None:
    """Moves a staged file to its name unless that is taken. On a local disk a hard link decides, which only one writer can make; other
    stores are looked at first, as pyarrow has no move there that refuses."""
    if isinstance(store, fs.LocalFileSystem):
        try:
            os.link(staged, final)
        except FileExistsError as e:
            raise OutputExists(f"output exists: {final}") from e
        return
    if store.get_file_info(final).type != fs.FileType.NotFound:
        raise OutputExists(f"output exists: {final}")
    store.move(staged, final)

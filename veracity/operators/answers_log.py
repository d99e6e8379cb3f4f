"""Answers that outlive the task that asked for them.

A model call is paid for when it is made, so what is answered must not be asked
again because a task was lost.  Each task writes its answered batches, as they
come, under the stage's folder, in a folder for each partition of the
requests and under names that no other attempt uses: where files can be added to, to one file, else a file for each batch.  A task begins by reading its partition's
folder: requests found there, with the text they had, are returned from it and not sent.  Requests are dealt to partitions by
their keys, so a later attempt, or a later run over the same folder, meets the same requests.

A batch's own file appears whole under its final name: it is written under another one and renamed.  A file that is added to
gets a batch by one write; one that was cut off in its last batch is read up to there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    if not rest:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _whole_batches(f: pa.NativeFile) -> list[pa.Table]:
    """The batches of a stream that may be cut off."""
    batches = []
    try:
        for batch in pa.ipc.open_stream(f):
            batches.append(batch)
    except (pa.ArrowInvalid, OSError):
        pass
    return [pa.Table.from_batches(batches)] if batches else []


class AnswerLog:
    """The answered batches of one stage, under a folder all executors share."""

    def __init__(self, uri: str, partitions: int):
        self.uri, self.partitions = uri.rstrip("/"), partitions

    def _folder(self, partition: int) -> tuple[fs.FileSystem, str]:
        system, path = _system(self.uri)
        return system, f"{path}/of={self.partitions}/part={partition}"

    def answered(self, partition: int) -> list[pa.Table]:
        """The batches that any attempt at this partition has had answered."""
        system, folder = self._folder(partition)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted(f.path for f in found if f.base_name.endswith((".parquet", ".arrows")))
        tables = []
        for name in names:
            with system.open_input_file(name) as f:
                tables += [pq.read_table(f)] if name.endswith(".parquet") else _whole_batches(f)
        return tables

    @contextmanager
    def writer(self, partition: int) -> Iterator[Callable[[pa.Table], None]]:
        """What an attempt at a partition adds its answered batches with."""
        system, folder = self._folder(partition)
        if not isinstance(system, fs.LocalFileSystem):
            yield lambda answers: self.add(partition, answers)
            return
        out = None

        def add(answers: pa.Table) -> None:
            nonlocal out
            rows = b"".join(b.serialize() for b in answers.combine_chunks().to_batches())
            if out is None:
                system.create_dir(folder, recursive=True)
                out = open(f"{folder}/{uuid.uuid4().hex}.arrows", "wb", buffering=0)
                rows = answers.schema.serialize().to_pybytes() + rows
            out.write(rows)

        try:
            yield add
        finally:
            if out is not None:
                out.close()

    def add(self, partition: int, answers: pa.Table) -> None:
        system, folder = self._folder(partition)
        system.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{folder}/{name}.tmp") as out:
            pq.write_table(answers, out)
        system.move(f"{folder}/{name}.tmp", f"{folder}/{name}.parquet")

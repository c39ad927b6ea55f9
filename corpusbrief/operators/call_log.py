"""A content-addressed log of paid calls, read before a call is made.

A call is named by the SHA-256 of (model, length, text).  Its digest is one small file in the shared folder, written under
another name and moved into place, so a reader finds a whole one or none.  A task that is tried again, or a run that
is started again, finds the calls of the attempt before and makes the others only; equal texts are called once.  A
look and a write per call cost milliseconds, a call seconds.  Failed calls are not logged.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict


class LoggedSummarizer:
    """``summarizer`` behind the log in ``folder`` (a path or URI that the tasks can write)."""

    def __init__(self, summarizer: Callable, folder: str, name: str):
        from pyarrow import fs

        from ..sources.listing import _file_system

        self.summarizer, self.name = summarizer, name
        self.system, self.folder, _ = _file_system(folder.rstrip("/"))
        self.missing = fs.FileType.NotFound

    def path(self, text: str, length: str | None) -> str:
        key = hashlib.sha256(json.dumps([self.name, length, text]).encode()).hexdigest()
        return f"{self.folder}/{key[:2]}/{key}"

    def __call__(self, text: str, length: str | None = None):
        from .stages import Digest

        path = self.path(text, length)
        if self.system.get_file_info(path).type != self.missing:
            with self.system.open_input_stream(path) as f:
                return Digest(**json.loads(f.read()))
        digest = self.summarizer(text, length)
        own = f"{path}.{uuid.uuid4().hex}"
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.system.open_output_stream(own) as f:
            f.write(json.dumps(asdict(digest)).encode())
        self.system.move(own, path)
        return digest


def logged(factory: Callable[[], Callable], folder: str, name: str) -> Callable[[], Callable]:
    """A factory like ``factory`` whose summarisers ask the log first; ``name`` tells models and prompts apart."""
    return lambda: LoggedSummarizer(factory(), folder, name)

"""Places of files that Python tasks read and write: local paths and the addresses that pyarrow's file systems know."""

from __future__ import annotations

import re

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an absolute path or address; Hadoop's file:/x is taken for file:///x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path).rstrip("/"))

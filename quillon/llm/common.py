"""What several operators share: words, file systems, keyed lookups without hot tasks and connected components."""

from __future__ import annotations

from pyarrow import fs

from quillon.operators.graph import components, salted_left_join  # noqa: F401

#: Java form of the white space that every text contract uses: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")

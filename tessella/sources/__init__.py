"""Reading and writing tables."""

from tessella.sources.files import FILE_KINDS, file_kind, read_file, read_folder, read_rows
from tessella.sources.sinks import write

__all__ = ["FILE_KINDS", "file_kind", "read_file", "read_folder", "read_rows", "write"]

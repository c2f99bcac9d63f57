"""Options of one crawl job."""

from __future__ import annotations

from dataclasses import dataclass

from docsnap.functions.paths import clean_root

ID_MODES = ("path", "path_hash", "content")


@dataclass(frozen=True)
class CrawlOptions:
    """What to list, how to build documents and where they go.

    ``indexed_chars <= 0`` stores the whole text. ``ignore_above`` is in bytes and keeps
    files of exactly that size. ``read_partitions`` fixes the number of tasks that open
    files; unset, it follows from their number and size.
    """

    root: str
    name: str = "job"
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    ignore_above: int | None = None
    follow_symlinks: bool = False
    remove_deleted: bool = True
    continue_on_error: bool = False
    index_folders: bool = True
    prune_folders: bool = False
    index_content: bool = True
    indexed_chars: int = -1
    store_source: bool = False
    checksum: str | None = None
    id_mode: str = "path"
    retry_failed: bool = True
    index: str = ""
    folder_index: str = ""
    bulk_size: int = 100
    byte_size: int = 10 * 1024 * 1024
    read_partitions: int | None = None

    def __post_init__(self) -> None:
        if self.id_mode not in ID_MODES:
            raise ValueError(f"id_mode must be one of {ID_MODES}, not {self.id_mode!r}")
        object.__setattr__(self, "includes", tuple(self.includes))
        object.__setattr__(self, "excludes", tuple(self.excludes))
        if not self.index:
            object.__setattr__(self, "index", f"{self.name}_docs")
        if not self.folder_index:
            object.__setattr__(self, "folder_index", f"{self.name}_folder")

    @property
    def job(self) -> str:
        """What a snapshot belongs to: the name of the job and the root."""
        return f"{self.name}:{clean_root(self.root)}"

    @property
    def needs_bytes(self) -> bool:
        """Whether the built document depends on the raw bytes, not only on the text."""
        return bool(self.checksum) or self.store_source or self.id_mode == "content"

"""Errors of the engine, raised on the driver while a plan is made."""

from __future__ import annotations


def _preview(items: list) -> str:
    return ", ".join(map(repr, items[:5])) + (f" and {len(items) - 5} more" if len(items) > 5 else "")


class MissingKeyError(Exception):
    """A dataset lacks a column that was asked for."""


class ShapeMismatchError(Exception):
    """Data and labels differ in length."""


class SampleMetaLengthMismatchError(Exception):
    def __init__(self, ids: int, meta: int) -> None:
        super().__init__(f"{ids} sample ids but {meta} metadata rows")
        self.ids, self.meta = ids, meta


class NumSamplesMismatchError(Exception):
    def __init__(self, header: int, actual: int) -> None:
        super().__init__(f"the header counts {header} samples, the data has {actual}")
        self.header, self.actual = header, actual


class BatchProcessItemError(Exception):
    """Returned, not raised: a source item that could not be loaded, and why."""

    def __init__(self, path: str, cause: str) -> None:
        super().__init__(path, cause)
        self.path, self.cause = path, cause


class SampleMetaPairingError(ValueError):
    """Exactly one of sample ids and metadata was given."""


class SampleMetaStoreUnavailableError(RuntimeError):
    """Ids or metadata were asked for without a decoder."""


class ConflictingSelectorsError(ValueError):
    """Both indices and ids were given."""


class _ListedError(ValueError):
    what = ""

    def __init__(self, items: list) -> None:
        super().__init__(f"{self.what}: {_preview(items)}")
        self.items = list(items)


class UnknownSampleIdsError(_ListedError):
    what = "unknown sample ids"


class DuplicateSampleIdsError(_ListedError):
    what = "repeated sample ids"


class DuplicateSelectIndicesError(_ListedError):
    what = "repeated indices"


class SampleCountMismatchError(RuntimeError):
    """Rows written differ from rows planned."""


class SampleSequenceLengthMismatchError(ValueError):
    def __init__(self, name: str, expected: int, actual: int) -> None:
        super().__init__(f"{name} has {actual} entries, expected {expected}")
        self.name, self.expected, self.actual = name, expected, actual


class CorruptedFileError(Exception):
    """A record file is damaged."""


class ImageTooSmallError(ValueError):
    def __init__(self, size: tuple[int, int], target: tuple[int, int]) -> None:
        super().__init__(f"an image of {size} is smaller than {target}")
        self.size, self.target = tuple(size), tuple(target)

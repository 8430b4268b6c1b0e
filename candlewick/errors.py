"""Errors of this library; all derive from one base."""


class CandlewickError(Exception):
    pass


class UnsupportedFileTypeError(CandlewickError):
    """A file is of no type that a reader is registered for."""


class EmptyDocumentError(CandlewickError):
    """No text could be read from a file, or from any of the given files."""


class UnreadableFileError(CandlewickError):
    """A file can't be opened as what its name says. Files like it count as empty."""


class IndexNotBuiltError(CandlewickError):
    """A search or save came before the index was built or loaded."""


class EmptyIndexError(CandlewickError):
    """An index can't be built from no chunks."""


class EmbeddingError(CandlewickError):
    """An embedding model failed to load or to encode."""

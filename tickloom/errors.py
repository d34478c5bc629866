"""What can go wrong, by stage. Errors inside a job surface as Spark exceptions that carry these messages."""


class EngineError(Exception):
    """Any error of this library."""


class TickError(EngineError, ValueError):
    """A tick that is not a positive decimal, or a price that is no plain decimal."""


class IngestError(EngineError, ValueError):
    """Input that an ingest cannot take."""


class StorageError(EngineError):
    """A log or index file that is malformed."""


class ChecksumError(StorageError):
    """A record whose checksum differs; offset is where it starts."""

    def __init__(self, offset: int):
        super().__init__(f"checksum mismatch at offset {offset}")
        self.offset = offset


class ReplayError(EngineError):
    """A replay that is asked for something impossible."""


class NonDeterministic(EngineError):
    """Two runs of one query gave different bytes."""

"""What the store raises."""


class StoreError(Exception):
    """Base of all errors of the store."""


class NotFound(StoreError):
    """A file or a chunk is missing."""


class AlreadyExists(StoreError):
    """A file must not be replaced."""


class PermissionDenied(StoreError):
    """A read-only handle cannot write."""


class InvalidInput(StoreError):
    """An argument or the state does not allow the operation."""

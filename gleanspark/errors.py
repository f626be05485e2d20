"""Errors of the public API."""


class IndexNotFoundError(LookupError):
    """Asked for an index that the controller doesn't hold."""

    def __init__(self, kind: str):
        super().__init__(f"Index({kind}) not set")
        self.kind = kind

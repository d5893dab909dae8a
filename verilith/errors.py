"""Errors of misuse; findings about data come back as rows instead."""


class EvidenceError(ValueError):
    """Has the class name of the error in ``kind``."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind

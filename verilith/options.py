"""Options with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

from verilith.errors import EvidenceError


@dataclass(frozen=True)
class ChunkOptions:
    target: int = 4 << 20
    maximum: int = 16 << 20

    def __post_init__(self):
        if not 0 < self.target <= self.maximum:
            raise EvidenceError("invalid_chunk_options", f"0 < {self.target} <= {self.maximum} doesn't hold")


@dataclass(frozen=True)
class SearchOptions:
    """Budgets; a search that meets one stops there and says so."""

    max_candidates: int = 10_000
    max_decoded_bytes: int = 256 << 20
    max_results: int | None = None


#: Share of granules, per million, from which on a term is called frequent.
HIGH_DF = 200_000


def byte_limit(text: str) -> int:
    """``64``, ``64KiB``, ``2MiB`` or ``1GiB`` as bytes."""
    for suffix, factor in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30)):
        if text.endswith(suffix):
            return int(text.removesuffix(suffix)) * factor
    return int(text)


def span(text: str) -> tuple[int, int]:
    """``A:B`` with A <= B."""
    low, _, high = text.partition(":")
    if not (low.isdigit() and high.isdigit() and int(low) <= int(high)):
        raise EvidenceError("invalid_range", text)
    return int(low), int(high)

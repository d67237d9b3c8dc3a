"""Regions of a word that endings have to lie in, and lists of endings."""

from __future__ import annotations


def regions(w: str, vowels: str, least: int = 0) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in vowels and w[i - 1] in vowels:
                return i + 1
        return len(w)

    r1 = after(0)
    r2 = after(r1)
    return max(r1, least), r2


def by_size(text: str) -> list[str]:
    return sorted(text.split(), key=len, reverse=True)


def second_letter_region(w: str, v: str) -> int:
    """Spanish and Portuguese region: by the second letter."""
    if len(w) < 3:
        return len(w)
    if w[1] not in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    if w[0] in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    return 3

"""Checks of arguments; what fails raises ValueError with the argument's name."""

from __future__ import annotations


def positive(**values: float | None) -> None:
    """Numbers above zero; None stands for no limit."""
    for name, v in values.items():
        if v is not None and not v > 0:
            raise ValueError(f"{name} must be positive")


def shares(**values: float) -> None:
    """Numbers above zero and below one."""
    for name, v in values.items():
        if not 0 < v < 1:
            raise ValueError(f"{name} must be between 0 and 1")

"""Column expressions: codes of signed numbers, clips, three-valued logic, comparisons, octets."""

from .expressions import *  # noqa: F403

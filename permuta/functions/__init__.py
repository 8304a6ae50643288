"""Column functions on rankings and on hashes used as random numbers."""

from .rankings import *  # noqa: F403

"""All registered queries of the library."""

from . import camera, files, runs, scene, segments, streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

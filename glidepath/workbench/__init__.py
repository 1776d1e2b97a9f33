"""Importing the package registers every query."""

from glidepath.workbench import core, demand, dense, ingest, learning, models, points, serving, texts  # noqa: F401
from glidepath.workbench.registry import QUERIES, SQL  # noqa: F401

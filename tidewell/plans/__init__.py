"""Queries over the driver's tables: one for each operator, with its SQL where SQL can express it."""

from . import building, evaluations, extra, geometry, ingest, models, more, readings

QUERIES = readings.QUERIES | evaluations.QUERIES | models.QUERIES | ingest.QUERIES | geometry.QUERIES | more.QUERIES | extra.QUERIES | building.QUERIES

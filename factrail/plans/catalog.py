"""Imports every module that registers queries."""

from factrail.plans import catalog_paths, catalog_runs, catalog_selection, catalog_text  # noqa: F401

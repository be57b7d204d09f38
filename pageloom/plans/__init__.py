"""Operators as queries; importing a module of this package registers its queries."""

from . import datasets, evaluation, extraction, heuristics, incremental, labelling, records, reports, sections, selection, titles, vocabularies
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "datasets", "evaluation", "extraction", "heuristics", "incremental", "labelling", "records", "reports", "sections", "selection", "titles", "vocabularies"]

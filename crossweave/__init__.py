"""Cross-edition link analysis on PySpark DataFrames.

Collections of pages exist in several language editions.  This package parses
their dumps, resolves the links between editions, repairs ambiguous
counterparts, expands k-step neighbourhoods, recommends links one edition lacks
and ranks or compares pages by the similarity of their neighbourhoods.
"""

from crossweave.workspace import Stored, Workspace

__all__ = ["Stored", "Workspace"]

"""Importing this module registers every query of the library."""

from lodestone.plans import paragraphs, relational, retrieval, serving, storage, structure, tables  # noqa: F401

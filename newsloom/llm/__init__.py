"""Operators of a training-data pipeline. Nothing else in the library imports
this subpackage; ``newsloom.llm.queries`` registers its queries."""

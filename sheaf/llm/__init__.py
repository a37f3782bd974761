"""Operators of a training-data pipeline. Nothing else in the library imports this
subpackage; every query of it is listed in ``sheaf.llm.queries``."""

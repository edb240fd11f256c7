"""Operators of a training-data pipeline, each a ``DataFrame -> DataFrame`` job.

Nothing else in the library imports this package.  ``queries.py`` registers one
query per operator, ``/corpus_pipeline.py`` chains five of them.
"""

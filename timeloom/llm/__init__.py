"""Operators for building language-model training corpora on Spark.

Every module holds one operator with its own general interface; ``queries``
derives the registered queries from them.  Nothing else in the library
imports this package.
"""

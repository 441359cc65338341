"""Training-data operators: ten document-scale operators and their registered queries.

Nothing else in the library imports this subpackage.  ``common.ship_package`` sends
the package to the Python workers through Spark.
"""

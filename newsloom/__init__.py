"""newsloom: message-archive analytics expressed as Spark jobs.

Raw channel dumps are parsed, classified and extracted into typed tables; the
tables answer dashboard, search, statistics, monthly and data-quality queries.
Everything is DataFrame code: rules, dictionaries and places are inputs.
"""

__version__ = "0.1.0"

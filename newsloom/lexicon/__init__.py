"""Default rule values of the archive, stated as plain text.

Every operator takes its rules as an argument; these are only the defaults.
Place lists and search aliases are larger and are input tables.
"""

"""Tests of the optional subpackage; a package, so that its conftest has a name of its own."""

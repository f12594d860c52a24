"""Operators for building a training corpus; nothing outside this subpackage imports it."""

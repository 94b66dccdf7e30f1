"""Readers and writers for the tables the package works on."""

"""Registered queries, analysis drivers, configuration and command line."""

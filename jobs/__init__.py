"""Runnable jobs over the tables. Each module has a function ``run`` that takes a session and plain paths, and a command line."""

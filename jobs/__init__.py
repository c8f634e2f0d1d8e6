"""Runnable jobs: each a function over a session, a command line and a small config file beside it."""

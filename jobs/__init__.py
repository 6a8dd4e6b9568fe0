"""Runnable jobs over plain paths; each module is a command line around one function that takes a session."""

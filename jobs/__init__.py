"""Runnable jobs over given tables; each has a command line and a config file of the same name."""

"""Operators that prepare training text: one module each, and their queries in ``queries``."""

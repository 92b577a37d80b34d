"""Operators put together: one function per report."""

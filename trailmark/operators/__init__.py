"""Relational operators over tables of traces, assets, verdicts and crawls."""

"""Whole analyses, each a declarative plan over tables of traces."""

"""Readers and writers of crawl folders, reports and run tables."""

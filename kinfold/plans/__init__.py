"""Whole-query compositions: study queries, browser requests, imports, gene profiles."""

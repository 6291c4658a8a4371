"""Operators over DataFrames: index, ranking, duplicates, links, spelling, evaluation, crawling."""

"""Operators on DataFrames."""

from raregram.operators.extract import first_rare_grams, postings, rare_grams, rare_grams_udf
from raregram.operators.index import GramIndex, like, not_like, store_rows
from raregram.operators.like_join import like_join
from raregram.operators.selectivity import Frequencies, like_share, like_share_of
from raregram.operators.statistics import analyze, frequent_grams, gram_frequencies, qgram_stat

__all__ = ["Frequencies", "GramIndex", "analyze", "first_rare_grams", "frequent_grams", "gram_frequencies", "like", "like_join", "like_share", "like_share_of", "not_like", "postings", "qgram_stat", "rare_grams", "rare_grams_udf", "store_rows"]

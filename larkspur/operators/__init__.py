"""Operators over DataFrames: search, fusion, reranking, context, storage, sync, folds, quantisation, metrics."""

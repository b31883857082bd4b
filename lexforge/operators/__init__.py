"""Operators over DataFrames: the decision list, references, vocabulary, identifiers, documents, evaluation."""

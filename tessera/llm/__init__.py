"""Training-data operators: secrets, archives, toxicity, language-model scores, mixing, duplicates, quality, leaks, licences.

Nothing else in the library imports this subpackage; it may import general helpers of the library.
"""

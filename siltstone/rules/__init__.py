"""Fixed values of the analysis: patterns, labels, scores and registry entries.

Patterns are written in JavaScript's dialect; siltstone.functions.regex turns
them into the dialect of the engine that runs them.
"""

"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``tidemark.llm.registry`` lists
its queries and their SQL for the driver entry module.
"""

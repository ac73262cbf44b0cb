"""Operators that prepare training data: ten corpus-scale jobs on documents and conversations.

Nothing else in the library imports this subpackage.
"""

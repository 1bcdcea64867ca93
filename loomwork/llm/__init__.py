"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it.  ``queries`` registers one query
per operator; the operators themselves are general and are imported from their
own modules.
"""

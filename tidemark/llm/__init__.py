"""Operators for building training corpora; nothing else in the library imports them.

Modules are imported where they are needed: ``queries`` registers the
``opN_`` checks, each other module holds one operator.
"""

"""Operators for preparing training data: files, filters, near copies, packing, models, archives.

Nothing else in the library imports this subpackage.
"""

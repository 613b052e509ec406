"""Training-data operators: ten corpus components and their registered queries.

Nothing outside this subpackage imports it.
"""

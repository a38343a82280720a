"""Training-data operators: ten stand-alone operators over document, page and vector tables.

Nothing outside this subpackage imports it.
"""

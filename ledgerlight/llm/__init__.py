"""Operators for preparing training corpora: licences, near copies, URL rules, repeats, tokens, neighbours, packing, quality, secrets.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface; ``registry`` derives the contract queries from them.
"""

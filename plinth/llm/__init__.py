"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with its
general interface; :mod:`plinth.llm.queries` derives the registered queries from them.
"""

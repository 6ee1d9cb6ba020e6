"""Training-data operators: deduplication, archives, tokens, packing, language, sharding.

Each module holds one operator with a general interface; :mod:`chunkmere.llm.queries`
derives the registered ``opN_<name>`` digests from them.  Nothing outside this
subpackage imports it.
"""

"""Training-data operators: deduplication, filtering, mixing and packing of text corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py`` at the repository
top) imports it.  Each module holds one operator with its own general
interface; ``queries.py`` registers the thin ``opN_<name>`` queries.
"""

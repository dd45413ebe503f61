"""Training-data operators: ten methods over text, vectors and conversations.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the
repository top is the only other user.
"""

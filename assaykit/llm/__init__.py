"""Training-data operators: chat formatting, language id, license scans, token
counts, quality rules, language-model scoring, decontamination, line dedup,
SimHash near-dedup, SentencePiece coding, phrase fingerprints, source divergence and
periodic runs.

Nothing else in the library imports this subpackage; its queries and SQL are in
``queries`` and ``oracles``.
"""

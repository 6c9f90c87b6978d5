"""Training-data operators: deduplication, quality, tokens, licences, chat, language, mixing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""

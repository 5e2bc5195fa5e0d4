"""Training-data operators: mixing, language id, decontamination, dedup, quality, licences, LM scoring, chat.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its queries only when it is present.
"""

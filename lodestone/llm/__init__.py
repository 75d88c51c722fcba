"""Training-data operators (quality, decontamination, near-dedup, ANN, toxicity,
HTML extraction, mixing, secret scans, chat formatting, language ID).

Nothing outside this subpackage imports it.
"""

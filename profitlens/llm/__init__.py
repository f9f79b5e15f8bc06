"""Training-data operators: quality, extraction, dedup, decontamination, tokenisation, LM scoring.

Nothing outside this package imports it; ``queries.py`` lists what the driver may register."""

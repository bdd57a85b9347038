"""Fixed values that results depend on; they must equal the pipeline's published settings."""

import random

SHINGLE_WORDS = 5
PERMUTATIONS = 128
PRIME = 2147483647
BANDS, BAND_ROWS = 25, 5
LSH_THRESHOLD = 0.5
MIN_SEGMENT_WORDS = 20
SMALL_MATCH_WORDS = 10
NGRAM_THRESHOLD = 0.60
FUZZY_THRESHOLD = 0.85
MAX_CANDIDATES = 50
SEGMENT_RATIO = 3.0
SENTENCE_RATIO = 2.5
SEMANTIC_THRESHOLD = 0.85
CHUNK_SENTENCES = 4
SIMILARITY_HIGH = 0.7
CHECK_PAPERS = 100


def permutation_parameters(n: int = PERMUTATIONS) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of the hash permutations, drawn from one seeded stream."""
    draw = random.Random(42)
    return [draw.randint(1, PRIME - 1) for _ in range(n)], [draw.randint(0, PRIME - 1) for _ in range(n)]

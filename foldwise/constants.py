"""Fixed values that must equal the scoring task's conventions."""

# The six essay targets, in their published order.
TARGETS = ["cohesion", "syntax", "vocabulary", "phraseology", "grammar", "conventions"]

# The score grid runs 1.0 to 5.0 in steps of 0.5 (nine levels);
# level c decodes to SCORE_BASE + SCORE_STEP * c.
SCORE_BASE = 1.0
SCORE_STEP = 0.5
SCORE_LEVELS = 9

# Masking and padding conventions.
IGNORE_INDEX = -100          # token target that contributes no loss
MEAN_POOL_EPS = 1e-9         # floor of the mask sum in masked mean pooling
MASKED_MAX_FILL = -1e4       # value given to hidden positions in masked max
SPECIAL_WORD_ID = -1         # word id of special / padding tokens
SOFT_LABEL_THRESHOLD = 0.0   # soft labels count when their first prob exceeds this

"""Patterns of numbers and gains that several modules share."""

# Fixed values.
NUMBER = r"(\d+\.?\d*)"
#: Phrases before a percentage gain, then before a plain one, in order.
GAINS = (r"improv(?:e|es|ed)\s+by", r"improvement\s+of", r"increase\s+of", r"gain\s+of")
# End of fixed values.

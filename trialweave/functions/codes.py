"""Fixed code tables used by the text and label functions."""

# --- fixed values -------------------------------------------------------------
# symbol map applied when phoneme alignments are ingested
INGEST_SYMBOLS = {
    "a": "AA", "ae": "EH", "i": "IY", "u": "UW", "b": "B", "p": "P",
    "v": "V", "g": "G", "k": "K", "UH": "UW", "AE": "EH",
}
# symbol map applied when labels of different subjects are brought together
DECODE_SYMBOLS = {
    "a": "AA", "ae": "EH", "i": "IY", "u": "UH", "b": "B", "p": "P",
    "v": "V", "g": "G", "k": "K",
}
# common label codes across subjects
TARGET_CODES = {
    "AA": 1, "AE": 2, "AH": 3, "AO": 4, "AY": 5, "B": 6, "D": 7,
    "EH": 8, "EY": 9, "F": 10, "G": 11, "HH": 12, "IH": 13,
    "IY": 14, "JH": 15, "K": 16, "L": 17, "M": 18, "N": 19,
    "OW": 20, "P": 21, "R": 22, "S": 23, "T": 24, "UH": 25,
    "V": 26, "W": 27, "Z": 28,
}
# label code -> articulator class
ARTICULATORS = {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 3, 8: 4, 9: 4}
# phonemes per trial by task, and the default
PHONEMES_PER_TRIAL = {"lexical": 5, "phoneme": 3}
DEFAULT_PHONEMES_PER_TRIAL = 5
# multiplier from a named unit to volts
VOLTS_PER_UNIT = {"V": 1.0, "mV": 1e-3, "uV": 1e-6, "nV": 1e-9}
# analog scaling: (multiplier, offset subtracted from the raw word)
AMPLIFIER_SCALE = (0.195, 32768)
AUX_SCALE = (37.4e-6, 0)
SUPPLY_SCALE = (74.8e-6, 0)
TEMPERATURE_SCALE = (0.01, 0)
ADC_SCALE_BY_MODE = {1: (152.59e-6, 32768), 13: (312.5e-6, 32768)}
ADC_SCALE_OTHER = (50.354e-6, 0)
# ------------------------------------------------------------------------------

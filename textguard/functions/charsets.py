"""Character sets, label names and thresholds the detection rules are stated in."""

# --- fixed values ---------------------------------------------------------
# Whitespace: every code point a Unicode-aware split breaks on.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Digits and marks that stand in for letters.
LEET = "0134578@!$+|()<>"
# Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = "аеорсхуАВЕКМНОРСТУХαβγδεζηθικλμνοπρστυφχψω"
# Zero-width marks, byte-order mark, no-break space and the typographic spaces.
INVISIBLES = (
    "\u200b\u200c\u200d\u2060\ufeff\u00a0"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
)
# A text read backwards starts with one of these (whole text / single word).
REVERSED_TEXT_STARTS = ("gn", "tn", "dn", "de", "se", "er")
REVERSED_WORD_STARTS = ("gn", "tn", "dn", "rg", "rt", "rd", "yc", "yt", "elp")

# Whole-text labels in the order they are tested.
WHOLE_TYPES = (
    "whole_text_base64",
    "whole_text_hex",
    "whole_text_binary",
    "whole_text_url_encoded",
    "whole_text_unicode_escapes",
    "whole_text_invisible_chars",
    "whole_text_char_swaps",
    "whole_text_reversed",
)
# Word labels in the order they are tested.
WORD_TYPES = (
    "binary",
    "base64",
    "hex",
    "url_encoded",
    "unicode_escapes",
    "leetspeak",
    "invisible_chars",
    "char_swaps",
    "reversed",
    "spaced_text",
    "alternating_case",
)
MIN_WHOLE_CHARS = 10
MIN_WORD_LETTERS = 3
PRINTABLE_SHARE = 0.85
URL_SHARE = 0.3
INVISIBLE_SHARE = 0.1
LOOK_ALIKE_SHARE = 0.3
# (minimum, share of all words, cap)
RUN_THRESHOLD = (4, 0.1, 10)
SAME_TYPE_THRESHOLD = (4, 0.15, 20)
# --------------------------------------------------------------------------

# One mark per word: what the word cascade said about it. A message of n words
# is carried as a string of n marks, the narrowest state the run-length, count
# and position rules can be answered from.
UNCHECKED_MARK = "_"
CLEAN_MARK = "."
WORD_MARKS = dict(zip(WORD_TYPES, "nbhuelisrxa"))

# Java regular-expression classes built from the sets above. Latin-1 characters are listed:
# Java looks listed ones up at once and tests ranges one after another.
WS = "[\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
LEET_CLASS = "[0134578@!$+|()<>]"
# one range for each run of neighbours, which are tested one after another
_STARTS = sorted(c for c in LOOK_ALIKES if chr(ord(c) - 1) not in LOOK_ALIKES)
_ENDS = sorted(c for c in LOOK_ALIKES if chr(ord(c) + 1) not in LOOK_ALIKES)
LOOK_ALIKE_CLASS = "[" + "".join(f"{a}-{z}" for a, z in zip(_STARTS, _ENDS, strict=True)) + "]"
INVISIBLE_CLASS = "[\\u200b-\\u200d\\u2060\\ufeff\\xa0\\u2000-\\u200a]"
